"""Density clustering per client (B4) and hotspot detection.

DBSCAN re-expressed over grid cells, so that no table of point pairs is ever made:

1. duplicate coordinates of a client are collapsed into weighted points
   (phones report the same fix many times; this pre-aggregates hot spots
   before any pairwise work);
2. points are put into cells whose diagonal is ``eps``, so all points of a cell are neighbours;
   a cell that weighs ``min_samples`` or more is dense, and all its points are *core* without a look at any pair;
3. the few points of the other cells count the weight within ``eps`` over the adjacent cells;
4. core points of one cell belong together, so cells are what is connected: two adjacent cells are
   linked when a core point of one lies within ``eps`` of one of the other.  Up to 64 sub-cells of
   either side decide nearly all cases by one point each (linked) or by their bounding boxes (not
   linked); points are compared only between the sub-cells that are left;
5. components of cells come from iterative min-label propagation with pointer
   jumping, each round a written table (lineage stays short, an executor loss re-reads it);
6. border points join the smallest cluster with a core point within ``eps``, the rest is noise.

Each cluster is named by the smallest (lat, lon) of its core points, so results do not depend on
partitioning, input order or the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotide.functions.geo import DEG2RAD, EARTH_RADIUS_M, METRES_PER_DEGREE_RADIUS, haversine_m, planar_deg
from geotide.session import checkpoint_dir, materialize

# Fixed values of hotspot detection: eps of 0.005 radians on the unit sphere
# (the haversine metric), expressed in metres; at least 5 samples.
HOTSPOT_EPS_RAD = 0.005
HOTSPOT_EPS_M = HOTSPOT_EPS_RAD * EARTH_RADIUS_M
HOTSPOT_MIN_SAMPLES = 5


def _label_components(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Connected components by min-label propagation with pointer jumping.

    ``nodes``: key columns + ``node`` (orderable id, unique per key).
    ``edges``: key columns + ``a``, ``b`` (node values; both directions given).
    Returns key + ``node`` + ``label`` (smallest node of the component).
    """
    spark = nodes.sparkSession
    checkpoint_dir(spark)
    lab = materialize(nodes.select(*key, "node", F.col("node").alias("label")))
    while True:  # until no label changes; pointer jumping keeps the rounds few
        # propagate: smallest label among a node's neighbours (and its own)
        nb = edges.join(lab.select(*key, F.col("node").alias("b"), F.col("label").alias("lb")), key + ["b"])
        prop = nb.groupBy(*key, F.col("a").alias("node")).agg(F.min("lb").alias("m"))
        new = lab.join(prop, key + ["node"], "left").select(
            *key, "node", F.col("label").alias("old"),
            F.least(F.col("label"), F.coalesce(F.col("m"), F.col("label"))).alias("label"))
        # pointer jumping: label := label(label)
        jump = new.select(*key, F.col("node").alias("label"), F.col("label").alias("l2"))
        new = new.join(jump, key + ["label"], "left").select(
            *key, "node", "old", F.least(F.col("label"), F.coalesce(F.col("l2"), F.col("label"))).alias("label"))
        new = materialize(new.withColumn("changed", F.col("label") != F.col("old")))
        lab = new.select(*key, "node", "label")
        if new.where("changed").isEmpty():
            break
    return lab


def density_cluster(points: DataFrame, eps_m: float, min_samples: int, key: str = "client_id",
                    weight_col: str | None = None,
                    carry: dict | None = None, metric: str = "sphere") -> DataFrame:
    """DBSCAN labels per ``key``; ``metric`` 'sphere' (eps in metres) or 'planar' (eps in degrees).

    ``points`` needs ``key``, ``lat``, ``lon``.  Returns one row per distinct
    (key, lat, lon) with ``weight`` (multiplicity), ``is_core`` and ``label``
    (struct of the cluster's smallest core lat/lon; null for noise).  ``weight_col``
    names a multiplicity column of pre-aggregated input; ``carry`` maps output
    names to aggregate Columns computed in the same collapse step.
    """
    wt = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    extra = [c.alias(n) for n, c in (carry or {}).items()]
    coords = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()) \
        .groupBy(key, "lat", "lon").agg(wt.alias("weight"), *extra)
    grid = _Grid(eps_m, metric)
    coords = materialize(coords.withColumn("ci", grid.band("lat")).withColumn("cj", grid.column("lon", "ci"))
                         .withColumn("node", _node("ci", "cj")), "coords")
    cells = coords.groupBy(key, "node").agg(F.min("ci").alias("ci"), F.min("cj").alias("cj"), F.sum("weight").alias("cell_weight"))
    cells = materialize(cells.withColumn("dense", F.col("cell_weight") >= min_samples), "cells")
    near = cells.select(key, "node", F.explode(grid.adjacent("ci", "cj")).alias("other"))
    near = materialize(near.join(cells.select(key, F.col("node").alias("other")), [key, "other"], "left_semi"), "adjacent")

    # points of cells that are not dense, of which a cell holds fewer than min_samples: weight within eps
    sparse = coords.join(cells.where(~F.col("dense")).select(key, "node"), [key, "node"], "left_semi").select(key, "node", "lat", "lon")
    around = coords.select(key, F.col("node").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("weight").alias("w2"))
    seen = sparse.join(near, [key, "node"]).join(around, [key, "other"]).where(grid.distance("lat", "lon", "lat2", "lon2") <= eps_m)
    few = seen.groupBy(key, "lat", "lon").agg((F.sum("w2") >= min_samples).alias("enough"))
    pts = coords.join(few, [key, "lat", "lon"], "left")
    pts = materialize(pts.withColumn("is_core", F.coalesce("enough", F.lit(True))).drop("enough"), "core")

    core = pts.where("is_core")
    links = _linked_cells(core, near, key, grid, eps_m)
    lab = _label_components(core.select(key, "node").distinct(), links, [key])
    named = core.join(lab, [key, "node"]).groupBy(key, "label").agg(F.min(F.struct("lat", "lon")).alias("name"))
    lab = materialize(lab.join(named, [key, "label"]).select(key, "node", F.col("name").alias("label")), "cluster")

    heart = core.join(lab, [key, "node"]).select(key, F.col("node").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "label")
    rim = pts.where(~F.col("is_core")).select(key, "node", "lat", "lon").join(near, [key, "node"]).join(heart, [key, "other"]) \
        .where(grid.distance("lat", "lon", "lat2", "lon2") <= eps_m)
    border = rim.groupBy(key, "lat", "lon").agg(F.min("label").alias("border_label"))
    out = pts.join(lab, [key, "node"], "left").join(border, [key, "lat", "lon"], "left")
    return materialize(out.select(key, "lat", "lon", "weight", *(carry or {}).keys(), "is_core",
                                  F.when(F.col("is_core"), F.col("label")).otherwise(F.col("border_label")).alias("label")), "dbscan")


class _Grid:
    """Cells of diagonal eps: bands of latitude, each cut by longitude at its own width (on the sphere)."""

    #: Cells are a little smaller than they may be, so that rounding puts no two points of one beyond eps.
    SLACK = 1 - 1e-9

    def __init__(self, eps: float, metric: str):
        self.eps, self.planar = float(eps), metric == "planar"
        degrees = self.eps if self.planar else self.eps / (EARTH_RADIUS_M * DEG2RAD)
        self.side = degrees / math.sqrt(2) * self.SLACK
        self.reach = math.sin(self.eps / EARTH_RADIUS_M / 2) ** 2 if self.eps < math.pi * EARTH_RADIUS_M else 1.0

    def distance(self, *cols: str) -> Column:
        return planar_deg(*cols) if self.planar else haversine_m(*[F.col(c) for c in cols])

    def band(self, lat: str) -> Column:
        return F.floor(F.col(lat) / F.lit(self.side))

    def _edges(self, band: Column) -> tuple[Column, Column]:
        """Least and largest absolute latitude of a band."""
        a, b = F.abs(band * F.lit(self.side)), F.abs((band + 1) * F.lit(self.side))
        return F.least(a, b), F.least(F.greatest(a, b), F.lit(90.0))

    def width(self, band: Column) -> Column:
        """Width of the band's cells in degrees; the parallel nearest to the equator is the longest."""
        if self.planar:
            return F.lit(self.side)
        return F.lit(self.side) / F.greatest(F.cos(F.least(self._edges(band)[0], F.lit(90.0)) * F.lit(DEG2RAD)), F.lit(1e-9))

    def column(self, lon: str, band: str) -> Column:
        return F.floor(F.col(lon) / self.width(F.col(band)))

    def adjacent(self, ci: str, cj: str) -> Column:
        """Cells that may hold a point within eps of one in this cell (this cell included), as an array of nodes."""
        i, j = F.col(ci), F.col(cj)
        offsets = F.array(*[F.lit(k).cast("long") for k in (-2, -1, 0, 1, 2)])
        if self.planar:
            return F.flatten(F.transform(offsets, lambda di: F.transform(offsets, lambda dj: (i + di) * F.lit(1 << 32) + j + dj)))
        own, far = self.width(i), F.cos(self._edges(i)[1] * F.lit(DEG2RAD))

        def in_band(di):
            b = i + di
            w = self.width(b)
            ratio = F.lit(self.reach) / F.greatest(far * F.cos(self._edges(b)[1] * F.lit(DEG2RAD)), F.lit(1e-18))
            reach = F.when(ratio >= 1, F.lit(360.0)).otherwise(F.asin(F.sqrt(F.least(ratio, F.lit(1.0)))) * F.lit(2.0 / DEG2RAD * (1 + 1e-9)))
            first = F.floor((F.greatest(j * own, F.lit(-180.0)) - reach) / w)
            last = F.floor((F.least((j + 1) * own, F.lit(180.0)) + reach) / w)
            return F.transform(F.sequence(first, last), lambda c: b * F.lit(1 << 32) + c)

        return F.flatten(F.transform(offsets, in_band))

    def least_distance(self, a: str, b: str) -> Column:
        """No point of the box ``a`` is nearer than this to one of the box ``b`` (columns <box>_s, _n, _w, _e)."""
        lat = F.greatest(F.lit(0.0), F.col(f"{a}_s") - F.col(f"{b}_n"), F.col(f"{b}_s") - F.col(f"{a}_n"))
        lon = F.greatest(F.lit(0.0), F.col(f"{a}_w") - F.col(f"{b}_e"), F.col(f"{b}_w") - F.col(f"{a}_e"))
        if self.planar:
            return F.sqrt(lat * lat + lon * lon) * F.lit(self.SLACK)
        cos = F.lit(1.0)
        for x in (a, b):
            cos = cos * F.cos(F.greatest(F.abs(F.col(f"{x}_s")), F.abs(F.col(f"{x}_n"))) * F.lit(DEG2RAD))
        half = F.lit(DEG2RAD / 2)
        h = F.pow(F.sin(lat * half), F.lit(2)) + cos * F.pow(F.sin(lon * half), F.lit(2))
        return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * F.lit(2 * EARTH_RADIUS_M * self.SLACK)


def _node(ci: str, cj: str) -> Column:
    """A cell as one long."""
    return F.col(ci) * F.lit(1 << 32) + F.col(cj)


def _linked_cells(core: DataFrame, near: DataFrame, key: str, grid: _Grid, eps: float, parts: int = 8) -> DataFrame:
    """Pairs of adjacent cells (a, b), both ways, with core points within eps of each other."""
    w = grid.width(F.col("ci"))
    inside = lambda x: F.least(F.greatest(F.floor(x * F.lit(parts)), F.lit(0)), F.lit(parts - 1))
    core = core.select(key, "node", "lat", "lon", (inside(F.col("lat") / F.lit(grid.side) - F.col("ci")) * parts
                                                   + inside(F.col("lon") / w - F.col("cj"))).alias("sub"))
    sub = core.groupBy(key, "node", "sub").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"),
                                               F.min(F.struct("lat", "lon")).alias("p"))

    def side(x: str, node: str) -> DataFrame:
        return sub.select(key, F.col("node").alias(node), F.col("sub").alias(f"{x}_sub"), *[F.col(c).alias(f"{x}_{c}") for c in "snwe"],
                          F.col("p.lat").alias(f"{x}_lat"), F.col("p.lon").alias(f"{x}_lon"))

    pairs = near.where(F.col("node") < F.col("other")).join(side("a", "node"), [key, "node"]).join(side("b", "other"), [key, "other"]) \
        .where(grid.least_distance("a", "b") <= eps)
    pairs = materialize(pairs.select(key, "node", "other", "a_sub", "b_sub",
                                     (grid.distance("a_lat", "a_lon", "b_lat", "b_lon") <= eps).alias("linked")), "sub-cells")
    linked = pairs.where("linked").select(key, "node", "other").distinct()
    unclear = pairs.join(linked, [key, "node", "other"], "left_anti")
    one = core.select(key, "node", F.col("sub").alias("a_sub"), "lat", "lon")
    two = core.select(key, F.col("node").alias("other"), F.col("sub").alias("b_sub"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rest = unclear.join(one, [key, "node", "a_sub"]).join(two, [key, "other", "b_sub"]).where(grid.distance("lat", "lon", "lat2", "lon2") <= eps)
    both = linked.unionByName(rest.select(key, "node", "other").distinct())
    return materialize(both.select(key, F.col("node").alias("a"), F.col("other").alias("b"))
                       .unionByName(both.select(key, F.col("other").alias("a"), F.col("node").alias("b"))), "cell-links")


def detect_hotspots(points: DataFrame, eps_m: float = HOTSPOT_EPS_M,
                    min_samples: int = HOTSPOT_MIN_SAMPLES) -> DataFrame:
    """Clusters of a client's points -> centre, radius, density, source type.

    ``points``: client_id, lat, lon, source_type ('trajectory' before 'poi' in
    the reference's input order, so a cluster holding any trajectory point is
    typed 'trajectory').  Centre is the mean of all (duplicate) points; radius
    is the largest planar degree distance to the centre times 111 000;
    density is the number of points.
    """
    src = F.min(F.when(F.col("source_type") == "trajectory", 0).otherwise(1))
    lab = density_cluster(points, eps_m, min_samples, carry={"__src": src}).where(F.col("label").isNotNull())
    w = F.col("weight").cast("double")
    cen = lab.groupBy("client_id", "label").agg(
        (F.sum(w * F.col("lat")) / F.sum(w)).alias("c_lat"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("c_lon"),
        F.sum("weight").alias("density"), F.min("__src").alias("__src"))
    rad = lab.join(cen.select("client_id", "label", "c_lat", "c_lon"), ["client_id", "label"]) \
        .groupBy("client_id", "label").agg(F.max(planar_deg("lat", "lon", "c_lat", "c_lon")).alias("__r"))
    out = cen.join(rad, ["client_id", "label"])
    return out.select("client_id", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"),
                      (F.col("__r") * F.lit(METRES_PER_DEGREE_RADIUS)).alias("radius"),
                      F.col("density").cast("double").alias("density"), F.lit("hotspot").alias("type"),
                      F.when(F.col("__src") == 0, F.lit("trajectory")).otherwise(F.lit("poi")).alias("source_type"))
