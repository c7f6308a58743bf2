"""Movement patterns per client (B6): k-means on standardised coordinates.

All clients are clustered together: every step is a join keyed by
``client_id`` and an aggregation, with the (small) centre table materialised
between iterations.  Duplicate coordinates are collapsed into weights first,
so a client's volume does not enter the pairwise work.  Seeding is
k-means++ with 10 runs side by side, made deterministic by hashing (the
reference draws random seeds, so labels cannot match it exactly; the
invariants do), and the run of least inertia wins per client.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotide.session import checkpoint_dir, materialize

# Number of clusters, minimum points of a reported cluster.
N_CLUSTERS = 8
MIN_CLUSTER_POINTS = 2
MAX_ITER = 300  # most rounds of the k-means solver
N_INIT = 10


def _d2(ax, ay, bx, by):
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def kmeans_per_client(points: DataFrame, k: int = N_CLUSTERS, max_iter: int = MAX_ITER,
                      n_init: int = N_INIT) -> DataFrame:
    """Cluster each client's (lat, lon) after per-client standardisation.

    ``points``: client_id, lat, lon.  Clients with fewer than ``k`` points are
    skipped (the reference's k-means raises for them).  Returns one row per
    distinct (client, lat, lon) with ``weight`` and ``cluster`` (0..k-1,
    numbered by centre position).
    """
    checkpoint_dir(points.sparkSession)
    p = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    stats = p.groupBy("client_id").agg(F.count(F.lit(1)).alias("__n"), F.avg("lat").alias("__ma"),
                                       F.stddev_pop("lat").alias("__sa"), F.avg("lon").alias("__mo"),
                                       F.stddev_pop("lon").alias("__so")).where(F.col("__n") >= k)
    w = p.groupBy("client_id", "lat", "lon").agg(F.count(F.lit(1)).alias("weight"))
    z = w.join(stats, "client_id").select(
        "client_id", "lat", "lon", "weight",
        ((F.col("lat") - F.col("__ma")) / F.when(F.col("__sa") == 0, 1.0).otherwise(F.col("__sa"))).alias("x"),
        ((F.col("lon") - F.col("__mo")) / F.when(F.col("__so") == 0, 1.0).otherwise(F.col("__so"))).alias("y"))
    z = materialize(z, "km-points")

    # k-means++ seeding, ``n_init`` independent runs side by side (as the reference's 10 restarts):
    # the first centre is the point with the smallest hash, each next one a D^2-weighted draw made
    # deterministic by an exponential race (smallest -ln(u) / (w D^2)).
    key = ["client_id", "run"]

    def unif(salt):
        h = F.xxhash64(F.col("run"), F.lit(salt), F.col("lat"), F.col("lon"))
        return (F.abs(h % F.lit(1 << 52)) + F.lit(1)) / F.lit(float((1 << 52) + 1))

    runs = z.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))))
    first = runs.groupBy(*key).agg(F.min(F.struct(unif(0).alias("u"), "x", "y")).alias("c"))
    cents = materialize(first.select(*key, F.lit(0).alias("cid"), F.col("c.x").alias("cx"),
                                     F.col("c.y").alias("cy")), "km-seed")
    for i in range(1, k):
        race = (-F.log(unif(i))) / (F.col("weight") * F.col("d"))
        pick = _nearest(z, cents).where(F.col("d") > 0).groupBy(*key).agg(F.min(F.struct(race.alias("r"), "x", "y")).alias("m"))
        new = pick.select(*key, F.lit(i).alias("cid"), F.col("m.x").alias("cx"), F.col("m.y").alias("cy"))
        cents = materialize(cents.unionByName(new), "km-seed")
    # Lloyd iterations (all clients and runs together): only sums per centre are shuffled, and only runs that
    # still move go on, so the rounds of the slowest run do not repeat the work of the others
    live, settled = cents, []
    for _ in range(max_iter):
        wsum = _nearest(z, live).groupBy(*key, "cid").agg(
            (F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("nx"),
            (F.sum(F.col("y") * F.col("weight")) / F.sum("weight")).alias("ny"))
        # sums in another order may differ in the last digits: that is no movement
        moved = (F.abs(F.coalesce("nx", "cx") - F.col("cx")) > 1e-12) | (F.abs(F.coalesce("ny", "cy") - F.col("cy")) > 1e-12)
        new = live.join(wsum, key + ["cid"], "left").select(
            *key, "cid", F.coalesce("nx", "cx").alias("cx"), F.coalesce("ny", "cy").alias("cy"), moved.alias("moved"))
        new = materialize(new.withColumn("moved", F.max("moved").over(Window.partitionBy(*key))), "km-iter")
        settled.append(new.where(~F.col("moved")).drop("moved"))
        live = new.where("moved").drop("moved")
        if live.isEmpty():
            break
        if len(settled) == 10:  # a plan of few parts
            settled = [materialize(reduce(DataFrame.unionByName, settled), "km-settled")]
    else:
        raise RuntimeError(f"k-means still moves after {max_iter} rounds; allow more by max_iter")
    cents = materialize(reduce(DataFrame.unionByName, settled), "km-settled")
    # best run per client by inertia, clusters numbered by centre position
    inertia = _nearest(z, cents).groupBy(*key).agg(F.sum(F.col("d") * F.col("weight")).alias("inertia"))
    win = inertia.groupBy("client_id").agg(F.min(F.struct("inertia", "run")).alias("w")) \
        .select("client_id", F.col("w.run").alias("run"))
    order = Window.partitionBy(*key).orderBy("cx", "cy", "cid")
    best = materialize(cents.join(win, key, "left_semi").withColumn("cluster", F.row_number().over(order) - 1), "km-best")
    out = _nearest(z, best.drop("cluster"))
    return out.join(best.select("client_id", "cid", "cluster"), ["client_id", "cid"]).select("client_id", "lat", "lon", "weight", "cluster")


def _nearest(points: DataFrame, cents: DataFrame) -> DataFrame:
    """Each point once per run with its nearest centre ``cid`` (ties: the smaller) and its squared distance ``d``.

    A client's centres are one array (runs x clusters entries) that is joined to its points, so the choice
    is made row by row and no point-centre pairs are shuffled."""
    sets = cents.groupBy("client_id", "run").agg(F.sort_array(F.collect_list(F.struct("cid", "cx", "cy"))).alias("cs"))
    sets = sets.groupBy("client_id").agg(F.collect_list(F.struct("run", "cs")).alias("sets"))
    j = points.join(sets, "client_id")
    near = F.transform("sets", lambda s: F.struct(s["run"].alias("run"), F.array_min(F.transform(
        s["cs"], lambda c: F.struct(_d2(F.col("x"), F.col("y"), c["cx"], c["cy"]).alias("d"), c["cid"].alias("cid")))).alias("b")))
    return j.select(*points.columns, F.explode(near).alias("n")).select(*points.columns, "n.run", "n.b.d", "n.b.cid")


def movement_patterns(points: DataFrame, k: int = N_CLUSTERS) -> tuple[DataFrame, DataFrame]:
    """(patterns, pattern paths).

    ``points``: client_id, lat, lon, timestamp.  A cluster with at least two
    points becomes a pattern named ``Cluster i`` (1-based) whose position is
    the length-weighted centroid of the time-ordered line through its points
    (the vertex mean when the line has no length).  The line itself is
    returned as rows (client_id, pattern_type, seq, lon, lat) so no cluster is
    gathered into one array.
    """
    lab = kmeans_per_client(points, k)
    pts = points.join(lab.select("client_id", "lat", "lon", "cluster"), ["client_id", "lat", "lon"])
    key = ["client_id", "cluster"]
    w = Window.partitionBy(*key).orderBy(F.col("timestamp").asc_nulls_first(), "lat", "lon")
    seg = pts.withColumn("seq", F.row_number().over(w)) \
        .withColumn("nlat", F.lead("lat").over(w)).withColumn("nlon", F.lead("lon").over(w))
    seg = materialize(seg, "km-seg")
    ln = F.sqrt(_d2(F.col("lon"), F.col("lat"), F.col("nlon"), F.col("nlat")))
    agg = seg.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.sum(F.when(F.col("nlat").isNotNull(), ln)).alias("__L"),
        F.sum(F.when(F.col("nlat").isNotNull(), ln * (F.col("lon") + F.col("nlon")) / 2)).alias("__X"),
        F.sum(F.when(F.col("nlat").isNotNull(), ln * (F.col("lat") + F.col("nlat")) / 2)).alias("__Y"),
        F.avg("lon").alias("__mx"), F.avg("lat").alias("__my"), F.min("timestamp").alias("timestamp"))
    agg = agg.where(F.col("n_points") >= MIN_CLUSTER_POINTS)
    has_len = F.coalesce(F.col("__L"), F.lit(0.0)) > 0
    patterns = agg.select(
        F.xxhash64("client_id", "cluster").alias("pattern_id"), "client_id",
        F.when(has_len, F.col("__Y") / F.col("__L")).otherwise(F.col("__my")).alias("lat"),
        F.when(has_len, F.col("__X") / F.col("__L")).otherwise(F.col("__mx")).alias("lon"),
        F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string")).alias("pattern_type"),
        "n_points", "timestamp")
    paths = seg.join(agg.select(*key), key, "left_semi").select(
        "client_id", F.concat(F.lit("Cluster "), (F.col("cluster") + 1).cast("string")).alias("pattern_type"),
        "seq", "lon", "lat")
    return patterns, paths
