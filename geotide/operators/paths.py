"""Least-length paths for many requests at once.

The reference runs one heap-based A* per request on a downloaded road graph.
Here all requests are solved together by frontier relaxation (parallel
Bellman-Ford): each round joins the nodes improved in the previous round with
the edges, keeps the best (distance, predecessor) per (request, node) and
materialises the labels.  The search is goal-directed: a label that cannot beat the goal's own, by the
straight distance that is left, is dropped.  Edges are limited to each request's bounding box
(origin/destination +- 0.01 deg, F23), which bounds the work per request.
Paths are rebuilt by pointer doubling over the predecessor tree, so the number
of rounds grows with log(path hops), not with the hops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotide.functions.geo import BBOX_BUFFER_DEG, geodesic_m
from geotide.operators.spatial import nearest_neighbour
from geotide.session import checkpoint_dir, materialize


def movement_graph(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A road-like graph derived from telemetry: nodes are distinct positions, edges join
    consecutive points of a session (both directions), length = geodesic metres."""
    from pyspark.sql import Window
    nodes = points.select("lat", "lon").distinct().withColumn("node_id", F.xxhash64("lat", "lon"))
    w = Window.partitionBy("client_id", "session_id").orderBy("timestamp", "lat", "lon")
    seg = points.withColumn("nlat", F.lead("lat").over(w)).withColumn("nlon", F.lead("lon").over(w)) \
        .where(F.col("nlat").isNotNull() & ((F.col("nlat") != F.col("lat")) | (F.col("nlon") != F.col("lon"))))
    e = seg.select(F.xxhash64("lat", "lon").alias("src"), F.xxhash64("nlat", "nlon").alias("dst"),
                   geodesic_m("lat", "lon", "nlat", "nlon").alias("length_m"))
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m"))
    return nodes.select("node_id", "lon", "lat"), e.groupBy("src", "dst").agg(F.min("length_m").alias("length_m"))


def shortest_paths(requests: DataFrame, nodes: DataFrame, edges: DataFrame,
                   buffer_deg: float = BBOX_BUFFER_DEG, straight: float = 1.0 - 1e-9) -> DataFrame:
    """For each request (request_id, origin_lat/lon, goal_lat/lon) the least-length path
    between the graph nodes nearest to origin and goal, within the requests' bounding box.

    Returns request_id, origin_node, goal_node, length_m (null when unreachable) and
    path (array<struct<lon, lat>>, origin first; empty when unreachable).  ``straight`` is the least
    length of an edge per metre between its ends (0 where lengths are not metres): once a goal is reached,
    labels whose length plus that bound to the goal is more are not followed.
    """
    spark = requests.sparkSession
    checkpoint_dir(spark)
    r = requests.select("request_id", "origin_lat", "origin_lon", "goal_lat", "goal_lon")
    r = nearest_neighbour(r, nodes, ["request_id"], "origin_lat", "origin_lon", "lat", "lon", ["node_id"],
                          ["node_id"]).withColumnRenamed("node_id", "origin_node").drop("__knn_d")
    r = nearest_neighbour(r, nodes, ["request_id"], "goal_lat", "goal_lon", "lat", "lon", ["node_id"],
                          ["node_id"]).withColumnRenamed("node_id", "goal_node").drop("__knn_d")
    r = r.withColumn("s", F.least("origin_lat", "goal_lat") - buffer_deg) \
        .withColumn("n", F.greatest("origin_lat", "goal_lat") + buffer_deg) \
        .withColumn("w", F.least("origin_lon", "goal_lon") - buffer_deg) \
        .withColumn("e", F.greatest("origin_lon", "goal_lon") + buffer_deg)
    r = materialize(r, "sp-req")
    goal = nodes.select(F.col("node_id").alias("goal_node"), F.col("lat").alias("glat"), F.col("lon").alias("glon"))
    box = materialize(r.join(goal, "goal_node").select("request_id", "goal_node", "s", "n", "w", "e", "glat", "glon"), "sp-box")
    ed = edges.join(nodes.select(F.col("node_id").alias("dst"), F.col("lat").alias("dlat"),
                                 F.col("lon").alias("dlon")), "dst")
    labels = materialize(r.where(F.col("origin_node").isNotNull()).select(
        "request_id", F.col("origin_node").alias("node"), F.lit(0.0).alias("dist"),
        F.lit(None).cast("long").alias("pred")), "sp-lab")
    frontier = labels
    while True:  # until no label improves
        # a label that cannot beat the goal's own is dropped: its distance and the straight rest are a lower bound;
        # the distance alone is tested first, so that the rest is measured for few
        there = labels.join(box.select("request_id", F.col("goal_node").alias("node")), ["request_id", "node"]) \
            .select("request_id", F.col("dist").alias("goal_dist"))
        cand = frontier.select("request_id", F.col("node").alias("src"), F.col("dist").alias("d0")) \
            .join(ed, "src").join(box, "request_id").join(there, "request_id", "left") \
            .where(F.col("dlat").between(F.col("s"), F.col("n")) & F.col("dlon").between(F.col("w"), F.col("e"))) \
            .where(F.col("goal_dist").isNull() | (F.col("d0") + F.col("length_m") <= F.col("goal_dist") + F.lit(1e-6))) \
            .where(F.col("goal_dist").isNull() | (F.col("d0") + F.col("length_m") + geodesic_m("dlat", "dlon", "glat", "glon") * F.lit(straight)
                                                  <= F.col("goal_dist") + F.lit(1e-6))) \
            .select("request_id", F.col("dst").alias("node"), (F.col("d0") + F.col("length_m")).alias("dist"),
                    F.col("src").alias("pred"))
        best = cand.groupBy("request_id", "node").agg(F.min(F.struct("dist", "pred")).alias("b")) \
            .select("request_id", "node", F.col("b.dist").alias("dist"), F.col("b.pred").alias("pred"))
        cur = labels.select("request_id", "node", F.col("dist").alias("old"))
        improved = materialize(best.join(cur, ["request_id", "node"], "left")
                               .where(F.col("old").isNull() | (F.col("dist") < F.col("old"))).drop("old"), "sp-imp")
        if improved.isEmpty():
            break
        keep = labels.join(improved.select("request_id", "node"), ["request_id", "node"], "left_anti")
        labels = materialize(keep.unionByName(improved), "sp-lab")
        frontier = improved
    # back-walk by pointer doubling: ancestors of the goal at 1, 2, 4, ... hops
    anc = labels.select("request_id", "node", F.col("pred").alias("anc")).where(F.col("anc").isNotNull())
    reached = r.join(labels, (r["request_id"] == labels["request_id"]) & (r["goal_node"] == labels["node"])) \
        .select(r["request_id"], F.col("goal_node").alias("node"))
    reached = materialize(reached, "sp-path")
    step = materialize(anc, "sp-anc")
    while True:
        nxt = reached.join(step, ["request_id", "node"]).select("request_id", F.col("anc").alias("node"))
        grown = materialize(reached.unionByName(nxt).distinct(), "sp-path")
        if grown.count() == reached.count():
            reached = grown
            break
        reached = grown
        step = materialize(step.alias("a").join(step.alias("b"), (F.col("a.request_id") == F.col("b.request_id"))
                                                & (F.col("a.anc") == F.col("b.node")))
                           .select(F.col("a.request_id").alias("request_id"), F.col("a.node").alias("node"),
                                   F.col("b.anc").alias("anc")), "sp-anc")
    on_path = reached.join(labels, ["request_id", "node"]).join(
        nodes.select(F.col("node_id").alias("node"), "lon", "lat"), "node")
    path = on_path.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("dist", "node", "lon", "lat"))).alias("__p"),
        F.max("dist").alias("length_m"))
    out = r.select("request_id", "origin_node", "goal_node").join(path, "request_id", "left")
    return out.select("request_id", "origin_node", "goal_node", "length_m",
                      F.coalesce(F.transform("__p", lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))),
                                 F.array().cast("array<struct<lon:double,lat:double>>")).alias("path"))
