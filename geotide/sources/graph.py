"""Road graph input (A15): nodes and edges, limited to a bounding box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def graph_in_bbox(nodes: DataFrame, edges: DataFrame, south: float, west: float, north: float,
                  east: float) -> tuple[DataFrame, DataFrame]:
    """Nodes inside the box and the edges whose both ends are inside."""
    n = nodes.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    ids = n.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi") \
        .join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return n, e
