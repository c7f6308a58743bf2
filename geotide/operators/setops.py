"""Set operations (U1-U7): tagged unions with null padding, distinct unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HISTORY_COLS = ["client_id", "stop_id", "origin_lat", "origin_lon", "destination_lat", "destination_lon",
                 "path", "segment_type", "is_chosen", "created_at"]


def routes_history(optimized: DataFrame, reroutes: DataFrame) -> DataFrame:
    """Optimized routes UNION ALL reroutes, tagged by ``source``, null-padded."""
    o = optimized.select(F.lit("optimized").alias("source"), *_HISTORY_COLS,
                         F.lit(None).cast("string").alias("reason"),
                         F.lit(None).cast("string").alias("previous_stop_id"),
                         F.lit(None).cast("string").alias("previous_segment_type"))
    r = reroutes.select(F.lit("reroute").alias("source"), *_HISTORY_COLS, "reason", "previous_stop_id",
                        "previous_segment_type")
    return o.unionByName(r)


def combined_pois(pois: DataFrame, predicted: DataFrame) -> DataFrame:
    """Detected POIs UNION ALL predicted visits (rank 0.5, type ``predicted_<kind>``)."""
    a = pois.select("client_id", "lat", "lon", F.col("poi_rank").cast("double").alias("poi_rank"),
                    F.lit(None).cast("float").alias("time_spent"), F.lit("stable").alias("poi_type"),
                    "created_at", F.lit(None).cast("timestamp_ntz").alias("predicted_visit_time"))
    b = predicted.select("client_id", F.col("predicted_lat").alias("lat"), F.col("predicted_lon").alias("lon"),
                         F.lit(0.5).alias("poi_rank"), F.lit(None).cast("float").alias("time_spent"),
                         F.concat(F.lit("predicted_"), F.col("prediction_type")).alias("poi_type"),
                         "created_at", "predicted_visit_time")
    return a.unionByName(b)


def routes_astar_mapf_unified(astar: DataFrame, mapf: DataFrame) -> DataFrame:
    """A* routes UNION ALL MAPF routes with method tag."""
    a = astar.select("client_id", "stop_id", "destination_lat", "destination_lon", "path",
                     F.col("distance").cast("double").alias("distance_meters"), "decision_context",
                     "predicted_eta", F.lit(True).alias("success"), F.lit("astar").alias("method"), "created_at")
    m = mapf.select("client_id", "stop_id", "destination_lat", "destination_lon", "path",
                    F.col("distance").cast("double").alias("distance_meters"), "decision_context",
                    F.lit(None).cast("timestamp_ntz").alias("predicted_eta"), "success",
                    F.lit("mapf").alias("method"), "created_at")
    return a.unionByName(m)


def daily_routing_summary(mapf: DataFrame, astar: DataFrame) -> DataFrame:
    """U4: UNION (distinct) of MAPF and A* destinations with method tag.

    ``distinct`` is a hash aggregate: partial (map-side) then final.
    """
    cols = ["client_id", "destination_lat", "destination_lon", "created_at"]
    m = mapf.select(*cols, F.lit("MAPF").alias("method"))
    a = astar.select(*cols, F.lit("A*").alias("method"))
    return m.unionByName(a).distinct()


def od_vectors(astar: DataFrame, mapf: DataFrame) -> DataFrame:
    """A* origins UNION (distinct) MAPF destinations as (lat, lon, timestamp)."""
    a = astar.where(F.col("origin_lat").isNotNull() & F.col("origin_lon").isNotNull()) \
        .select(F.col("origin_lat").alias("lat"), F.col("origin_lon").alias("lon"),
                F.col("created_at").alias("timestamp"))
    m = mapf.where(F.col("destination_lat").isNotNull() & F.col("destination_lon").isNotNull()) \
        .select(F.col("destination_lat").alias("lat"), F.col("destination_lon").alias("lon"),
                F.col("created_at").alias("timestamp"))
    return a.unionByName(m).distinct()


def hotspot_input(trajectory_points: DataFrame, pois: DataFrame) -> DataFrame:
    """Trajectory points UNION ALL POIs, tagged with their source type."""
    t = trajectory_points.select("client_id", "lat", "lon", F.lit("trajectory").alias("source_type"))
    p = pois.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()) \
        .select("client_id", "lat", "lon", F.lit("poi").alias("source_type"))
    return t.unionByName(p)
