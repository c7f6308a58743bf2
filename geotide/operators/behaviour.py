"""Behaviour derivation: trajectories, dwell, POIs.

All clients are processed in one job; the per-client loops of the reference
become keys of windows and aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotide.functions.timefn import iso_format, lenient_ts
from geotide.session import materialize

POINT_FIELDS = ("lat", "lon", "elevation", "speed", "activity")


def trajectory_build(points: DataFrame) -> DataFrame:
    """Per (client, session) the time-ordered array of point structs.

    ``points`` needs client_id, session_id and the point columns.  A session is
    bounded by its time window, and so is its array.  Points carry ISO-8601 text
    timestamps; ``created_at`` is the session's last point time, ``id`` the session id.
    """
    g = points.groupBy("client_id", "session_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("timestamp").alias("t"), *[F.col(c) for c in POINT_FIELDS])))
        .alias("pts"),
        F.max("timestamp").alias("created_at"))
    traj = F.transform(F.col("pts"), lambda s: F.struct(
        s["lat"].cast("double").alias("lat"), s["lon"].cast("double").alias("lon"),
        s["elevation"].cast("double").alias("elevation"), s["speed"].cast("double").alias("speed"),
        s["activity"].cast("string").alias("activity"), iso_format(s["t"]).alias("timestamp")))
    return g.select(F.col("session_id").alias("id"), "client_id", "session_id", traj.alias("trajectory"), "created_at")


def trajectory_points(trajectories: DataFrame) -> DataFrame:
    """One row per trajectory point with lat and lon present, timestamps parsed."""
    e = trajectories.select("client_id", "session_id", F.explode("trajectory").alias("p"))
    e = e.where(F.col("p.lat").isNotNull() & F.col("p.lon").isNotNull())
    return e.select("client_id", "session_id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"),
                    F.col("p.elevation").alias("elevation"), F.col("p.speed").alias("speed"),
                    F.col("p.activity").alias("activity"), lenient_ts(F.col("p.timestamp")).alias("timestamp"))


def dwell_time(points: DataFrame) -> DataFrame:
    """Time to the next point of the same session (0 for the last point).

    Adds ``next_time``, ``dwell_us`` (whole microseconds, exact) and
    ``time_spent`` (seconds).  The window is keyed by (client, session); a
    session is bounded by its time window, so no window group is unbounded.
    """
    w = Window.partitionBy("client_id", "session_id").orderBy(
        F.col("timestamp").asc(), F.col("lat").asc(), F.col("lon").asc(), F.col("speed").asc_nulls_last())
    nxt = F.lead("timestamp").over(w)
    us = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("timestamp"), F.col("next_time")), F.lit(0).cast("long"))
    return points.withColumn("next_time", nxt).withColumn("dwell_us", us) \
        .withColumn("time_spent", F.col("dwell_us") / F.lit(1e6))


# Fixed values of POI detection.
POI_MIN_DWELL_S = 590
POI_SPEED_THRESHOLD = 1.0


def detect_pois(points: DataFrame, min_time: float = POI_MIN_DWELL_S,
                speed_threshold: float = POI_SPEED_THRESHOLD) -> DataFrame:
    """B1: visits where the dwell exceeds ``min_time`` or the speed is below the threshold.

    ``poi_rank`` is the total dwell of all candidate visits of the client at
    the same exact coordinates (G10), summed in whole microseconds so the
    result does not depend on summation order.  Output is de-duplicated.
    """
    p = points.where(F.col("timestamp").isNotNull())
    p = dwell_time(p)
    cand = p.where((F.col("time_spent") > F.lit(float(min_time))) | (F.col("speed") < F.lit(float(speed_threshold))))
    # Written once (shared checkpoint folder) and read by both branches below, instead of
    # recomputing the sessionised dwell window for each.
    cand = materialize(cand.select("client_id", "lat", "lon", "timestamp", "dwell_us", "time_spent"), "poi-cand")
    # G10 as aggregate + join (map-side combined) rather than a window, so a
    # hot coordinate is summed partially before the shuffle.
    rank = cand.groupBy(F.col("client_id").alias("__c"), F.col("lat").alias("__la"),
                        F.col("lon").alias("__lo")).agg((F.sum("dwell_us") / F.lit(1e6)).alias("poi_rank"))
    cand = cand.join(rank, cand["client_id"].eqNullSafe(rank["__c"]) & cand["lat"].eqNullSafe(rank["__la"])
                     & cand["lon"].eqNullSafe(rank["__lo"]))
    out = cand.select(
        "client_id", "lat", "lon", "time_spent", "poi_rank",
        F.col("timestamp").alias("poi_created_at"), F.col("timestamp").alias("visit_start"),
        F.timestamp_add("MICROSECOND", F.col("dwell_us"), F.col("timestamp")).alias("visit_end"),
        F.col("time_spent").cast("long").alias("duration_seconds"))
    return out.distinct()


def distinct_clients(df: DataFrame) -> DataFrame:
    """Distinct client ids."""
    return df.select("client_id").distinct()


def poi_count(pois: DataFrame) -> DataFrame:
    """Number of POIs per client."""
    return pois.groupBy("client_id").agg(F.count(F.lit(1)).alias("poi_count"))


def poi_rank(pois: DataFrame) -> DataFrame:
    """Total dwell per (client, lat, lon), kept on every row."""
    return pois.withColumn("poi_rank", F.sum("time_spent").over(Window.partitionBy("client_id", "lat", "lon")))


DEFAULT_MEDIAN_DWELL_S = 1800.0


def median_dwell(pois: DataFrame) -> DataFrame:
    """Exact median dwell per client, 1800 s when all are null."""
    return pois.groupBy("client_id").agg(
        F.coalesce(F.median("time_spent"), F.lit(DEFAULT_MEDIAN_DWELL_S)).alias("median_dwell"))
