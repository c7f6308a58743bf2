"""Phone telemetry messages (A1, A2, K4).

A message is (topic, payload): topic ``client/<id>/session/<n>/`` and a JSON
payload with the session window and an array of points.  Parsing is
``split`` + ``from_json`` + ``explode``; it runs the same on a batch DataFrame
and on a Structured Streaming source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotide.functions.timefn import iso_format, lenient_ts

POINT_SCHEMA = T.StructType([
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()), T.StructField("speed", T.DoubleType()),
    T.StructField("activity", T.StringType()), T.StructField("timestamp", T.StringType())])

PAYLOAD_SCHEMA = T.StructType([
    T.StructField("start_time", T.StringType()), T.StructField("end_time", T.StringType()),
    T.StructField("trajectory", T.ArrayType(POINT_SCHEMA))])

MESSAGE_SCHEMA = T.StructType([T.StructField("topic", T.StringType()), T.StructField("payload", T.StringType())])


def telemetry_messages(trajectories: DataFrame, sessions: DataFrame) -> DataFrame:
    """Encode stored trajectories as telemetry messages (one per trajectory row)."""
    s = sessions.select(F.col("client_id").alias("__c"), F.col("session_id").alias("__s"), "start_time", "end_time")
    j = trajectories.join(s, (trajectories["client_id"] == s["__c"]) & (trajectories["session_id"] == s["__s"]))
    topic = F.format_string("client/%s/session/%s/", F.col("client_id"), F.col("session_id").cast("string"))
    payload = F.to_json(F.struct(iso_format(F.col("start_time")).alias("start_time"),
                                 iso_format(F.col("end_time")).alias("end_time"), F.col("trajectory")))
    return j.select(topic.alias("topic"), payload.alias("payload"))


def session_key(client, start) -> F.Column:
    """K4: session id as a pure function of (client, start_time)."""
    return F.xxhash64(client, start)


def telemetry_parse(messages: DataFrame, default_length: str | None = None) -> DataFrame:
    """A1: one row per valid message: client_id, session_id, start_time, end_time, trajectory.

    Messages with fewer than three topic parts or without both window bounds are dropped.  With
    ``default_length`` (such as '26 hours', T2) a missing end is the start plus that length.
    """
    parts = F.split(F.col("topic"), "/")
    p = messages.select(parts.alias("__parts"), F.from_json(F.col("payload"), PAYLOAD_SCHEMA).alias("__p"),
                        *[c for c in messages.columns if c not in ("topic", "payload")])
    p = p.where((F.size("__parts") >= 3)
                & F.coalesce(F.length(F.col("__p.start_time")) > 0, F.lit(False)))
    client = F.col("__parts").getItem(1)
    start = lenient_ts(F.col("__p.start_time"))
    end = lenient_ts(F.col("__p.end_time"))
    named = F.coalesce(F.length(F.col("__p.end_time")) > 0, F.lit(False))
    if default_length is None:
        p = p.where(named)
    else:
        end = F.when(named, end).otherwise(start + F.expr(f"INTERVAL {default_length}"))
    return p.select(client.alias("client_id"), session_key(client, start).alias("session_id"),
                    start.alias("start_time"), end.alias("end_time"),
                    F.col("__p.trajectory").alias("trajectory"),
                    *[c for c in p.columns if not c.startswith("__")])


def telemetry_sessions(parsed: DataFrame) -> DataFrame:
    """Sessions of the parsed messages, one per (client, start) (K1); of several ends the earliest wins."""
    return parsed.groupBy("session_id", "client_id", "start_time").agg(F.min("end_time").alias("end_time"))


def sessions_by_gap(points: DataFrame, gap: str) -> DataFrame:
    """Sessions of points without a named window: (client_id, start_time, end_time, n_points).

    A session goes on while the next point comes within ``gap``; its end is the last point plus the gap.
    """
    w = F.session_window(F.col("timestamp"), gap)
    g = points.where(F.col("timestamp").isNotNull()).groupBy("client_id", w).agg(F.count(F.lit(1)).alias("n_points"))
    return g.select("client_id", F.col("session_window.start").alias("start_time"), F.col("session_window.end").alias("end_time"), "n_points")


def telemetry_points(parsed: DataFrame, updated_at=None) -> DataFrame:
    """A2: one geodata row per point with lat, lon and a non-empty timestamp (not the text 'null')."""
    e = parsed.select("session_id", "client_id", F.explode("trajectory").alias("p"),
                      *[c for c in parsed.columns if c not in ("session_id", "client_id", "trajectory",
                                                               "start_time", "end_time")])
    ts = F.col("p.timestamp")
    e = e.where(F.col("p.lat").isNotNull() & F.col("p.lon").isNotNull() & ts.isNotNull()
                & (ts != "") & (ts != "null"))
    upd = updated_at if updated_at is not None else F.lit(None).cast("timestamp_ntz")
    return e.select("session_id", "client_id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"),
                    F.col("p.elevation").alias("elevation"), F.col("p.speed").alias("speed"),
                    F.col("p.activity").alias("activity"), lenient_ts(ts).alias("timestamp"),
                    upd.alias("updated_at"),
                    *[c for c in e.columns if c not in ("session_id", "client_id", "p")])
