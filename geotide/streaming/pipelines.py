"""Structured Streaming jobs.

Each polling loop becomes a streaming query with checkpointed progress, so a restarted or
re-scheduled job resumes exactly where it stopped.  State is kept by Spark, or in the stored
tables (``operators.stored``) that the stream maintains and whose rules do not depend on batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geotide.functions.timefn import ts_literal
from geotide.operators.behaviour import trajectory_build
from geotide.operators.latest import top_k_per_key
from geotide.operators.routing import DEVIATION_STREAKS_REQUIRED
from geotide.operators.stored import DAY, BatchLog, DayTable, remove
from geotide.operators.views import client_last_seen, still_active
from geotide.sources import gtfs_rt, telemetry

# Late-data horizons.
STREAK_IDLE = "26 hours"
DEFAULT_SESSION_LENGTH = "26 hours"
PUBLISH_DEDUP_HORIZON = "60 seconds"


def read_telemetry_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Telemetry messages (JSON lines of {topic, payload}) arriving as files in ``folder``."""
    return spark.readStream.schema(telemetry.MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files).json(folder)


def _drain(stream: DataFrame, batch, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True) \
        .start().awaitTermination()


SESSION_KEY = ("client_id", "start_time")
POINT_KEY = ("session_id", "timestamp", "lat", "lon")


def ingest_tables(spark: SparkSession, out: str) -> dict[str, DayTable]:
    """T1's tables: sessions by (client, start), the earliest end winning, and points by (session, time, place),
    of which the least by speed, activity and elevation wins.  Both rules hold for any order of arrival."""
    none = _ingested(spark.createDataFrame([], telemetry.MESSAGE_SCHEMA))
    return {"sessions": DayTable(spark, f"{out}/sessions", none["sessions"].schema, SESSION_KEY, "start_time", ["end_time"]),
            "points": DayTable(spark, f"{out}/points", none["points"].schema, POINT_KEY, "timestamp",
                               ["speed", "activity", "elevation"])}


def _ingested(messages: DataFrame, default_length: str | None = None) -> dict[str, DataFrame]:
    parsed = telemetry.telemetry_parse(messages, default_length)
    # the time of ingest is no part of the table: it would make a replay differ from its first run
    return {"sessions": telemetry.telemetry_sessions(parsed), "points": telemetry.telemetry_points(parsed).drop("updated_at")}


def stream_ingest(messages: DataFrame, out: str, checkpoint: str, default_length: str | None = None) -> dict[str, DayTable]:
    """T1 (+T2): sessions and points of a telemetry stream, into the tables of ``ingest_tables``.

    A micro-batch reads the keys of the days and buckets it touches and appends what beats them, so its
    cost follows the batch and not the history.  The winner of a key does not depend on the
    order of the files, their number per batch, replays, or what lies in one batch with what; no
    row is late.  With ``default_length`` (``DEFAULT_SESSION_LENGTH`` is the stored table's default) a
    message without an end opens a session of that length; without it such messages are dropped.
    """
    tables = ingest_tables(messages.sparkSession, out)

    def insert(batch: DataFrame, _: int) -> None:
        batch.persist()
        for name, df in _ingested(batch, default_length).items():
            tables[name].insert(df)
        batch.unpersist()

    _drain(messages, insert, checkpoint)
    return tables


MIGRATED_POINT = ["client_id", "session_id", "lat", "lon", "elevation", "speed", "activity", "timestamp", "start_time", "end_time"]


def stream_migrate(points: DataFrame, out: str, checkpoint: str, as_of) -> None:
    """One trigger of the migration: closed sessions (end_time <= ``as_of``) -> trajectories, into ``out``/log.

    ``points`` is a stream of session points with ``start_time`` and ``end_time``, the end being the
    session's.  New points go to the table of points, by day of the session's end.  Then the timer
    closes sessions, whether or not anything arrived: those whose end lies between the last trigger
    and this one, and closed ones that got further points, which are built again as a new version.
    Only the days on which such sessions end are read.  A trigger that failed leaves no commit, and the next one does its work.
    """
    spark = points.sparkSession
    schema = points.select(*MIGRATED_POINT).schema
    table = DayTable(spark, f"{out}/points", T.StructType([*schema.fields, T.StructField("run", T.LongType())]),
                     MIGRATED_POINT, "end_time")
    commits = "run long, as_of timestamp_ntz"
    spark.createDataFrame([], commits).write.mode("ignore").parquet(f"{out}/commits/run=none")
    last = spark.read.schema(commits).parquet(f"{out}/commits/*").agg(F.max(F.struct("run", "as_of")).alias("c")).select("c.*").first()
    run = (last["run"] or 0) + 1

    def arrive(batch: DataFrame, _: int) -> None:
        table.insert(batch.select(*MIGRATED_POINT, F.lit(run).cast("long").alias("run")).distinct())

    _drain(points, arrive, checkpoint)

    closed = F.col("end_time") <= ts_literal(as_of)
    due = F.col("run") == run
    if last["as_of"] is not None:
        due = due | (F.col("end_time") > ts_literal(last["as_of"]))
    # rows without a stored run before this one are all of this run; without one, all that is closed is due
    due_rows = table.raw().where(closed & (F.col(DAY) <= F.lit(as_of.date())))
    due_rows = due_rows.where(due) if last["as_of"] is not None else due_rows
    due_rows = due_rows.select("client_id", "session_id", DAY).distinct()
    days = [r[0] for r in due_rows.select(DAY).distinct().collect()]  # one row a day
    log = f"{out}/log/version={run}"
    whole = table.raw().where(F.col(DAY).isin([F.lit(d) for d in days]) if days else F.lit(False))
    same = [whole[c].eqNullSafe(due_rows[c]) for c in ("client_id", "session_id")]
    trajectory_build(whole.join(due_rows, same, "left_semi")).write.mode("overwrite").parquet(log)
    spark.createDataFrame([(run, as_of)], commits).coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/run={run}")


def migrated(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every migrated trajectory, of committed triggers only."""
    done = spark.read.schema("run long, as_of timestamp_ntz").parquet(f"{out}/commits/*").select(F.col("run").alias("version"))
    log = spark.read.parquet(f"{out}/log").withColumn("version", F.col("version").cast("long")).join(done, "version", "left_semi")
    return top_k_per_key(log, ["client_id", "session_id"], [F.col("version").desc()], 1, None).drop("version")


TICK_SCHEMA = T.StructType([T.StructField("client_id", T.StringType()),
                            T.StructField("tick_time", T.TimestampType()),
                            T.StructField("off_path", T.BooleanType())])
STREAK_SCHEMA = "client_id string, tick_time timestamp, off_path boolean, streak int, reroute boolean"
STREAK_STATE = "count int, last timestamp"


def _streaks(off, start: int):
    """Length of the run of off-path ticks that each tick ends, the run before them being ``start`` long."""
    nth = np.arange(1, len(off) + 1)
    reset = np.maximum.accumulate(np.where(off, 0, nth))
    return nth - reset + np.where(reset == 0, start, 0)


def _streak_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, last = state.get if state.exists else (0, None)
    parts = [p for p in pdfs if len(p)]
    if not parts:
        return
    ticks = pd.concat(parts).sort_values(["tick_time", "off_path"], kind="stable")  # all chunks, so in order across them
    time, off = ticks["tick_time"], ticks["off_path"].astype(bool).to_numpy()
    gap = time.diff()
    if last is not None:
        gap.iloc[0] = time.iloc[0] - pd.Timestamp(last)
    fresh = (gap > pd.Timedelta(STREAK_IDLE)).to_numpy()  # a client that was idle for so long starts anew
    streak = np.zeros(len(ticks), np.int64)
    begins = [*np.flatnonzero(fresh), len(ticks)]
    a = 0
    for b in begins:
        if b > a:
            streak[a:b] = _streaks(off[a:b], count)
        a, count = b, 0
    state.update((int(streak[-1]), time.max().to_pydatetime() if last is None else max(time.max(), pd.Timestamp(last)).to_pydatetime()))
    yield pd.DataFrame({"client_id": ticks["client_id"], "tick_time": time, "off_path": off, "streak": streak.astype("int32"),
                        "reroute": streak >= DEVIATION_STREAKS_REQUIRED})


def deviation_state(ticks: DataFrame) -> DataFrame:
    """T4: per-client consecutive off-path counter (state survives a reroute; an on-path tick resets it).

    ``ticks``: client_id, tick_time (timestamp), off_path.  State per client is a count and the newest tick.
    Ticks of one micro-batch count in order of time, however many chunks they come in; ticks of a later batch
    come after those of an earlier one.  There is no watermark, so no tick is dropped as late, and a gap of
    26 h between ticks starts anew.  State stays for every client seen: a timeout by event time would need
    the watermark that drops ticks, one by processing time keeps a stream over finished input running.
    """
    return ticks.groupBy("client_id").applyInPandasWithState(
        _streak_fn, STREAK_SCHEMA, STREAK_STATE, "append", GroupStateTimeout.NoTimeout)


def publish_dedup(results: DataFrame) -> DataFrame:
    """T5: each (client, session, created_at) published once within the freshness horizon."""
    return results.withColumn("event_time", F.col("created_at").cast("timestamp")) \
        .withWatermark("event_time", PUBLISH_DEDUP_HORIZON) \
        .dropDuplicatesWithinWatermark(["client_id", "session_id", "created_at"]).drop("event_time")


def publish_once(results: DataFrame, out: str, checkpoint: str) -> None:
    """T5: publish what a stream of results brings, each key once, as Parquet files in ``out``.

    A result that comes again, in the same batch, a later one or a later run on the same checkpoint, is
    not published again.  One that is older than the horizon behind the newest result seen
    before its batch is stale and not published at all, as its readers only ask for the last minute.
    """
    run_available_now(publish_dedup(results), out, checkpoint)


FEED_TABLES = ("vehicle_positions", "trip_updates", "service_alerts")


def read_feed_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Decoded GTFS-RT feeds (JSON lines {feed_json, read_at}) arriving as files."""
    schema = T.StructType([T.StructField("feed_json", T.StringType()), T.StructField("read_at", T.StringType())])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)
    return s.withColumn("read_at", F.col("read_at").cast("timestamp_ntz"))


def rt_feed_tables(feeds: DataFrame) -> dict[str, DataFrame]:
    """Vehicle positions, trip updates and alerts of a frame of feeds."""
    entities = gtfs_rt.decode_feeds(feeds)
    parsed = gtfs_rt.rt_vehicle_positions(entities), gtfs_rt.rt_trip_updates(entities), gtfs_rt.rt_service_alerts(entities)
    return dict(zip(FEED_TABLES, parsed))


def rt_feed_ingest(feeds: DataFrame, out: str, checkpoint: str) -> dict[str, DataFrame]:
    """One stream of feeds into three tables, each batch exactly once; returns the tables.

    The three tables of a micro-batch become visible together, by the mark of its id: one that failed
    half-way is not seen, and one that is replayed adds nothing.  A checkpoint belongs to one ``out``.
    Alerts are told apart by id (K1: the first of a table wins, all being equal but for the feed's time).
    """
    spark = feeds.sparkSession
    log = BatchLog(spark, out)

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        log.append(batch_id, rt_feed_tables(batch))
        batch.unpersist()

    _drain(feeds, take, checkpoint)
    none = spark.createDataFrame([], "feed_json string, read_at timestamp_ntz")
    tables = {name: log.read(name, df.schema) for name, df in rt_feed_tables(none).items()}
    tables["service_alerts"] = tables["service_alerts"].dropDuplicates(["alert_id"])
    return tables


LAST_SEEN = "client_id string, last_ts timestamp_ntz, last_seen timestamp_ntz"


def stream_last_seen(points: DataFrame, out: str, checkpoint: str, as_of) -> None:
    """Last point time and last update per client, kept up to date by a stream of points.

    The table has one row per client that was active within the window before ``as_of``: every
    micro-batch merges its maxima into the newest version, drops clients that have become idle, and
    writes the next version, named by the batch, so that a replay writes the same rows again.  The
    version before the newest one stays until the next batch, for a replay to start from.
    """
    spark = points.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        old = last_seen(spark, out, before=batch_id)
        now = client_last_seen(batch).select(*[F.col(c) for c in old.columns])
        both = old.unionByName(now).groupBy("client_id").agg(F.max("last_ts").alias("last_ts"), F.max("last_seen").alias("last_seen"))
        still_active(both, as_of).write.mode("overwrite").parquet(f"{out}/{_version(batch_id)}")
        for v in _versions(spark, out):
            if v < batch_id - 1:
                remove(spark, f"{out}/{_version(v)}")

    _drain(points, merge, checkpoint)


def _version(batch_id: int) -> str:
    return f"version={batch_id:012d}"


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Complete versions of the table; there are never more than three."""
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [f.getPath() for f in fs.listStatus(p) if f.getPath().getName().startswith("version=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.getName()[8:]) for n in names if fs.exists(done(n, "_SUCCESS")))


def last_seen(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The newest version of the last-seen table (older than a batch)."""
    known = [v for v in _versions(spark, out) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], LAST_SEEN)
    return spark.read.schema(LAST_SEEN).parquet(f"{out}/{_version(known[-1])}")


def live_active_clients(spark: SparkSession, out: str, as_of) -> DataFrame:
    """Clients with a point in the last 26 h or an update in the last 2 s before ``as_of``.

    Reads one row per client, whatever the history; idle clients leave as ``as_of`` moves on.
    """
    return still_active(last_seen(spark, out), as_of).select("client_id")


def run_available_now(df: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet") -> None:
    """Drive a streaming DataFrame over everything available, into a file sink, and wait."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .option("path", sink).trigger(availableNow=True).start())
    q.awaitTermination()


__all__ = ["read_telemetry_stream", "ingest_tables", "stream_ingest", "stream_migrate", "migrated", "deviation_state", "publish_dedup",
           "publish_once", "read_feed_stream", "rt_feed_tables", "rt_feed_ingest", "stream_last_seen", "last_seen",
           "live_active_clients", "run_available_now", "trajectory_build"]
