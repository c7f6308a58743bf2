"""Static GTFS bundle reader.

Every member is read as text with an explicit schema (no inference), missing
columns are added as nulls, numbers are parsed leniently (``try_cast``) and
clipped to their ranges.  A missing member is skipped; the other tables still
load.
"""

from __future__ import annotations

import csv
import io
import itertools
import os
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotide.session import checkpoint_dir

# Required columns of each GTFS member, in order.
STOPS_COLS = ["stop_id", "stop_code", "stop_name", "stop_desc", "stop_lat", "stop_lon", "zone_id", "stop_url",
              "location_type", "parent_station", "stop_timezone", "wheelchair_boarding", "platform_code"]
ROUTES_COLS = ["route_id", "agency_id", "route_short_name", "route_long_name", "route_type", "route_desc"]
TRIPS_COLS = ["trip_id", "route_id", "service_id", "trip_headsign", "direction_id", "shape_id"]
STOP_TIMES_COLS = ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "stop_headsign",
                   "pickup_type", "drop_off_type", "shape_dist_traveled", "timepoint", "pickup_booking_rule_id",
                   "drop_off_booking_rule_id"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
CALENDAR_COLS = ["service_id", *WEEKDAYS, "start_date", "end_date"]
CALENDAR_DATES_COLS = ["service_id", "date", "exception_type"]
MEMBERS = {"stops.txt": "gtfs_stops", "routes.txt": "gtfs_routes", "trips.txt": "gtfs_trips",
           "stop_times.txt": "gtfs_stop_times", "calendar.txt": "gtfs_calendar",
           "calendar_dates.txt": "gtfs_calendar_dates"}


def _int_clip(c: str, lo: int, hi: int) -> Column:
    v = F.col(c).try_cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    # clipped as a double first: a number beyond the integer range must not fail the load
    return F.floor(F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(float(lo))), F.lit(float(hi)))).cast("int").alias(c)


def _num(c: str) -> Column:
    return F.col(c).try_cast("double").alias(c)


def _date(c: str) -> Column:
    return F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyyMMdd"))).alias(c)


def _conform(df: DataFrame, cols: list[str]) -> DataFrame:
    have = {c.strip().lstrip("\ufeff"): c for c in df.columns}  # a byte-order mark may lead the header
    return df.select(*[F.col(f"`{have[c]}`").cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c)
                       for c in cols])


def parse_stops(raw: DataFrame) -> DataFrame:
    d = _conform(raw, STOPS_COLS)
    return d.select("stop_id", "stop_code", "stop_name", "stop_desc", _num("stop_lat"), _num("stop_lon"), "zone_id",
                    "stop_url", _int_clip("location_type", 0, 255), "parent_station", "stop_timezone",
                    _int_clip("wheelchair_boarding", 0, 255), "platform_code")


def parse_routes(raw: DataFrame) -> DataFrame:
    d = _conform(raw, ROUTES_COLS)
    return d.select("route_id", "agency_id", "route_short_name", "route_long_name",
                    _int_clip("route_type", 0, 255), "route_desc")


def parse_trips(raw: DataFrame) -> DataFrame:
    d = _conform(raw, TRIPS_COLS)
    return d.select("trip_id", "route_id", "service_id", "trip_headsign", _int_clip("direction_id", 0, 1), "shape_id")


def parse_stop_times(raw: DataFrame) -> DataFrame:
    d = _conform(raw, STOP_TIMES_COLS)
    return d.select("trip_id", "arrival_time", "departure_time", "stop_id", _int_clip("stop_sequence", 0, 32767),
                    "stop_headsign", _int_clip("pickup_type", 0, 32767), _int_clip("drop_off_type", 0, 32767),
                    _num("shape_dist_traveled"), _int_clip("timepoint", 0, 32767), "pickup_booking_rule_id",
                    "drop_off_booking_rule_id")


def parse_calendar(raw: DataFrame) -> DataFrame:
    d = _conform(raw, CALENDAR_COLS)
    return d.select("service_id", *[_int_clip(w, 0, 1) for w in WEEKDAYS], _date("start_date"), _date("end_date"))


def parse_calendar_dates(raw: DataFrame) -> DataFrame:
    d = _conform(raw, CALENDAR_DATES_COLS)
    return d.select("service_id", _date("date"), _int_clip("exception_type", 1, 2))


PARSERS = {"gtfs_stops": parse_stops, "gtfs_routes": parse_routes, "gtfs_trips": parse_trips,
           "gtfs_stop_times": parse_stop_times, "gtfs_calendar": parse_calendar,
           "gtfs_calendar_dates": parse_calendar_dates}


def read_gtfs_bundle(spark: SparkSession, folder: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """The six members of an unzipped bundle folder as typed DataFrames (missing members skipped).

    Quoted fields that hold line ends need ``multi_line``, with which a file is read by one task."""
    out = {}
    for member, table in MEMBERS.items():
        path = os.path.join(folder, member)
        if not _exists(spark, path):
            continue
        raw = spark.read.option("header", "true").option("inferSchema", "false") \
            .option("quote", '"').option("escape", '"') \
            .option("multiLine", multi_line).csv(path)  # GTFS doubles quotes inside quotes
        out[table] = PARSERS[table](raw)
    return out


COLUMNS = {"gtfs_stops": STOPS_COLS, "gtfs_routes": ROUTES_COLS, "gtfs_trips": TRIPS_COLS, "gtfs_stop_times": STOP_TIMES_COLS,
           "gtfs_calendar": CALENDAR_COLS, "gtfs_calendar_dates": CALENDAR_DATES_COLS}
_BATCH = 8192


def _unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the known members of each archive, read as a stream; a row without fields says that the member is there."""
    csv.field_size_limit(1 << 30)
    for batch in batches:
        for content in batch.column(0):
            with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                for member in sorted(MEMBERS.keys() & set(z.namelist())):
                    table = MEMBERS[member]
                    yield pa.RecordBatch.from_arrays([pa.array([table]), pa.array([None], pa.list_(pa.string()))], names=["table", "f"])
                    # quoted fields may hold line ends, doubled quotes and commas; a byte-order mark may lead the header
                    rows = csv.reader(io.TextIOWrapper(z.open(member), encoding="utf-8-sig", errors="replace", newline=""))
                    header = [h.strip() for h in next(rows, [])]
                    at = [header.index(c) if c in header else None for c in COLUMNS[table]]
                    while part := list(itertools.islice(rows, _BATCH)):
                        f = [[r[k] or None if k is not None and k < len(r) else None for k in at] for r in part if r]
                        yield pa.RecordBatch.from_arrays([pa.array([table] * len(f), pa.string()), pa.array(f, pa.list_(pa.string()))], names=["table", "f"])


def read_gtfs_zip(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six members of one or more zipped bundles as typed DataFrames (missing members skipped).

    Archives are read by tasks, one each, and their rows go to a table in the shared folder, parted by
    member; the driver sees the members' names only.  ``path`` may be a file, a folder or a pattern.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")
    stage = f"{checkpoint_dir(spark).rstrip('/')}/gtfs-zip-{uuid.uuid4().hex}"
    raw.mapInArrow(_unzip, "table string, f array<string>").write.partitionBy("table").parquet(stage)
    rows = spark.read.schema("f array<string>, table string").parquet(stage)
    out = {}
    for (table,) in rows.where("f is null").select("table").distinct().collect():  # six names at most
        own = rows.where((F.col("table") == table) & F.col("f").isNotNull())
        out[table] = PARSERS[table](own.select(*[F.col("f")[k].alias(c) for k, c in enumerate(COLUMNS[table])]))
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_gtfs_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Write tables as a GTFS folder (one CSV directory per member, with header)."""
    inv = {v: k for k, v in MEMBERS.items()}
    for table, df in tables.items():
        df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"') \
            .csv(os.path.join(folder, inv[table]))
