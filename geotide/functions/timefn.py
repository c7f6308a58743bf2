"""Time scalar functions (F5-F11) over zone-less timestamps (UTC by convention)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def ts_literal(value) -> Column:
    """A ``timestamp_ntz`` literal from a datetime or ISO text."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def seconds_between(later, earlier) -> Column:
    """``EXTRACT(EPOCH FROM later - earlier)`` as double seconds (F8)."""
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)) / F.lit(1e6)


def add_seconds(ts, secs) -> Column:
    """``ts + secs * INTERVAL '1 second'`` with microsecond rounding."""
    micros = F.round(_c(secs) * F.lit(1e6)).cast("long")
    return F.timestamp_add("MICROSECOND", micros, _c(ts))


def minus_interval(ts, spec: str) -> Column:
    return _c(ts) - F.expr(f"INTERVAL {spec}")


def plus_interval(ts, spec: str) -> Column:
    return _c(ts) + F.expr(f"INTERVAL {spec}")


def epoch_seconds(ts) -> Column:
    """Seconds since 1970-01-01 of a zone-less timestamp, as double."""
    return seconds_between(ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def epoch_to_ts(seconds) -> Column:
    """Unix seconds -> ``timestamp_ntz`` (UTC wall clock) (F7); independent of the session time zone."""
    return F.timestamp_add("SECOND", _c(seconds).cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def lenient_ts(text) -> Column:
    """Parse text to ``timestamp_ntz``; unparsable, empty or 'null' -> null."""
    t = F.trim(_c(text).cast("string"))
    return F.when((t == "") | (F.lower(t) == "null"), F.lit(None).cast("timestamp_ntz")) \
        .otherwise(t.try_cast("timestamp_ntz"))


def iso_format(ts) -> Column:
    """ISO-8601 text as Python's ``isoformat`` prints it."""
    c = _c(ts)
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def weekday_name(ts) -> Column:
    """Full English weekday name."""
    return F.date_format(_c(ts), "EEEE")


def hour_fraction(ts) -> Column:
    """Hour of day scaled to [0, 1] as ``hour / 23``."""
    return F.hour(_c(ts)) / F.lit(23.0)


def gtfs_clock_seconds(text) -> Column:
    """GTFS ``HH:MM:SS`` (hours may exceed 24) -> seconds after midnight; bad -> null."""
    parts = F.split(F.trim(_c(text)), ":")
    h = parts.getItem(0).try_cast("int")
    m = parts.getItem(1).try_cast("int")
    s = parts.getItem(2).try_cast("int")
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)
