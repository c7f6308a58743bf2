"""GTFS-realtime feeds.

The core parsers take *decoded* feeds: the protobuf message rendered as JSON
(the standard protobuf JSON mapping), parsed with ``from_json``.  With the
spark-protobuf package and a compiled descriptor, ``from_protobuf`` yields
the same struct and the same parsers apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotide.functions.timefn import epoch_to_ts, ts_literal

_L, _S, _D, _I = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()


def _st(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TRIP = _st(trip_id=_S, route_id=_S)
_EVENT = _st(time=_S, delay=_S)  # 64-bit integers may come as strings
_TRANSLATED = _st(translation=T.ArrayType(_st(text=_S, language=_S)))
ENTITY_SCHEMA = _st(
    id=_S,
    vehicle=_st(vehicle=_st(id=_S), trip=_TRIP, stop_id=_S, timestamp=_S,
                position=_st(latitude=_D, longitude=_D, speed=_D, bearing=_D)),
    trip_update=_st(trip=_TRIP, stop_time_update=T.ArrayType(_st(
        stop_id=_S, arrival=_EVENT, departure=_EVENT, schedule_relationship=_S))),
    alert=_st(cause=_S, effect=_S, header_text=_TRANSLATED, description_text=_TRANSLATED,
              informed_entity=T.ArrayType(_st(route_id=_S, stop_id=_S, trip=_TRIP)),
              active_period=T.ArrayType(_st(start=_S, end=_S))))
FEED_SCHEMA = _st(header=_st(timestamp=_S), entity=T.ArrayType(ENTITY_SCHEMA))

# Fields that the protobuf JSON mapping spells in camel case.
CAMEL_FIELDS = ("tripUpdate", "stopTimeUpdate", "tripId", "routeId", "stopId", "scheduleRelationship", "headerText",
                "descriptionText", "informedEntity", "activePeriod")


def _snake(text: Column) -> Column:
    """Field names in the original (snake) spelling; both spellings are valid protobuf JSON."""
    for name in CAMEL_FIELDS:
        snake = "".join("_" + c.lower() if c.isupper() else c for c in name)
        text = F.regexp_replace(text, f'"{name}"(\\s*:)', f'"{snake}"$1')
    return text


def _seconds(c: Column) -> Column:
    return epoch_to_ts(c.try_cast("long"))


def decode_feeds(feeds: DataFrame, json_col: str = "feed_json", read_ts: str = "read_at") -> DataFrame:
    """One row per feed entity: ``e`` (entity struct) and the feed read time."""
    f = feeds.select(F.from_json(_snake(F.col(json_col)), FEED_SCHEMA).alias("__f"), F.col(read_ts).alias("read_at"))
    return f.select(F.explode("__f.entity").alias("e"), "read_at")


def rt_vehicle_positions(entities: DataFrame) -> DataFrame:
    """A3: one row per entity with a vehicle; timestamp defaults to the feed read time."""
    v = entities.where(F.col("e.vehicle").isNotNull())
    ts = F.col("e.vehicle.timestamp")
    return v.select(F.col("e.vehicle.vehicle.id").alias("vehicle_id"), F.col("e.vehicle.trip.trip_id").alias("trip_id"),
                    F.col("e.vehicle.trip.route_id").alias("route_id"), F.col("e.vehicle.stop_id").alias("stop_id"),
                    F.col("e.vehicle.position.latitude").alias("position_lat"),
                    F.col("e.vehicle.position.longitude").alias("position_lon"),
                    F.col("e.vehicle.position.speed").alias("speed"),
                    F.col("e.vehicle.position.bearing").alias("bearing"),
                    F.coalesce(_seconds(ts), F.col("read_at")).alias("timestamp"),
                    F.col("read_at").alias("created_at"))


def rt_trip_updates(entities: DataFrame) -> DataFrame:
    """A4: one row per stop-time update; delay is the *arrival* delay; status defaults to SCHEDULED."""
    t = entities.where(F.col("e.trip_update").isNotNull()).select(
        F.col("e.trip_update.trip.trip_id").alias("trip_id"),
        F.explode("e.trip_update.stop_time_update").alias("u"), "read_at")
    return t.select("trip_id", F.col("u.stop_id").alias("stop_id"),
                    _seconds(F.col("u.arrival.time")).alias("arrival_time"),
                    _seconds(F.col("u.departure.time")).alias("departure_time"),
                    F.col("u.arrival.delay").try_cast("int").alias("delay_seconds"),
                    F.coalesce(F.col("u.schedule_relationship"), F.lit("SCHEDULED")).alias("status"),
                    F.col("read_at").alias("created_at"))


def _first_text(c: Column) -> Column:
    return F.coalesce(F.element_at(c["translation"], 1)["text"], F.lit(""))


def rt_service_alerts(entities: DataFrame) -> DataFrame:
    """A5: one row per informed entity; first translation or ''; affected = route, stop, trip or
    'unknown'; first active period; id = sha256(header-desc-affected-read time)."""
    a = entities.where(F.col("e.alert").isNotNull()).select(
        F.col("e.alert").alias("a"), F.explode("e.alert.informed_entity").alias("ie"), "read_at")
    header, desc = _first_text(F.col("a.header_text")), _first_text(F.col("a.description_text"))
    nz = lambda c: F.when(F.length(c) > 0, c)
    affected = F.coalesce(nz(F.col("ie.route_id")), nz(F.col("ie.stop_id")), nz(F.col("ie.trip.trip_id")),
                          F.lit("unknown"))
    period = F.element_at(F.col("a.active_period"), 1)
    iso = F.date_format(F.col("read_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return a.select(F.sha2(F.concat_ws("-", header, desc, affected, iso), 256).alias("alert_id"),
                    F.coalesce(F.col("a.cause"), F.lit("UNKNOWN_CAUSE")).alias("cause"),
                    F.coalesce(F.col("a.effect"), F.lit("UNKNOWN_EFFECT")).alias("effect"),
                    header.alias("header_text"), desc.alias("description_text"), affected.alias("affected_entity"),
                    _seconds(period["start"]).alias("start_time"), _seconds(period["end"]).alias("end_time"),
                    F.col("read_at").alias("created_at"))


def trip_update_feeds(trip_updates: DataFrame, read_at) -> DataFrame:
    """Encode trip-update rows as single-entity decoded feeds (JSON text), one per row."""
    unix = lambda c: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    ent = F.struct(F.col("trip_id").alias("id"), F.struct(
        F.struct(F.col("trip_id").alias("trip_id")).alias("trip"),
        F.array(F.struct(F.col("stop_id").alias("stop_id"),
                         F.struct(unix(F.col("arrival_time")).alias("time"),
                                  F.col("delay_seconds").alias("delay")).alias("arrival"),
                         F.struct(unix(F.col("departure_time")).alias("time")).alias("departure"),
                         F.col("status").alias("schedule_relationship"))).alias("stop_time_update"))
        .alias("trip_update"))
    feed = F.struct(F.struct(unix(ts_literal(read_at)).alias("timestamp")).alias("header"),
                    F.array(ent).alias("entity"))
    return trip_updates.select(F.to_json(feed).alias("feed_json"), ts_literal(read_at).alias("read_at"))


def _unix_text(c: Column) -> Column:
    """Seconds since 1970 as text, as the JSON mapping writes 64-bit integers."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("string")


def _feed(entity: Column, read_at) -> list[Column]:
    feed = F.struct(F.struct(_unix_text(ts_literal(read_at)).alias("timestamp")).alias("header"), F.array(entity).alias("entity"))
    return [F.to_json(feed).alias("feed_json"), ts_literal(read_at).alias("read_at")]


def vehicle_feeds(vehicles: DataFrame, read_at) -> DataFrame:
    """Encode vehicle rows as single-entity decoded feeds in the camel-case spelling."""
    place = F.struct(F.col("position_lat").alias("latitude"), F.col("position_lon").alias("longitude"))
    v = F.struct(F.struct(F.col("vehicle_id").alias("id")).alias("vehicle"),
                 F.struct(F.col("trip_id").alias("tripId"), F.col("route_id").alias("routeId")).alias("trip"),
                 F.col("stop_id").alias("stopId"), _unix_text(F.col("timestamp")).alias("timestamp"), place.alias("position"))
    return vehicles.select(*_feed(F.struct(F.col("trip_id").alias("id"), v.alias("vehicle")), read_at))


def alert_feeds(alerts: DataFrame, read_at) -> DataFrame:
    """Encode alerts (cause, effect, header_text, description_text, route_id, stop_id, start_time, end_time)
    as single-entity decoded feeds; null texts and bounds are left out."""
    text = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.array(F.struct(F.col(c).alias("text"))).alias("translation")))
    a = F.struct("cause", "effect", text("header_text").alias("headerText"), text("description_text").alias("descriptionText"),
                 F.array(F.struct(F.col("route_id").alias("routeId"), F.col("stop_id").alias("stopId"))).alias("informedEntity"),
                 F.array(F.struct(_unix_text(F.col("start_time")).alias("start"), _unix_text(F.col("end_time")).alias("end"))).alias("activePeriod"))
    return alerts.select(*_feed(F.struct(F.col("alert_key").alias("id"), a.alias("alert")), read_at))
