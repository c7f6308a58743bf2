"""Logical mobility tables bound onto the driver's Parquet tables.

The driver ships TPC-H-like tables plus an ``events`` stream.  These bindings
map them onto the mobility data model (FIXTURES.md §2) with plain projections
and one aggregation, so every downstream operator runs on real, scaling
input.  Each binding is a lazy DataFrame; column pruning and predicate
pushdown reach the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotide.functions.geo import LINE_TYPE, make_point

# Reference time of every time-relative view in the fixtures.
AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)

#: Telemetry points of a task that builds trajectories.
POINTS_PER_TASK = 50_000

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _lit_d(x: float) -> Column:
    return F.lit(float(x))


def _client() -> Column:
    return F.col("user_id").cast("string")


def _stop() -> Column:
    """Eight users share a stop, so stops grow with the users and the rows of one stop do not."""
    return F.expr("user_id div 8").cast("string")


def _route() -> Column:
    return F.expr("event_id div 5").cast("string")


def _dest_lat() -> Column:
    return _lit_d(59.3) + (F.col("user_id") % 10) * _lit_d(1e-2) + (F.col("event_id") % 5) * _lit_d(5e-4)


def _dest_lon() -> Column:
    return _lit_d(18.0) + (F.col("user_id") % 7) * _lit_d(1e-2) + (F.col("event_id") % 3) * _lit_d(5e-4)


def _line(olon, olat, dlon, dlat) -> Column:
    return F.array(make_point(olon, olat), make_point(dlon, dlat)).cast(LINE_TYPE)


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


class MobilityTables:
    """Lazy logical tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # geotide's time model: zone-less timestamps in UTC (differences never cross a DST jump)
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- telemetry -----------------------------------------------------------
    @cached_property
    def geodata(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"),
            _client().alias("client_id"),
            _dest_lat().alias("lat"), _dest_lon().alias("lon"),
            F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 64) * _lit_d(0.25)).alias("elevation"),
            (F.col("value") / _lit_d(40.0)).alias("speed"),
            # spellings as phones send them
            F.when(F.col("event_type") == "click", F.lit("Walking")).when(F.col("event_type") == "view", F.lit(" bus "))
             .when(F.col("event_type") == "signup", F.lit("idle")).otherwise(F.col("event_type")).alias("activity"),
            F.col("ts").alias("timestamp"),
            (F.col("ts") + F.expr("INTERVAL 3 SECONDS")).alias("updated_at"))

    @cached_property
    def mqtt_sessions(self) -> DataFrame:
        e = self.raw("events")
        g = e.groupBy("user_id", F.dayofmonth("ts").alias("d")).agg(F.min("ts").alias("start_time"))
        return g.select(
            (F.col("user_id") * 100 + F.col("d")).alias("session_id"),
            _client().alias("client_id"),
            F.col("start_time"),
            (F.col("start_time") + F.expr("INTERVAL 6 HOURS")).alias("end_time"))

    @cached_property
    def trajectories(self) -> DataFrame:
        from geotide.operators.behaviour import trajectory_build
        from geotide.operators.joins import sessionize_by_window
        # tasks grow in number with the points, not in size: they sort and gather whole sessions
        n, by = -(-self.raw("events").count() // POINTS_PER_TASK) or 1, ["client_id", "session_id"]
        pts = sessionize_by_window(self.geodata.repartition(n, *by), self.mqtt_sessions.repartition(n, *by))
        return trajectory_build(pts)

    # -- GTFS static -----------------------------------------------------------
    @cached_property
    def gtfs_stops(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(
            F.col("s_suppkey").cast("string").alias("stop_id"),
            _null("string").alias("stop_code"),
            F.col("s_name").alias("stop_name"),
            _null("string").alias("stop_desc"),
            (_lit_d(59.3) + (F.col("s_suppkey") % 23) * _lit_d(4e-3)).alias("stop_lat"),
            (_lit_d(18.0) + (F.col("s_suppkey") % 19) * _lit_d(4e-3)).alias("stop_lon"),
            F.col("s_nationkey").cast("string").alias("zone_id"),
            _null("string").alias("stop_url"),
            F.lit(0).alias("location_type"),
            _null("string").alias("parent_station"),
            _null("string").alias("stop_timezone"),
            F.lit(0).alias("wheelchair_boarding"),
            _null("string").alias("platform_code"))

    @cached_property
    def gtfs_routes(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").cast("string").alias("route_id"),
            _null("string").alias("agency_id"),
            F.col("p_brand").alias("route_short_name"),
            F.col("p_name").alias("route_long_name"),
            (F.col("p_size") % 6).alias("route_type"),
            _null("string").alias("route_desc"))

    def _transit_events(self) -> DataFrame:
        return self.raw("events").where(F.col("event_type").isin("purchase", "signup"))

    @cached_property
    def gtfs_trips(self) -> DataFrame:
        return self._transit_events().select(
            F.col("event_id").cast("string").alias("trip_id"),
            _route().alias("route_id"),
            F.dayofmonth("ts").cast("string").alias("service_id"),
            F.col("event_type").alias("trip_headsign"),
            (F.col("event_id") % 2).alias("direction_id"),
            _null("string").alias("shape_id"))

    @cached_property
    def gtfs_stop_times(self) -> DataFrame:
        e = self._transit_events()
        first = e.select(F.col("event_id").cast("string").alias("trip_id"),
                         _stop().alias("stop_id"), F.lit(1).alias("stop_sequence"))
        second = e.select(F.col("event_id").cast("string").alias("trip_id"),
                          F.expr("(user_id + 8) div 8").cast("string").alias("stop_id"),
                          F.lit(2).alias("stop_sequence"))
        return first.unionByName(second).select(
            "trip_id", _null("string").alias("arrival_time"), _null("string").alias("departure_time"),
            "stop_id", "stop_sequence")

    @cached_property
    def gtfs_calendar(self) -> DataFrame:
        """One service per day of the month: the weekdays it ran on, its first and last date, as bundle text."""
        e = self._transit_events().select(F.dayofmonth("ts").cast("string").alias("service_id"), F.weekday("ts").alias("w"), "ts")
        days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
        return e.groupBy("service_id").agg(*[F.max((F.col("w") == k).cast("int")).cast("string").alias(d) for k, d in enumerate(days)],
                                           F.date_format(F.min("ts"), "yyyyMMdd").alias("start_date"), F.date_format(F.max("ts"), "yyyyMMdd").alias("end_date"))

    @cached_property
    def gtfs_calendar_dates(self) -> DataFrame:
        """Exceptions: a service is added (1) or, where errors were many, dropped (an unknown code beyond 2)."""
        e = self.raw("events").where(F.col("event_type") == "error")
        g = e.groupBy(F.dayofmonth("ts").cast("string").alias("service_id"), F.date_format("ts", "yyyyMMdd").alias("date"))
        return g.agg(F.count(F.lit(1)).cast("string").alias("exception_type"))

    # -- GTFS realtime ---------------------------------------------------------
    @cached_property
    def trip_updates(self) -> DataFrame:
        return self._transit_events().select(
            F.col("event_id").cast("string").alias("trip_id"),
            _stop().alias("stop_id"),
            (F.col("ts") - F.expr("INTERVAL 30 SECONDS")).alias("arrival_time"),
            F.col("ts").alias("departure_time"),
            F.when(F.col("event_id") % 4 == 0, _null("int"))
             .otherwise(F.floor("value").cast("int")).alias("delay_seconds"),
            F.lit("SCHEDULED").alias("status"),
            F.col("ts").alias("created_at"))

    @cached_property
    def vehicle_arrivals(self) -> DataFrame:
        return self.raw("events").where(F.col("event_type") == "purchase").select(
            _client().alias("vehicle_id"),
            F.col("event_id").cast("string").alias("trip_id"),
            _route().alias("route_id"),
            _stop().alias("stop_id"),
            (_lit_d(59.3) + (F.col("event_id") % 5) * _lit_d(5e-4)).alias("position_lat"),
            (_lit_d(18.0) + (F.col("event_id") % 3) * _lit_d(5e-4)).alias("position_lon"),
            F.col("ts").alias("timestamp"))

    @cached_property
    def alerts(self) -> DataFrame:
        """What a feed says of a disturbance: of route, stop or neither, some without texts or an end."""
        m = F.col("event_id") % 3
        return self.raw("events").where(F.col("event_type") == "error").select(
            F.col("event_id").cast("string").alias("alert_key"),
            F.when(m == 0, _null("string")).otherwise(F.lit("CONSTRUCTION")).alias("cause"),
            F.when(m == 1, _null("string")).otherwise(F.lit("DETOUR")).alias("effect"),
            F.concat(F.lit("Disturbance "), F.col("event_id").cast("string")).alias("header_text"),
            F.when(m == 2, _null("string")).otherwise(F.concat(F.lit("near stop "), _stop())).alias("description_text"),
            F.when(m == 0, _route()).when(m == 1, F.lit("")).alias("route_id"),
            F.when(m != 2, _stop()).alias("stop_id"),
            F.col("ts").alias("start_time"),
            F.when(m != 0, F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end_time"))

    # -- routes ----------------------------------------------------------------
    @cached_property
    def astar_routes(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type").isin("click", "view"))
        return e.select(
            F.col("event_id").alias("id"),
            _client().alias("client_id"),
            # one in fifty heads for a stop that the timetable does not know
            F.when(F.col("event_id") % 50 == 7, F.concat(F.lit("temporary "), _stop())).otherwise(_stop()).alias("stop_id"),
            _null("string").alias("parent_station"),
            F.when(F.col("event_id") % 2 == 0, F.lit("stop_point")).otherwise(F.lit("poi")).alias("target_type"),
            _null("long").alias("poi_id"),
            _lit_d(59.3).alias("origin_lat"), _lit_d(18.0).alias("origin_lon"),
            _dest_lat().alias("destination_lat"), _dest_lon().alias("destination_lon"),
            _line(_lit_d(18.0), _lit_d(59.3), _dest_lon(), _dest_lat()).alias("path"),
            (F.col("value") * _lit_d(20.0)).alias("distance"),
            _null("double").alias("efficiency_score"),
            F.lit("initial_prediction").alias("decision_context"),
            F.when(F.col("event_id") % 11 == 0, _null("timestamp_ntz"))
             .otherwise(F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("predicted_eta"),
            F.col("ts").alias("created_at"))

    @cached_property
    def mapf_routes(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "error")
        return e.select(
            F.col("event_id").alias("id"),
            _client().alias("client_id"),
            _stop().alias("stop_id"),
            _dest_lat().alias("destination_lat"), _dest_lon().alias("destination_lon"),
            _line(_lit_d(18.0), _lit_d(59.3), _dest_lon(), _dest_lat()).alias("path"),
            (F.col("value") * _lit_d(20.0)).alias("distance"),
            (F.col("event_id") % 10 != 0).alias("success"),
            F.lit("mapf_predicted").alias("decision_context"),
            F.col("ts").alias("created_at"))

    @cached_property
    def optimized_routes(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "view")
        m3 = F.col("event_id") % 3
        return e.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"),
            _client().alias("client_id"),
            F.when(m3 == 0, _null("string")).otherwise(_stop()).alias("stop_id"),
            _lit_d(59.3).alias("origin_lat"), _lit_d(18.0).alias("origin_lon"),
            _dest_lat().alias("destination_lat"), _dest_lon().alias("destination_lon"),
            _line(_lit_d(18.0), _lit_d(59.3), _dest_lon(), _dest_lat()).alias("path"),
            F.when(m3 == 0, F.lit("direct")).when(m3 == 1, F.lit("multimodal"))
             .otherwise(F.lit("fallback")).alias("segment_type"),
            F.col("ts").alias("created_at"),
            (F.col("event_id") % 13 != 0).alias("is_valid"),
            (F.col("event_id") % 2 == 0).alias("is_chosen"))

    @cached_property
    def reroutes(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "error")
        return e.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("session_id"),
            _client().alias("client_id"),
            _stop().alias("stop_id"),
            _lit_d(59.3).alias("origin_lat"), _lit_d(18.0).alias("origin_lon"),
            _dest_lat().alias("destination_lat"), _dest_lon().alias("destination_lon"),
            _line(_lit_d(18.0), _lit_d(59.3), _dest_lon(), _dest_lat()).alias("path"),
            F.lit("multimodal").alias("segment_type"),
            F.lit("departure_passed").alias("reason"),
            _null("string").alias("previous_stop_id"),
            _null("string").alias("previous_segment_type"),
            F.lit(True).alias("is_chosen"),
            F.col("ts").alias("created_at"))

    # -- behaviour tables ------------------------------------------------------
    @cached_property
    def predicted_pois_sequence(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "signup")
        return e.select(
            F.col("event_id").alias("id"),
            _client().alias("client_id"),
            _dest_lat().alias("predicted_lat"), _dest_lon().alias("predicted_lon"),
            (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("predicted_visit_time"),
            F.when(F.col("event_id") % 2 == 0, F.lit("daily")).otherwise(F.lit("weekly")).alias("prediction_type"),
            _null("double").alias("poi_rank"),
            _null("double").alias("time_spent"),
            F.col("ts").alias("created_at"))

    @cached_property
    def pois(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "purchase")
        return e.select(
            F.col("event_id").alias("poi_id"),
            _client().alias("client_id"),
            _dest_lat().alias("lat"), _dest_lon().alias("lon"),
            (F.col("value") * _lit_d(60.0)).alias("time_spent"),
            F.col("value").alias("poi_rank"),
            _null("string").alias("source"),
            F.col("ts").alias("visit_start"),
            F.lit(0).alias("visit_count"),
            F.col("ts").alias("created_at"))

    @cached_property
    def user_patterns(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "click")
        return e.select(
            F.col("event_id").alias("pattern_id"),
            _client().alias("client_id"),
            _dest_lat().alias("lat"), _dest_lon().alias("lon"),
            _null("string").alias("pattern_type"),
            F.col("ts").alias("timestamp"))

    @cached_property
    def hotspots(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "purchase")
        key = [_client().alias("client_id"), _dest_lat().alias("lat"), _dest_lon().alias("lon")]
        g = e.groupBy(*key).agg(F.min("event_id").alias("hotspot_id"), F.max("value").alias("radius"), F.count(F.lit(1)).cast("double").alias("density"),
                                F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        return g.select("hotspot_id", "client_id", "lat", "lon", "radius", "density", F.lit("hotspot").alias("type"),
                        _null("double").alias("time_spent"), F.lit("trajectory").alias("source_type"), "created_at", "updated_at")

    @cached_property
    def client_switch_profiles(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("client_id"), F.expr("c_custkey div 8").cast("string").alias("stop_id"),
            (F.floor(F.abs("c_acctbal")).cast("int") % 240).alias("avg_switch_seconds"))


def tables(spark: SparkSession, sf_dir: str) -> MobilityTables:
    return MobilityTables(spark, sf_dir)
