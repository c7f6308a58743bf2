"""Equi, band, interval and as-of joins.

Spark has no native band or as-of join.  Both are written as an *equi* join on
(key, time bucket) plus an exact residual filter:

* the side with a single instant gets one bucket ``floor(t / B)``;
* the side with a range gets one row per bucket the range touches
  (``explode(sequence(lo, hi))``), i.e. ``1 + ceil(width / B)`` rows.

Each instant falls in exactly one bucket, so no pair is produced twice and no
de-duplication is needed.  The bucket spreads a hot key (a busy stop, a client
with a third of all rows) over many join keys, and AQE's skew-join splitting
handles what remains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotide.functions.timefn import add_seconds, seconds_between
from geotide.operators.latest import asc, desc, top_k_per_key


def epoch_micros(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def _bucket_of(ts, bucket_s: int) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(bucket_s * 1_000_000))


def _buckets_between(lo_ts: Column, hi_ts: Column, bucket_s: int) -> Column:
    b = F.lit(bucket_s * 1_000_000)
    return F.explode(F.sequence(F.floor(epoch_micros(lo_ts) / b), F.floor(epoch_micros(hi_ts) / b)))


def band_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_ts: str, right_ts: str,
              lo_s: float, hi_s: float, bucket_s: int | None = None) -> DataFrame:
    """Inner join where ``right_ts BETWEEN left_ts + lo_s AND left_ts + hi_s``.

    ``on`` lists (left column, right column) equality pairs.  The result keeps
    all columns of both sides (right-side names must not clash).
    """
    width = max(hi_s - lo_s, 1)
    b = int(bucket_s or max(int(width), 1))
    lt = F.col(left_ts)
    lb = left.withColumn("__bk", _buckets_between(add_seconds(lt, F.lit(float(lo_s))),
                                                  add_seconds(lt, F.lit(float(hi_s))), b))
    rb = right.withColumn("__bk_r", _bucket_of(right_ts, b))
    cond = [lb[lc] == rb[rc] for lc, rc in on]
    cond.append(lb["__bk"] == rb["__bk_r"])
    cond.append(rb[right_ts].between(add_seconds(lb[left_ts], F.lit(float(lo_s))),
                                     add_seconds(lb[left_ts], F.lit(float(hi_s)))))
    return lb.join(rb, cond, "inner").drop("__bk", "__bk_r")


def interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[tuple[str, str]], ts: str,
                  start: str, end: str, bucket_s: int = 3600, end_inclusive: bool = True) -> DataFrame:
    """Inner join of instants to the intervals containing them.

    ``start <= ts <= end`` (or ``< end`` when ``end_inclusive`` is False).  The
    interval side is exploded over the buckets it covers.
    """
    ib = intervals.withColumn("__bk_i", _buckets_between(F.col(start), F.col(end), bucket_s))
    pb = points.withColumn("__bk_p", _bucket_of(ts, bucket_s))
    cond = [pb[lc] == ib[rc] for lc, rc in on]
    cond.append(pb["__bk_p"] == ib["__bk_i"])
    cond.append(pb[ts] >= ib[start])
    cond.append(pb[ts] <= ib[end] if end_inclusive else pb[ts] < ib[end])
    return pb.join(ib, cond, "inner").drop("__bk_p", "__bk_i")


# ---------------------------------------------------------------------------
# Plain equi joins
# ---------------------------------------------------------------------------

def routing_candidates(astar: DataFrame, vehicle_arrivals: DataFrame, trip_updates: DataFrame) -> DataFrame:
    """A* routes with an ETA x vehicle arrivals at the stop x trip updates of the trip."""
    ar = astar.where(F.col("predicted_eta").isNotNull()).select("client_id", "stop_id", "predicted_eta")
    va = vehicle_arrivals.select(F.col("stop_id").alias("va_stop_id"), "trip_id", "route_id")
    tu = trip_updates.select(F.col("trip_id").alias("tu_trip_id"), "arrival_time", "departure_time",
                             "delay_seconds")
    j = ar.join(va, ar["stop_id"] == va["va_stop_id"]).join(tu, F.col("trip_id") == F.col("tu_trip_id"))
    return j.select("client_id", "stop_id", "predicted_eta", "trip_id", "route_id", "arrival_time",
                    "departure_time", "delay_seconds")


def static_gtfs_unified(stops: DataFrame, stop_times: DataFrame, trips: DataFrame,
                        routes: DataFrame) -> DataFrame:
    """Stops x stop_times x trips x routes (AQE broadcasts the small dimensions)."""
    s = stops.select(F.col("stop_id").alias("stop_point_id"), F.col("stop_name").alias("stop_point_name"),
                     "stop_lat", "stop_lon", "zone_id", "platform_code")
    st = stop_times.select(F.col("stop_id").alias("st_stop_id"), F.col("trip_id").alias("st_trip_id"),
                           "stop_sequence", "arrival_time", "departure_time")
    t = trips.select("trip_id", F.col("route_id").alias("t_route_id"), "direction_id")
    r = routes.select("route_id", "route_short_name", "route_long_name", "route_type")
    j = (s.join(st, s["stop_point_id"] == st["st_stop_id"])
         .join(t, st["st_trip_id"] == t["trip_id"])
         .join(r, t["t_route_id"] == r["route_id"]))
    return j.select("stop_point_id", "stop_point_name", "stop_lat", "stop_lon", "zone_id", "platform_code",
                    "route_id", "route_short_name", "route_long_name", "route_type", "trip_id",
                    "direction_id", "stop_sequence", "arrival_time", "departure_time")


# ---------------------------------------------------------------------------
# Band and as-of nearest
# ---------------------------------------------------------------------------

BOARDING_LO_S = 40
BOARDING_HI_S = 90
ETA_MATCH_WINDOW_S = 300


def departure_candidates(astar: DataFrame, trip_updates: DataFrame, trips: DataFrame,
                         lo_s: int = BOARDING_LO_S, hi_s: int = BOARDING_HI_S) -> DataFrame:
    """Stop-point routes x trip updates departing in [eta+40 s, eta+90 s] x trips."""
    ar = astar.where((F.col("target_type") == "stop_point") & F.col("predicted_eta").isNotNull()) \
        .select("client_id", "predicted_eta", "target_type", "stop_id", "parent_station", "decision_context")
    tu = trip_updates.select(F.col("trip_id").alias("tu_trip_id"), F.col("stop_id").alias("tu_stop_id"),
                             "departure_time", "arrival_time", "delay_seconds", "status")
    j = band_join(ar, tu, [("stop_id", "tu_stop_id")], "predicted_eta", "departure_time", lo_s, hi_s, bucket_s=60)
    gt = trips.select("trip_id", "route_id", "direction_id", "trip_headsign")
    j = j.join(gt, j["tu_trip_id"] == gt["trip_id"])
    return j.select("client_id", "predicted_eta", "target_type", "stop_id", "parent_station", "decision_context",
                    "trip_id", "departure_time", "arrival_time", "delay_seconds", "status",
                    "route_id", "direction_id", "trip_headsign")


def eta_accuracy(astar: DataFrame, trip_updates: DataFrame, window_s: int = ETA_MATCH_WINDOW_S) -> DataFrame:
    """Nearest departure (same stop, within +-window) to each predicted ETA.

    Ranking: smallest absolute gap, then earliest departure, then trip_id
    (total order, D18).  The per-(client, stop, eta) pick is an aggregation
    (``min`` of an ordered struct), which Spark combines map-side before the
    shuffle.  ``eta_error_seconds`` is departure - eta rounded to whole
    seconds (+ means the ETA was early).
    """
    eta = astar.where(F.col("predicted_eta").isNotNull()).select("client_id", "stop_id", "predicted_eta")
    tu = trip_updates.select(F.col("stop_id").alias("tu_stop_id"), "departure_time", "trip_id",
                             "delay_seconds", "status")
    j = band_join(eta, tu, [("stop_id", "tu_stop_id")], "predicted_eta", "departure_time",
                  -window_s, window_s, bucket_s=window_s)
    gap = F.timestamp_diff("MICROSECOND", F.col("predicted_eta"), F.col("departure_time"))
    best = j.groupBy("client_id", "stop_id", "predicted_eta").agg(
        F.min(F.struct(F.abs(gap).alias("abs_gap"), F.col("departure_time"), F.col("trip_id"),
                       gap.alias("gap"), F.col("delay_seconds"), F.col("status"))).alias("b"))
    return best.select(
        "client_id", "stop_id", F.col("b.trip_id").alias("trip_id"), "predicted_eta",
        F.col("b.departure_time").alias("departure_time"),
        F.coalesce(F.col("b.delay_seconds"), F.lit(0)).alias("delay_seconds"),
        F.col("b.status").alias("status"),
        F.round(F.col("b.gap") / F.lit(1e6)).cast("int").alias("eta_error_seconds"))


# ---------------------------------------------------------------------------
# J5 / J6 / J7 / J8
# ---------------------------------------------------------------------------

def session_asof(rows: DataFrame, sessions: DataFrame, row_keys: Sequence[str], ts: str = "created_at",
                 bucket_s: int = 3600) -> DataFrame:
    """Attach the latest session (start desc) with ``start <= ts < end`` of the same client.

    ``row_keys`` identify a row of ``rows``; rows without a session are dropped
    (inner, as the reference's lateral join).
    """
    s = sessions.select(F.col("client_id").alias("s_client_id"), F.col("session_id").alias("asof_session_id"),
                        F.col("start_time").alias("s_start"), F.col("end_time").alias("s_end"))
    j = interval_join(rows, s, [("client_id", "s_client_id")], ts, "s_start", "s_end",
                      bucket_s=bucket_s, end_inclusive=False)
    j = top_k_per_key(j, list(row_keys), [desc("s_start"), asc("asof_session_id")], 1, None)
    return j.drop("s_client_id", "s_start", "s_end")


def sessionize_by_window(geodata: DataFrame, sessions: DataFrame) -> DataFrame:
    """Points inside their own session's [start, end] window, with the window."""
    s = sessions.select(F.col("client_id").alias("s_client_id"), F.col("session_id").alias("s_session_id"),
                        "start_time", "end_time")
    j = geodata.join(s, (geodata["client_id"] == s["s_client_id"]) & (geodata["session_id"] == s["s_session_id"])
                     & geodata["timestamp"].between(s["start_time"], s["end_time"]))
    return j.drop("s_client_id", "s_session_id")


def latest_point(geodata: DataFrame) -> DataFrame:
    """Newest geodata row per client (timestamp, updated_at, id all descending)."""
    return top_k_per_key(geodata, ["client_id"], [desc("timestamp"), desc("updated_at"), desc("id")], 1, None)


def astar_eta(astar: DataFrame, geodata: DataFrame) -> DataFrame:
    """ETA = created_at + distance / current speed, when the speed is positive."""
    sp = latest_point(geodata).select(F.col("client_id").alias("g_client_id"), F.col("speed").alias("current_speed"))
    j = astar.join(sp, astar["client_id"] == sp["g_client_id"])
    return j.select(
        "client_id", "destination_lat", "destination_lon", F.col("distance").alias("route_distance"),
        "current_speed", "created_at",
        F.when(F.col("current_speed") > 0,
               add_seconds(F.col("created_at"), F.col("distance") / F.col("current_speed")))
         .alias("estimated_eta"))


def predicted_routes_schedule(predictions: DataFrame, mapf: DataFrame, astar: DataFrame, as_of,
                              sort: bool = True) -> DataFrame:
    """Future predictions with the MAPF route, else the A* route, to the same point (fan-out kept)."""
    from geotide.functions.timefn import ts_literal
    p = predictions.where(F.col("predicted_visit_time") >= ts_literal(as_of)).select(
        "client_id", "predicted_visit_time", "predicted_lat", "predicted_lon", "prediction_type")
    m = mapf.select(F.col("client_id").alias("m_client"), F.col("destination_lat").alias("m_lat"),
                    F.col("destination_lon").alias("m_lon"), F.col("path").alias("m_path"),
                    F.col("decision_context").alias("m_ctx"), F.col("created_at").alias("m_created"))
    a = astar.select(F.col("client_id").alias("a_client"), F.col("destination_lat").alias("a_lat"),
                     F.col("destination_lon").alias("a_lon"), F.col("path").alias("a_path"),
                     F.col("decision_context").alias("a_ctx"), F.col("created_at").alias("a_created"))
    j = p.join(m, (p["client_id"] == m["m_client"]) & (p["predicted_lat"] == m["m_lat"])
               & (p["predicted_lon"] == m["m_lon"]), "left")
    j = j.join(a, (j["client_id"] == a["a_client"]) & (j["predicted_lat"] == a["a_lat"])
               & (j["predicted_lon"] == a["a_lon"]), "left")
    out = j.select("client_id", "predicted_visit_time", "predicted_lat", "predicted_lon", "prediction_type",
                   F.coalesce("m_path", "a_path").alias("route_path"),
                   F.coalesce("m_ctx", "a_ctx").alias("decision_context"),
                   F.coalesce("m_created", "a_created").alias("route_created_at"))
    return out.orderBy("client_id", "predicted_visit_time") if sort else out


# ---------------------------------------------------------------------------
# J12 / J15 / J16 / J17
# ---------------------------------------------------------------------------

def referential_split(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent key exists (semi) and the orphans (anti)."""
    p = parent.select(*keys)
    return child.join(p, list(keys), "left_semi"), child.join(p, list(keys), "left_anti")


def latest_route_per_destination(routes: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Newest route per (client, destination[, extra keys]) (part of J15)."""
    keys = ["client_id", "destination_lat", "destination_lon", *extra_keys]
    tb = [c for c in ("id",) if c in routes.columns]
    return top_k_per_key(routes, keys, [desc("created_at")] + [desc(c) for c in tb], 1, None)


def client_target_route(targets: DataFrame, routes: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each client's target joined to the newest route ending exactly at it."""
    r = latest_route_per_destination(routes)
    r = r.select(*[F.col(c).alias(f"route_{c}") for c in r.columns])
    return targets.join(r, (targets["client_id"] == r["route_client_id"])
                        & (targets[lat] == r["route_destination_lat"])
                        & (targets[lon] == r["route_destination_lon"])).drop("route_client_id")


def switch_profile_lookup(df: DataFrame, profiles: DataFrame, default_s: int | None = None) -> DataFrame:
    """Left lookup of a client's average switch time at a stop."""
    p = profiles.select(F.col("client_id").alias("sp_client"), F.col("stop_id").alias("sp_stop"),
                        "avg_switch_seconds")
    j = df.join(p, (df["client_id"] == p["sp_client"]) & (df["stop_id"] == p["sp_stop"]), "left") \
        .drop("sp_client", "sp_stop")
    if default_s is not None:
        j = j.withColumn("avg_switch_seconds", F.coalesce("avg_switch_seconds", F.lit(default_s)))
    return j


def has_departure(routes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Routes for whose (client, stop) there is a departure candidate."""
    known = candidates.select(F.col("client_id").alias("__c"), F.col("stop_id").alias("__s"))
    return routes.join(known, (routes["client_id"] == known["__c"]) & (routes["stop_id"] == known["__s"]), "left_semi")
