"""Registered queries: each view/operator applied to the bound driver tables.

Every entry is ``fn(spark, sf_dir) -> DataFrame`` over whole tables.  Array
columns (paths, trajectories) are summarised by their size in the registered
outputs so they can be compared value by value; the library functions return
them whole.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotide.operators import views
from geotide.sources.bindings import AS_OF, MobilityTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(MobilityTables(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


def _newest(df: DataFrame, column: str):
    """A reference time inside the data: the newest value of a column (AS_OF if there is none)."""
    return df.agg(F.max(column)).first()[0] or AS_OF


def _no_path(df: DataFrame, *cols: str) -> DataFrame:
    cols = cols or ("path",)
    return df.drop(*[c for c in cols if c in df.columns])


# ---------------------------------------------------------------- views -----

@query("routing_candidates_gtfsrt")
def q_routing_candidates(t: MobilityTables):
    return views.routing_candidates_gtfsrt(t.astar_routes, t.vehicle_arrivals, t.trip_updates)


@query("lines")
def q_lines(t):
    return views.lines(t.gtfs_routes)


@query("static_gtfs_unified")
def q_static_gtfs_unified(t):
    return views.static_gtfs_unified(t.gtfs_stops, t.gtfs_stop_times, t.gtfs_trips, t.gtfs_routes)


@query("active_clients_geodata")
def q_active_clients(t):
    return views.active_clients_geodata(t.geodata, AS_OF)


@query("current_session_id_from_geodata")
def q_current_session(t):
    return views.current_session_id_from_geodata(t.geodata)


@query("astar_eta")
def q_astar_eta(t):
    return views.astar_eta(t.astar_routes, t.geodata)


@query("top_daily_poi")
def q_top_daily_poi(t):
    return views.top_daily_poi(t.predicted_pois_sequence)


@query("combined_pois")
def q_combined_pois(t):
    return views.combined_pois(t.pois, t.predicted_pois_sequence)


@query("hotspots_heatmap")
def q_hotspots_heatmap(t):
    return views.hotspots_heatmap(t.hotspots)


@query("latest_client_trajectories")
def q_latest_client_trajectories(t):
    df = views.latest_client_trajectories(t.trajectories)
    return df.withColumn("n_points", F.size("trajectory")).drop("trajectory")


@query("departure_candidates")
def q_departure_candidates(t):
    return views.departure_candidates(t.astar_routes, t.trip_updates, t.gtfs_trips)


@query("predicted_routes_schedule")
def q_predicted_routes_schedule(t):
    df = views.predicted_routes_schedule(t.predicted_pois_sequence, t.mapf_routes, t.astar_routes, AS_OF)
    return df.withColumn("route_points", F.size("route_path")).drop("route_path")


@query("hotspot_overlay")
def q_hotspot_overlay(t):
    return views.hotspot_overlay(t.hotspots, t.gtfs_stops, AS_OF)


@query("daily_routing_summary")
def q_daily_routing_summary(t):
    return views.daily_routing_summary(t.mapf_routes, t.astar_routes)


@query("mapf_active_routes")
def q_mapf_active_routes(t):
    return _no_path(views.mapf_active_routes(t.mapf_routes, AS_OF))


@query("routes_history")
def q_routes_history(t):
    return _no_path(views.routes_history(t.optimized_routes, t.reroutes))


@query("routes_unified_latest")
def q_routes_unified_latest(t):
    return _no_path(views.routes_unified_latest(views.routes_history(t.optimized_routes, t.reroutes)))


@query("routes_live")
def q_routes_live(t):
    return _no_path(views.routes_live(views.routes_history(t.optimized_routes, t.reroutes)))


@query("routes_unified")
def q_routes_unified(t):
    return _no_path(views.routes_unified(t.optimized_routes, t.reroutes))


@query("pois_nearest_stop")
def q_pois_nearest_stop(t):
    return views.pois_nearest_stop(t.pois, t.gtfs_stops)


@query("pois_stops_within_300m")
def q_pois_stops_within_300m(t):
    return views.pois_stops_within_300m(t.pois, t.gtfs_stops)


@query("latest_client_routes")
def q_latest_client_routes(t):
    return _no_path(views.latest_client_routes(views.routes_history(t.optimized_routes, t.reroutes)))


@query("routes_astar_mapf_unified")
def q_routes_astar_mapf_unified(t):
    return _no_path(views.routes_astar_mapf_unified(t.astar_routes, t.mapf_routes))


@query("routes_astar_mapf_latest")
def q_routes_astar_mapf_latest(t):
    u = views.routes_astar_mapf_unified(t.astar_routes, t.mapf_routes)
    return _no_path(views.routes_astar_mapf_latest(u))


@query("eta_accuracy_seconds")
def q_eta_accuracy(t):
    return views.eta_accuracy_seconds(t.astar_routes, t.trip_updates)


@query("boarding_window_hit_rate")
def q_boarding_window_hit_rate(t):
    c = views.departure_candidates(t.astar_routes, t.trip_updates, t.gtfs_trips)
    return views.boarding_window_hit_rate(c, _newest(c, "departure_time"))


@query("geodata_latest_point")
def q_geodata_latest_point(t):
    return views.geodata_latest_point(t.geodata).drop("geom")


@query("stop_usage_7d")
def q_stop_usage_7d(t):
    return views.stop_usage_7d(views.routes_history(t.optimized_routes, t.reroutes), AS_OF)


@query("predicted_poi_nearest_stop")
def q_predicted_poi_nearest_stop(t):
    return views.predicted_poi_nearest_stop(t.predicted_pois_sequence, t.gtfs_stops)


@query("next_feasible_departure_per_client")
def q_next_feasible_departure(t):
    c = views.departure_candidates(t.astar_routes, t.trip_updates, t.gtfs_trips)
    return views.next_feasible_departure_per_client(c, AS_OF - _dt.timedelta(days=15))


# ------------------------------------------------------------ behaviour -----

def _session_points(t: MobilityTables) -> DataFrame:
    from geotide.operators.joins import sessionize_by_window
    return sessionize_by_window(t.geodata, t.mqtt_sessions)


@query("detect_pois")
def q_detect_pois(t):
    """B1 over the points inside their session windows (what trajectories hold)."""
    from geotide.operators.behaviour import detect_pois
    return detect_pois(_session_points(t))


@query("detect_hotspots")
def q_detect_hotspots(t):
    """B5 over trajectory points UNION ALL POIs.

    The trajectory points are the session-window points (J6): exactly what
    exploding the trajectories yields (``trajectory_points``, checked equal by
    the ``trajectory_points`` oracle), without rebuilding and re-parsing the
    arrays; a stored trajectories table would be read with nested-column pruning.
    """
    from geotide.operators.clustering import detect_hotspots
    from geotide.operators.setops import hotspot_input
    h = detect_hotspots(hotspot_input(_session_points(t), t.pois))
    return h.select("client_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"),
                    F.round("radius", 6).alias("radius"), "density", "type", "source_type")


# ------------------------------------------------- aggregates / windows -----

from geotide.operators import behaviour as _bh  # noqa: E402
from geotide.operators import joins as _jn  # noqa: E402
from geotide.operators import predictions as _pr  # noqa: E402
from geotide.operators import routing as _rt  # noqa: E402
from geotide.operators import setops as _so  # noqa: E402
from geotide.operators import spatial as _sp  # noqa: E402


def _candidates(t):
    return views.departure_candidates(t.astar_routes, t.trip_updates, t.gtfs_trips)


def _history(t):
    return views.routes_history(t.optimized_routes, t.reroutes)


@query("client_last_seen")
def q_client_last_seen(t):
    """G1."""
    return views.client_last_seen(t.geodata)


@query("route_usage_ratios")
def q_route_usage_ratios(t):
    """G4."""
    return _rt.route_usage_ratios(t.optimized_routes)


@query("favourite_routes")
def q_favourite_routes(t):
    """G6 over the departure candidates."""
    return _rt.favourite_routes(_candidates(t))


@query("distinct_clients")
def q_distinct_clients(t):
    """G8."""
    return _bh.distinct_clients(t.geodata)


@query("recent_clients")
def q_recent_clients(t):
    """Clients among the latest trajectories."""
    return _bh.distinct_clients(views.latest_client_trajectories(t.trajectories))


@query("poi_count")
def q_poi_count(t):
    """G9."""
    return _bh.poi_count(t.pois)


@query("poi_rank_total")
def q_poi_rank_total(t):
    """Total dwell per (client, lat, lon) on every POI row."""
    return _bh.poi_rank(t.pois).select("poi_id", "client_id", "lat", "lon",
                                       F.round("poi_rank", 6).alias("poi_rank_total"))


@query("median_dwell")
def q_median_dwell(t):
    """G11."""
    return _bh.median_dwell(t.pois).select("client_id", F.round("median_dwell", 6).alias("median_dwell"))


@query("best_target_poi")
def q_best_target_poi(t):
    """L2 over the combined POIs."""
    return _rt.best_target_poi(views.combined_pois(t.pois, t.predicted_pois_sequence), AS_OF)


@query("best_departure")
def q_best_departure(t):
    """L3 over the departure candidates."""
    return _rt.best_departure(_candidates(t))


@query("latest_speed")
def q_latest_speed(t):
    """L5."""
    return _rt.latest_speed(t.geodata)


@query("od_vectors")
def q_od_vectors(t):
    """U5."""
    return _so.od_vectors(t.astar_routes, t.mapf_routes)


@query("hotspot_input")
def q_hotspot_input(t):
    """Trajectory points UNION ALL POIs."""
    return _so.hotspot_input(_bh.trajectory_points(t.trajectories), t.pois)


@query("trajectory_points")
def q_trajectory_points(t):
    """All trajectory points (G7 then explode)."""
    return _bh.trajectory_points(t.trajectories)


@query("route_sessions")
def q_route_sessions(t):
    """Valid optimized routes and reroutes with their as-of session."""
    cols = ["client_id", "stop_id", "destination_lat", "destination_lon", "segment_type", "created_at"]
    o = t.optimized_routes.where(F.col("is_valid")).select(*cols, F.lit(0).alias("src"), "id")
    r = t.reroutes.select(*cols, F.lit(1).alias("src"), "id")
    return _jn.session_asof(o.unionByName(r), t.mqtt_sessions, ["src", "id"]) \
        .withColumnRenamed("asof_session_id", "session_id")


@query("session_points")
def q_session_points(t):
    """J6."""
    return _jn.sessionize_by_window(t.geodata, t.mqtt_sessions).select(
        "id", "session_id", "client_id", "timestamp", "start_time", "end_time")


@query("trip_updates_with_trip")
def q_trip_updates_with_trip(t):
    """J12 (semi): trip updates whose trip is known."""
    return _jn.referential_split(t.trip_updates, t.gtfs_trips, ["trip_id"])[0]


@query("astar_routes_unknown_stop")
def q_astar_routes_unknown_stop(t):
    """J12 (anti): A* routes whose stop is not a known stop."""
    return _no_path(_jn.referential_split(t.astar_routes, t.gtfs_stops, ["stop_id"])[1])


@query("pattern_proximity")
def q_pattern_proximity(t):
    """J14."""
    return _sp.pattern_proximity(t.pois, t.user_patterns).select("poi_id", "client_id", "pattern_matches",
                                                                  "pattern_weight")


@query("poi_match")
def q_poi_match(t):
    """Each pattern with the client's closest own POI within 30 m."""
    return _sp.poi_match(t.user_patterns, t.pois, ["pattern_id"]).select("pattern_id", "client_id",
                                                                         "matched_poi_id")


@query("client_target_route")
def q_client_target_route(t):
    """Each client's best target with the newest unified route ending there."""
    tgt = _rt.best_target_poi(views.combined_pois(t.pois, t.predicted_pois_sequence), AS_OF) \
        .select("client_id", "lat", "lon")
    j = _jn.client_target_route(tgt, views.routes_unified(t.optimized_routes, t.reroutes))
    return j.select("client_id", "lat", "lon", "route_stop_id", "route_segment_type", "route_created_at")


@query("switch_profile_lookup")
def q_switch_profile_lookup(t):
    """J16."""
    return _jn.switch_profile_lookup(_candidates(t), t.client_switch_profiles) \
        .select("client_id", "stop_id", "trip_id", "predicted_eta", "avg_switch_seconds")


@query("has_departure")
def q_has_departure(t):
    """Multimodal optimized routes whose (client, stop) has a departure candidate."""
    return _no_path(_jn.has_departure(t.optimized_routes.where(F.col("segment_type") == "multimodal"), _candidates(t)))


@query("dwell_time")
def q_dwell_time(t):
    """W6 over the session points."""
    return _bh.dwell_time(_session_points(t)).select("id", "client_id", "session_id", "timestamp", "time_spent")


@query("score_pois")
def q_score_pois(t):
    """B2 (daily decay)."""
    return _pr.score_pois(t.pois, t.user_patterns, AS_OF, "daily").select(
        "poi_id", "client_id", F.round("poi_score", 6).alias("poi_score"))


@query("visit_clock")
def q_visit_clock(t):
    """Predicted visit times of the scored sequence."""
    s = _pr.visit_clock(_pr.score_pois(t.pois, t.user_patterns, AS_OF, "daily"), AS_OF)
    return s.select("poi_id", "client_id", "seq", "predicted_visit_time")


@query("predict_visits")
def q_predict_visits(t):
    """B3 (daily)."""
    p = _pr.predict_visits(t.pois, t.user_patterns, AS_OF, "daily")
    return p.select("client_id", F.round("predicted_lat", 9).alias("predicted_lat"),
                    F.round("predicted_lon", 9).alias("predicted_lon"), "predicted_visit_time", "prediction_type",
                    "created_at")


@query("consecutive_legs")
def q_consecutive_legs(t):
    """Consecutive weekly predictions per (client, weekday)."""
    from geotide.functions.timefn import weekday_name
    p = t.predicted_pois_sequence.where(F.col("prediction_type") == "weekly").select(
        "client_id", "id", F.col("predicted_lat").alias("lat"), F.col("predicted_lon").alias("lon"),
        F.col("predicted_visit_time").alias("ts")).withColumn("visit_day", weekday_name(F.col("ts")))
    return _rt.consecutive_legs(p.withColumn("ord", F.struct("ts", "id")), ["client_id", "visit_day"], "ord") \
        .drop("ord")


def _targets(t):
    return _rt.best_target_poi(views.combined_pois(t.pois, t.predicted_pois_sequence), AS_OF) \
        .select("client_id", "lat", "lon")


def _choice(t):
    return _rt.choose_route(_targets(t), t.astar_routes, t.mapf_routes, _candidates(t), t.client_switch_profiles,
                            t.optimized_routes, t.geodata, AS_OF)


@query("choose_route")
def q_choose_route(t):
    """B12 (heuristic path; the model path needs a scores frame, V1)."""
    return _choice(t).withColumn("path_points", F.size("path")).drop("path")


def _scored_inputs(t):
    """Targets are the destinations of the newest multimodal routes; departures within the hour after arrival count."""
    m = t.mapf_routes.where("success").groupBy("client_id").agg(F.max(F.struct("created_at", "id", "destination_lat", "destination_lon")).alias("m"))
    targets = m.select("client_id", F.col("m.destination_lat").alias("lat"), F.col("m.destination_lon").alias("lon"))
    return targets, _jn.departure_candidates(t.astar_routes, t.trip_updates, t.gtfs_trips, 0, 3600)


def _stepwise(astar, mapf):
    """A fixed scorer for the registered queries: the difference in distance, in quarters."""
    import numpy as np
    return 0.5 + 0.5 * np.floor((astar[:, 0] - mapf[:, 0]) * 4 + 0.5) / 4


@query("candidate_scores")
def q_candidate_scores(t):
    """B10, V1 and B11 for every client with both kinds of route to its target."""
    newest = lambda df, name: df.groupBy("client_id", "destination_lat", "destination_lon").agg(
        F.max(F.struct("created_at", "id", "distance")).alias("r")).select(
            "client_id", F.col("destination_lat").alias("lat"), F.col("destination_lon").alias("lon"), F.col("r.distance").alias(name))
    targets, _ = _scored_inputs(t)
    on = ["client_id", "lat", "lon"]
    pairs = targets.join(newest(t.astar_routes.where("target_type = 'poi'"), "astar_dist"), on).join(newest(t.mapf_routes.where("success"), "mapf_dist"), on)
    f = _rt.route_features(pairs, t.optimized_routes, t.geodata, AS_OF)
    s = _rt.route_scores(pairs, t.optimized_routes, t.geodata, AS_OF, _stepwise)
    j = f.join(s, "client_id")
    b = _rt.blend_scores(F.col("score_astar"), F.col("score_mapf"), F.col("astar")[4].cast("double"), F.col("astar")[5].cast("double"), F.lit(False))
    names = ("distance", "multimodal", "hour", "speed", "astar_ratio", "mapf_ratio")
    return j.select("client_id", *[F.round(F.col("mapf")[k].cast("double"), 5).alias(f"f_{n}") for k, n in enumerate(names)],
                    "score_astar", "score_mapf", F.round(b["p_astar"], 5).alias("p_astar"), F.round(b["p_mapf"], 5).alias("p_mapf"))


@query("choose_route_scored")
def q_choose_route_scored(t):
    """B12 with a scorer: every branch occurs, the scored one with ties broken by delay and switch time."""
    targets, cand = _scored_inputs(t)
    c = _rt.choose_route(targets, t.astar_routes, t.mapf_routes, cand, t.client_switch_profiles, t.optimized_routes, t.geodata, AS_OF,
                         scorer=_stepwise)
    return c.select("client_id", "stop_id", "destination_lat", "destination_lon", "segment_type", "decision_branch",
                    F.size("path").alias("path_points"))


@query("reroute_reasons")
def q_reroute_reasons(t):
    """B13 for the newest chosen route of every active client, with the streak of its last tick."""
    return _reasons(t).withColumn("deviation_m", F.round("deviation_m", 3))


def _current_choice(t):
    from geotide.operators.latest import top_k_per_key
    return top_k_per_key(t.optimized_routes.where("is_chosen"), ["client_id"],
                         [F.col("created_at").desc_nulls_last(), F.col("id").desc_nulls_last()], 1, None)


def _streaks(t):
    active = views.active_clients_geodata(t.geodata, AS_OF)
    ticks = t.geodata.join(active.select("client_id"), "client_id", "left_semi").select(
        "id", "client_id", F.col("timestamp").alias("tick_time"), "lat", "lon")
    return _rt.deviation_streaks(ticks, _current_choice(t))


def _reasons(t):
    active = views.active_clients_geodata(t.geodata, AS_OF)
    pos = _rt.latest_locations(t.geodata, AS_OF).join(active.select("client_id"), "client_id", "left_semi")
    last = _streaks(t).groupBy("client_id").agg(F.max(F.struct("tick_time", "lat", "lon", "id", "streak")).alias("m")) \
        .select("client_id", F.col("m.streak").alias("streak"))
    return _rt.reroute_reasons(_current_choice(t), pos, _candidates(t), AS_OF, last)


@query("deviation_streaks")
def q_deviation_streaks(t):
    """Ticks of the active clients against their chosen route."""
    return _streaks(t).select("id", "client_id", "tick_time", "lat", "lon", F.round("deviation_m", 3).alias("deviation_m"),
                              "off_path", F.col("streak").cast("long").alias("streak"))


@query("reroute_events")
def q_reroute_events(t):
    """Live route before vs the new decision, for clients with a reroute reason."""
    live = views.routes_live(_history(t))
    reasons = _reasons(t).where(F.col("reason").isNotNull())
    ev = _rt.reroute_events(live, _choice(t), reasons)
    return ev.withColumn("path_points", F.size("path")).drop("path")


def _weekly(t):
    clients = _bh.distinct_clients(views.latest_client_trajectories(t.trajectories))
    return _rt.weekly_schedule(t.predicted_pois_sequence, views.routes_unified(t.optimized_routes, t.reroutes),
                               clients, "weekly")


@query("weekly_schedule")
def q_weekly_schedule(t):
    """B15."""
    return _weekly(t).withColumn("path_points", F.size("path")).drop("path", "id")


@query("client_weekly_schedule_enriched")
def q_weekly_enriched(t):
    """J18 over the B15 schedule."""
    return views.client_weekly_schedule_enriched(_weekly(t), t.gtfs_stops).drop("path", "id")


@query("fresh_results")
def q_fresh_results(t):
    """B16 as of the newest route that lies in a session."""
    newest = _newest(q_route_sessions(t), "created_at")
    return _no_path(_rt.fresh_results(t.optimized_routes, t.reroutes, t.mqtt_sessions, newest))


@query("publish_payloads")
def q_publish_payloads(t):
    """K9 + T5 over all routes (the 60 s freshness filter is B16's)."""
    cols = ["client_id", "stop_id", "destination_lat", "destination_lon", "path", "segment_type", "created_at"]
    o = t.optimized_routes.where(F.col("is_valid")).select(*cols, F.lit(0).alias("src"), "id")
    r = t.reroutes.select(*cols, F.lit(1).alias("src"), "id")
    res = _jn.session_asof(o.unionByName(r), t.mqtt_sessions, ["src", "id"]) \
        .withColumnRenamed("asof_session_id", "session_id")
    return _rt.publish_payloads(res)


@query("multimodal_candidates")
def q_multimodal_candidates(t):
    """B9 for the active clients."""
    act = views.active_clients_geodata(t.geodata, AS_OF)
    m = _rt.multimodal_candidates(act, t.astar_routes, AS_OF)
    return m.withColumn("distance", F.round("distance", 3)).drop("path")


@query("route_candidates")
def q_route_candidates(t):
    """B7 for every settled client."""
    pos = _rt.latest_locations(t.geodata, AS_OF)
    best = _rt.best_target_poi(views.combined_pois(t.pois, t.predicted_pois_sequence), AS_OF)
    return _rt.route_candidates(pos, best, t.pois, t.gtfs_stops)


# --------------------------------------------------------------- writes -----

from geotide.operators import writes as _wr  # noqa: E402


@query("retention_kept_astar")
def q_retention_kept_astar(t):
    """K6: A* routes kept by the 28-day TTL."""
    return _no_path(_wr.retention_ttl(t.astar_routes, AS_OF)[0])


@query("poi_arrival_update")
def q_poi_arrival_update(t):
    """K7: POI table after recording the arrivals detected by B1."""
    return _wr.poi_arrival_update(t.pois, _bh.detect_pois(_session_points(t)))


@query("validated_astar")
def q_validated_astar(t):
    """A* rows passing not-null and enum checks."""
    return _no_path(_wr.validate_astar(t.astar_routes)[0])


@query("upsert_hotspots")
def q_upsert_hotspots(t):
    """K2: stored hotspots merged with a fresh B5 detection."""
    from geotide.operators.clustering import detect_hotspots
    new = detect_hotspots(_so.hotspot_input(_bh.trajectory_points(t.trajectories), t.pois))
    return _wr.upsert_hotspots(t.hotspots, new, AS_OF)


@query("upsert_chosen_route")
def q_upsert_chosen_route(t):
    """K3: optimized routes merged with this round's decisions."""
    return _no_path(_wr.upsert_chosen_route(t.optimized_routes, _choice(t), AS_OF))


@query("upsert_hotspot_places")
def q_upsert_hotspot_places(t):
    """K2: stored hotspots merged with the places of clicks: known places are replaced, others come in, the rest stays."""
    key = ["client_id", "lat", "lon"]
    new = t.user_patterns.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(
        *key, (F.col("n") * 10.0).alias("radius"), F.col("n").cast("double").alias("density"), F.lit("place").alias("type"), F.lit("poi").alias("source_type"))
    known = t.hotspots.select(*key, F.lit(True).alias("known"))
    out = _wr.upsert_hotspots(t.hotspots, new, AS_OF).join(known, key, "left")
    # ids of new rows are hashes
    return out.withColumn("hotspot_id", F.when(F.col("known"), F.col("hotspot_id"))).drop("known", "time_spent")


@query("publish_payload_fields")
def q_publish_payload_fields(t):
    """K9 + F17: topic and payload read back: JSON fields, and the printed line parsed again."""
    from geotide.functions.geo import parse_wkt_linestring
    from geotide.functions.timefn import lenient_ts
    cols = ["client_id", "stop_id", "destination_lat", "destination_lon", "path", "segment_type", "created_at"]
    o = t.optimized_routes.where("is_valid").select(*cols, F.lit(0).alias("src"), "id")
    r = t.reroutes.select(*cols, F.lit(1).alias("src"), "id")
    res = _jn.session_asof(o.unionByName(r), t.mqtt_sessions, ["src", "id"]).withColumnRenamed("asof_session_id", "session_id")
    p = F.from_json("payload", "client_id string, session_id long, stop_id string, destination struct<lat:double,lon:double>, route_path string, timestamp string")
    f = _rt.publish_payloads(res).select("topic", p.alias("p"))
    line = parse_wkt_linestring(F.col("p.route_path"))
    return f.select("topic", "p.client_id", "p.session_id", "p.stop_id", F.col("p.destination.lat").alias("lat"), F.col("p.destination.lon").alias("lon"),
                    F.size(line).alias("points"), line[1]["lat"].alias("end_lat"), line[1]["lon"].alias("end_lon"),
                    lenient_ts(F.col("p.timestamp")).alias("created_at"))


@query("line_centroids")
def q_line_centroids(t):
    """length-weighted centroid of every session's line."""
    from geotide.functions.geo import LINE_TYPE, line_centroid
    path = F.transform("trajectory", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).cast(LINE_TYPE)
    c = t.trajectories.select("client_id", "session_id", line_centroid(path).alias("c"))
    return c.select("client_id", "session_id", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"))


@query("request_boxes")
def q_request_boxes(t):
    """buffered box around origin and destination of every route request."""
    from geotide.functions.geo import bbox
    return t.astar_routes.select("id", bbox("origin_lat", "origin_lon", "destination_lat", "destination_lon").alias("b")).select("id", "b.*")


@query("day_paths")
def q_day_paths(t):
    """A client's routes of a day joined into one line, as a digest of its vertices."""
    seg = t.astar_routes.select("client_id", F.dayofmonth("created_at").alias("day"), F.col("id").alias("pos"), "path")
    j = _rt.path_concat(seg, ["client_id", "day"])
    unit = F.lit(1e6)
    text = F.array_join(F.transform("path", lambda v: F.concat_ws(" ", F.round(v["lon"] * unit).cast("long").cast("string"),
                                                                  F.round(v["lat"] * unit).cast("long").cast("string"))), ",")
    return j.select("client_id", "day", F.size("path").alias("points"), F.md5(text).alias("path_md5"))


# -------------------------------------------------------------- sources -----

from geotide.sources import gtfs as _gtfs  # noqa: E402
from geotide.sources import gtfs_rt as _rtf  # noqa: E402
from geotide.sources import telemetry as _tel  # noqa: E402


def _messages(t):
    return _tel.telemetry_messages(t.trajectories, t.mqtt_sessions)


@query("telemetry_sessions")
def q_telemetry_sessions(t):
    """A1 + K1: sessions parsed from the telemetry messages (ids are K4 hashes, not shown)."""
    return _tel.telemetry_sessions(_tel.telemetry_parse(_messages(t))).drop("session_id")


@query("telemetry_points")
def q_telemetry_points(t):
    """A2: valid points parsed from the telemetry messages."""
    return _tel.telemetry_points(_tel.telemetry_parse(_messages(t))).drop("session_id", "updated_at")


def _bundle(t, member: str):
    """Write the GTFS tables as a bundle under the shared checkpoint folder, read one member back."""
    import uuid

    from geotide.session import checkpoint_dir
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/gtfs-{uuid.uuid4().hex}"
    _gtfs.write_gtfs_bundle({"gtfs_stops": t.gtfs_stops, "gtfs_routes": t.gtfs_routes, "gtfs_trips": t.gtfs_trips,
                             "gtfs_stop_times": t.gtfs_stop_times, "gtfs_calendar": t.gtfs_calendar,
                             "gtfs_calendar_dates": t.gtfs_calendar_dates}, folder)
    return _gtfs.read_gtfs_bundle(t.spark, folder)[member]


@query("gtfs_stops_csv")
def q_gtfs_stops_csv(t):
    """A6 + A12."""
    return _bundle(t, "gtfs_stops")


@query("gtfs_routes_csv")
def q_gtfs_routes_csv(t):
    """A7."""
    return _bundle(t, "gtfs_routes")


@query("gtfs_trips_csv")
def q_gtfs_trips_csv(t):
    """A8."""
    return _bundle(t, "gtfs_trips")


@query("gtfs_stop_times_csv")
def q_gtfs_stop_times_csv(t):
    """A9."""
    return _bundle(t, "gtfs_stop_times")


@query("gtfs_calendar_csv")
def q_gtfs_calendar_csv(t):
    """A10."""
    return _bundle(t, "gtfs_calendar").withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query("gtfs_calendar_dates_csv")
def q_gtfs_calendar_dates_csv(t):
    """Exception types are clipped to 1 or 2."""
    return _bundle(t, "gtfs_calendar_dates").withColumn("date", F.col("date").cast("string"))


@query("rt_trip_updates")
def q_rt_trip_updates(t):
    """A4 over decoded feeds encoded from the trip updates."""
    return _rtf.rt_trip_updates(_rtf.decode_feeds(_rtf.trip_update_feeds(t.trip_updates, AS_OF)))


# ------------------------------------------------------------ streaming -----

def _stream_folder(t, tag):
    import uuid

    from geotide.session import checkpoint_dir
    return f"{checkpoint_dir(t.spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex}"


def _files(df, path: str, n: int, fmt: str = "parquet"):
    """Rows as ``n`` files, so that a stream over them takes several micro-batches."""
    df.repartition(n).write.format(fmt).mode("overwrite").save(path)


def _ingested(t, which: str):
    from geotide.streaming import pipelines as sp
    base = _stream_folder(t, "ingest")
    _files(_messages(t), f"{base}/in", 8, "json")
    return sp.stream_ingest(sp.read_telemetry_stream(t.spark, f"{base}/in", 4), f"{base}/out", f"{base}/ckpt")[which].rows()


@query("stream_ingest_sessions")
def q_stream_ingest_sessions(t):
    """Sessions from a file stream of telemetry messages, in several micro-batches == batch A1."""
    return _ingested(t, "sessions").select("client_id", "start_time", "end_time")


@query("stream_ingest_points")
def q_stream_ingest_points(t):
    """Points from a file stream of telemetry messages, in several micro-batches == batch A2."""
    return _ingested(t, "points").select("client_id", "lat", "lon", "elevation", "speed", "activity", "timestamp")


@query("stream_migrate_trajectories")
def q_stream_migrate(t):
    """Two triggers on one checkpoint, half a month apart; the second finds no new points and closes by the timer."""
    import datetime as dt

    from geotide.streaming import pipelines as sp
    base = _stream_folder(t, "migrate")
    pts = _session_points(t).select(*sp.MIGRATED_POINT)
    _files(pts, f"{base}/in", 4)
    src = t.spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    for as_of in (AS_OF - dt.timedelta(days=15), AS_OF):
        sp.stream_migrate(src, f"{base}/out", f"{base}/ckpt", as_of)
    out = sp.migrated(t.spark, f"{base}/out")
    return out.withColumn("n_points", F.size("trajectory")).drop("trajectory")


@query("live_active_clients")
def q_live_active_clients(t):
    """P3 from a last-seen table that a stream of points keeps."""
    from geotide.streaming import pipelines as sp
    base = _stream_folder(t, "live")
    pts = t.geodata.select("client_id", "timestamp", "updated_at")
    _files(pts, f"{base}/in", 6)
    src = t.spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    sp.stream_last_seen(src, f"{base}/out", f"{base}/ckpt", AS_OF)
    return sp.live_active_clients(t.spark, f"{base}/out", AS_OF)


@query("publish_once")
def q_publish_once(t):
    """T5: results that arrive twice are published once; the second half of the files repeats the first."""
    from geotide.streaming import pipelines as sp
    base = _stream_folder(t, "publish")
    cols = ["client_id", "session_id", "created_at"]
    res = t.optimized_routes.where("is_valid").select(*cols).unionByName(t.reroutes.select(*cols))
    _files(res.unionByName(res), f"{base}/in", 4)
    src = t.spark.readStream.schema(res.schema).parquet(f"{base}/in")
    sp.publish_once(src, f"{base}/out", f"{base}/ckpt")
    return t.spark.read.schema(res.schema).parquet(f"{base}/out")


def _fed(t, which: str):
    from geotide.streaming import pipelines as sp
    base = _stream_folder(t, "feeds")
    feeds = _rtf.vehicle_feeds(t.vehicle_arrivals, AS_OF).unionByName(_rtf.trip_update_feeds(t.trip_updates, AS_OF)) \
        .unionByName(_rtf.alert_feeds(t.alerts, AS_OF))
    _files(feeds.select("feed_json", F.col("read_at").cast("string").alias("read_at")), f"{base}/in", 6, "json")
    return sp.rt_feed_ingest(sp.read_feed_stream(t.spark, f"{base}/in", 2), f"{base}/out", f"{base}/ckpt")[which]


@query("rt_vehicle_positions")
def q_rt_vehicle_positions(t):
    """A3 through T6: one stream of mixed feeds into three tables."""
    return _fed(t, "vehicle_positions")


@query("rt_feed_trip_updates")
def q_rt_feed_trip_updates(t):
    """A4 through T6."""
    return _fed(t, "trip_updates")


@query("rt_service_alerts")
def q_rt_service_alerts(t):
    """A5 (+F4) through T6."""
    return _fed(t, "service_alerts")


# -------------------------------------------------------- stored tables -----

from geotide.operators import stored as _st  # noqa: E402


@query("sessions_by_gap")
def q_sessions_by_gap(t):
    """Windows of clients whose messages name none: a gap of six hours ends a session."""
    return _tel.sessions_by_gap(t.geodata, "6 hours")


@query("session_get_or_create")
def q_session_get_or_create(t):
    """K4: points and sessions meet by an id that either side computes for itself; the id itself is not shown."""
    ids = _wr.session_ids(t.mqtt_sessions.drop("session_id")).select("session_id", "client_id", "start_time", "end_time")
    pts = _wr.session_ids(_session_points(t).select("client_id", "start_time", "timestamp"))
    n = pts.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_points"))
    return ids.join(n, "session_id").select("client_id", "start_time", "end_time", "n_points")


def _day_table(t, tag: str, frames, key, time: str):
    table = _st.DayTable(t.spark, _stream_folder(t, tag), frames[0].schema, key, time, buckets=4)
    for df in frames:
        table.insert(df)
    return table


@query("insert_ignore_points")
def q_insert_ignore_points(t):
    """K1: clicks and views are stored first; inserting all points then, twice, adds the others and changes none."""
    g = t.geodata.select("client_id", "timestamp", "lat", "lon", "activity")
    again = g.withColumn("lat", F.col("lat") + 1.0)
    return _day_table(t, "insert", [g.where(F.col("activity").isin("Walking", " bus ")), again, again], ["client_id", "timestamp"],
                      "timestamp").rows()


@query("delete_migrated_points")
def q_delete_migrated_points(t):
    """K5: stored points that are in a session window are deleted by key."""
    key = ["client_id", "timestamp", "session_id"]
    table = _day_table(t, "delete", [t.geodata.select(*key, "lat", "lon")], key, "timestamp")
    table.delete(_session_points(t).select(*key))
    return table.rows()


@query("retention_days")
def q_retention_days(t):
    """K6: stored points per day after 10 days' retention, with the number of rows that expired."""
    table = _day_table(t, "retain", [t.geodata.select("client_id", "timestamp", "lat")], ["client_id", "timestamp"], "timestamp")
    expired = table.expire(AS_OF, 10)
    return table.rows().groupBy(F.to_date("timestamp").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("kept")) \
        .withColumn("expired", F.lit(expired).cast("long"))


@query("append_validated")
def q_append_validated(t):
    """K8: six kinds of rows appended as one batch, delivered twice; accepted and rejected rows with the reason."""
    bad = lambda c, m, v=None: F.when(F.col("id") % m == 0, F.lit(v)).otherwise(F.col(c)).alias(c)
    p = t.predicted_pois_sequence
    new = {
        "astar_routes": t.astar_routes.withColumns({"decision_context": bad("decision_context", 17, "guessed"), "distance": bad("distance", 13)}),
        "mapf_routes": t.mapf_routes.withColumns({"decision_context": bad("decision_context", 7, "guessed")}),
        "reroutes": t.reroutes.withColumns({"client_id": bad("client_id", 11)}),
        "weekly_schedule": p.select("id", "client_id", F.date_format("predicted_visit_time", "EEEE").alias("visit_day"),
                                    F.col("predicted_visit_time").alias("predicted_time"), bad("prediction_type", 5, "monthly")),
        "pois": t.pois.withColumnRenamed("poi_id", "id").withColumns({"poi_rank": bad("poi_rank", 9), "lat": bad("lat", 6)}),
        "user_patterns": t.user_patterns.withColumnRenamed("pattern_id", "id").withColumns({"lon": bad("lon", 8)}),
    }
    log = _st.BatchLog(t.spark, _stream_folder(t, "append"))
    for _ in range(2):
        _st.append_validated(log, "first", new)
    out = None
    for name, df in new.items():
        kept = log.read(name, df.schema).select(F.lit(name).alias("target"), "id", "client_id", F.lit(None).cast("string").alias("reject_reason"))
        schema = df.withColumn("reject_reason", F.lit("")).schema
        gone = log.read(f"{name}_rejects", schema).select(F.lit(name).alias("target"), "id", "client_id", "reject_reason")
        out = kept.unionByName(gone) if out is None else out.unionByName(kept).unionByName(gone)
    return out


# ------------------------------------------------------------- features -----

from geotide.operators import features as _ft  # noqa: E402


def _training(t):
    return _ft.training_vectors(t.user_patterns, t.pois, t.predicted_pois_sequence, t.astar_routes, t.mapf_routes, t.gtfs_stops,
                                t.vehicle_arrivals, t.trajectories)


@query("training_vectors")
def q_training_vectors(t):
    """U6 (+F14)."""
    return _training(t)


@query("feature_scaler")
def q_feature_scaler(t):
    """G13 over the training vectors, all features."""
    st = _ft.feature_scaler(_training(t), _ft.FEATURES)
    return st.select(*[F.round(c, 6).alias(c) for c in st.columns])


@query("scaled_vectors")
def q_scaled_vectors(t):
    """Standardised training vectors, and whether the inverse brings every feature back."""
    tv = _training(t)
    st = _ft.feature_scaler(tv, _ft.FEATURES)
    raw = tv.select(*_ft.FEATURES, *[F.col(c).alias(f"raw_{c}") for c in _ft.FEATURES])
    scaled = _ft.standardise(raw, st, _ft.FEATURES)
    back = _ft.standardise(scaled.select("*", *[F.col(c).alias(f"scaled_{c}") for c in _ft.FEATURES]), st, _ft.FEATURES, inverse=True)
    same = F.lit(True)
    for c in _ft.FEATURES:
        same = same & (F.abs(F.col(c) - F.col(f"raw_{c}")) < 1e-9)
    return back.select(*[F.col(f"raw_{c}").alias(c) for c in ("lat", "lon", "hour")],
                       *[F.round(f"scaled_{c}", 4).alias(f"scaled_{c}") for c in _ft.FEATURES], same.alias("comes_back"))


@query("client_scaler")
def q_client_scaler(t):
    """G13 per client over the telemetry positions."""
    st = _ft.key_scaler(t.geodata, "client_id", ["lat", "lon"])
    return st.select("client_id", *[F.round(c, 6).alias(c) for c in st.columns if c != "client_id"])


@query("sequence_windows")
def q_sequence_windows(t):
    """60-row history windows over the ordered training vectors; their contents as a digest of rounded values."""
    w = _ft.sequence_windows(_training(t), block=256)
    return w.select("idx", F.md5(_ft.rounded_text("window")).alias("window_md5"), F.size("window").alias("steps"), "label_lat", "label_lon")


@query("sequence_pad")
def q_sequence_pad(t):
    """Each client's last 60 points as a left-padded feature sequence; its contents as a digest of rounded values."""
    g = t.geodata.select("client_id", "timestamp", "lat", "lon", "speed",
                         (F.hour("timestamp") / F.lit(23.0)).alias("hour"))
    s = _ft.sequence_pad(g, features=("hour", "speed", "lat", "lon"))
    return s.select("client_id", F.md5(_ft.rounded_text("sequence")).alias("sequence_md5"), F.size("sequence").alias("steps"))


@query("movement_patterns")
def q_movement_patterns(t):
    """B6 over all trajectory points."""
    from geotide.operators.patterns import movement_patterns
    return movement_patterns(_bh.trajectory_points(t.trajectories))[0]


@query("shortest_paths")
def q_shortest_paths(t):
    """Least-length paths for the B7 routing targets over the movement graph of the telemetry."""
    from geotide.operators.paths import movement_graph, shortest_paths
    pos = _rt.latest_locations(t.geodata, AS_OF)
    best = _rt.best_target_poi(views.combined_pois(t.pois, t.predicted_pois_sequence), AS_OF)
    req = _rt.route_candidates(pos, best, t.pois, t.gtfs_stops).select(
        F.concat_ws("/", "client_id", "target_type").alias("request_id"), "origin_lat", "origin_lon",
        "goal_lat", "goal_lon")
    nodes, edges = movement_graph(_session_points(t))
    sp = shortest_paths(req, nodes, edges)
    return sp.select("request_id", "origin_node", "goal_node", F.round("length_m", 3).alias("length_m"),
                     F.size("path").alias("path_points"))
