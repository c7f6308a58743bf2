"""The analytical views, one lazy DataFrame function each.

Names drop the ``view_`` prefix.  ``as_of`` replaces ``NOW()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotide.functions.geo import geojson_point
from geotide.functions.timefn import ts_literal
from geotide.operators import joins, setops, spatial
from geotide.operators.latest import asc, desc, latest_k_per_key, top_k_per_key

# Recency windows of the views.
ACTIVE_TS_WINDOW = "26 HOURS"
ACTIVE_SEEN_WINDOW = "2 SECONDS"
MAPF_ACTIVE_WINDOW = "1 HOURS"
HIT_RATE_WINDOW = "24 HOURS"
STOP_USAGE_WINDOW = "7 DAYS"
NO_STOP = "∅"

# GTFS route_type code -> transport name (fixed values).
ROUTE_TYPE_NAMES = {0: "tram", 1: "subway", 2: "rail", 3: "bus", 4: "ferry"}


def _ago(as_of, spec: str):
    return ts_literal(as_of) - F.expr(f"INTERVAL {spec}")


# -- J1 / J2 / P2 -------------------------------------------------------------
routing_candidates_gtfsrt = joins.routing_candidates
static_gtfs_unified = joins.static_gtfs_unified


def lines(routes: DataFrame) -> DataFrame:
    """Route id, transport name from ``route_type``, and the whole row as JSON."""
    name = F.lit("unknown")
    for code in sorted(ROUTE_TYPE_NAMES, reverse=True):
        name = F.when(F.col("route_type") == code, F.lit(ROUTE_TYPE_NAMES[code])).otherwise(name)
    return routes.select(F.col("route_id").alias("line_id"), name.alias("transport_type"),
                         F.to_json(F.struct(*routes.columns), {"ignoreNullFields": "false"}).alias("content"))


# -- P3 / W2 ------------------------------------------------------------------
def client_last_seen(geodata: DataFrame) -> DataFrame:
    """G1: last point time and last update per client (partial + final aggregate)."""
    return geodata.groupBy("client_id").agg(F.max("timestamp").alias("last_ts"),
                                            F.max("updated_at").alias("last_seen"))


def active_clients_geodata(geodata: DataFrame, as_of) -> DataFrame:
    """Clients with a point in the last 26 h or an update in the last 2 s."""
    return still_active(client_last_seen(geodata), as_of).select("client_id")


def still_active(last: DataFrame, as_of) -> DataFrame:
    """Rows of a last-seen table whose client counts as active."""
    return last.where((F.col("last_ts") >= _ago(as_of, ACTIVE_TS_WINDOW)) | (F.col("last_seen") >= _ago(as_of, ACTIVE_SEEN_WINDOW)))


def current_session_id_from_geodata(geodata: DataFrame) -> DataFrame:
    """Each client's session of its newest point."""
    return joins.latest_point(geodata).select("client_id", "session_id")


def geodata_latest_point(geodata: DataFrame) -> DataFrame:
    """W2 + P8: newest point per client with a point geometry."""
    g = joins.latest_point(geodata)
    return g.select("client_id", "session_id", "lat", "lon",
                    F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat")).alias("geom"),
                    "speed", "activity", "timestamp", "updated_at")


astar_eta = joins.astar_eta


def top_daily_poi(predicted: DataFrame) -> DataFrame:
    """Each client's earliest daily prediction."""
    d = predicted.where(F.col("prediction_type") == "daily")
    return top_k_per_key(d, ["client_id"], [asc("predicted_visit_time"), asc("id")], 1, None)


combined_pois = setops.combined_pois


def hotspots_heatmap(hotspots: DataFrame) -> DataFrame:
    """Hotspot rows with a GeoJSON point."""
    return hotspots.select("hotspot_id", "client_id", "lat", "lon", "radius", "density", "type", "source_type",
                           "time_spent", "created_at", "updated_at",
                           geojson_point("lon", "lat").alias("geojson"))


def latest_client_trajectories(trajectories: DataFrame, k: int = 8) -> DataFrame:
    """Each client's ``k`` newest trajectories."""
    return latest_k_per_key(trajectories, ["client_id"], k, "created_at", tiebreak=["id"])


departure_candidates = joins.departure_candidates


def predicted_routes_schedule(predicted, mapf, astar, as_of):
    return joins.predicted_routes_schedule(predicted, mapf, astar, as_of)


hotspot_overlay = spatial.hotspot_overlay
daily_routing_summary = setops.daily_routing_summary


def mapf_active_routes(mapf: DataFrame, as_of) -> DataFrame:
    """P4 + W2: each client's newest successful MAPF route of the last hour."""
    m = mapf.where((F.col("success") == F.lit(True)) & (F.col("created_at") >= _ago(as_of, MAPF_ACTIVE_WINDOW)))
    return top_k_per_key(m, ["client_id"], [desc("created_at"), desc("id")], 1, "rn")


routes_history = setops.routes_history


def routes_unified_latest(history: DataFrame) -> DataFrame:
    """U1 -> W2 keyed by (client, stop or '∅', segment, destination)."""
    keys = ["client_id", F.coalesce(F.col("stop_id"), F.lit(NO_STOP)), "segment_type",
            "destination_lat", "destination_lon"]
    return top_k_per_key(history, keys, [desc("created_at"), asc("source")], 1, "rn")


def routes_live(history: DataFrame) -> DataFrame:
    """U1 -> chosen only -> W2 per client."""
    h = history.where(F.col("is_chosen") == F.lit(True))
    return top_k_per_key(h, ["client_id"], [desc("created_at"), asc("source")], 1, "rn")


def routes_unified(optimized: DataFrame, reroutes: DataFrame) -> DataFrame:
    """Valid optimized routes UNION ALL reroutes -> newest per (client, destination, segment)."""
    cols = ["client_id", "stop_id", "destination_lat", "destination_lon", "path", "segment_type", "created_at"]
    o = optimized.where(F.col("is_valid") == F.lit(True)).select(*cols, F.lit(0).alias("__src"))
    r = reroutes.select(*cols, F.lit(1).alias("__src"))
    u = o.unionByName(r)
    keys = ["client_id", "destination_lat", "destination_lon", F.coalesce(F.col("segment_type"), F.lit(""))]
    return top_k_per_key(u, keys, [desc("created_at"), asc("__src")], 1, None).drop("__src")


pois_nearest_stop = spatial.pois_nearest_stop
pois_stops_within_300m = spatial.pois_stops_within


def latest_client_routes(history: DataFrame, k: int = 8) -> DataFrame:
    """U1 -> W1: each client's ``k`` newest routes."""
    return top_k_per_key(history, ["client_id"], [desc("created_at"), asc("source")], k, "rn")


routes_astar_mapf_unified = setops.routes_astar_mapf_unified


def routes_astar_mapf_latest(unified: DataFrame) -> DataFrame:
    """U3 -> W2 per client."""
    return top_k_per_key(unified, ["client_id"], [desc("created_at"), asc("method")], 1, "rn")


eta_accuracy_seconds = joins.eta_accuracy


def boarding_window_hit_rate(candidates: DataFrame, as_of) -> DataFrame:
    """Per client, candidates of the last 24 h and the share whose departure lies in the boarding window."""
    from geotide.functions.timefn import add_seconds
    c = candidates.where(F.col("departure_time") >= _ago(as_of, HIT_RATE_WINDOW))
    hit = F.col("departure_time").between(add_seconds(F.col("predicted_eta"), F.lit(40.0)),
                                          add_seconds(F.col("predicted_eta"), F.lit(90.0)))
    g = c.groupBy("client_id").agg(F.count(F.lit(1)).alias("total_candidates"),
                                   F.sum(F.when(hit, 1).otherwise(0)).alias("hits"))
    return g.withColumn("hit_rate_pct", F.round(F.lit(100.0) * F.col("hits")
                                                / F.nullif(F.col("total_candidates"), F.lit(0)), 2))


def stop_usage_7d(history: DataFrame, as_of) -> DataFrame:
    """Per (client, stop or '∅') route count, first and last time in the last 7 days."""
    h = history.where(F.col("created_at") >= _ago(as_of, STOP_USAGE_WINDOW))
    return h.groupBy("client_id", F.coalesce(F.col("stop_id"), F.lit(NO_STOP)).alias("stop_id")).agg(
        F.count(F.lit(1)).alias("route_count_7d"), F.min("created_at").alias("first_seen_7d"),
        F.max("created_at").alias("last_seen_7d"))


predicted_poi_nearest_stop = spatial.predicted_poi_nearest_stop
client_weekly_schedule_enriched = spatial.schedule_enriched


def next_feasible_departure_per_client(candidates: DataFrame, as_of) -> DataFrame:
    """Each client's earliest candidate departing at or after ``as_of``."""
    c = candidates.where(F.col("departure_time") >= ts_literal(as_of))
    return top_k_per_key(c, ["client_id"], [asc("departure_time"), asc("trip_id"), asc("predicted_eta")], 1, "rn")
