"""Route decision, re-decision and publication.

The reference decides per client with ~8 point queries each; here every step
is one set-based plan over all clients: top-1-per-key picks, left joins of
the per-client facts, and a ``when`` cascade for the decision branches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotide.functions.geo import LINE_TYPE, WALKING_SPEED_MS, path_length_m, point_to_path_m
from geotide.functions.timefn import add_seconds, hour_fraction, seconds_between, ts_literal, weekday_name
from geotide.operators.latest import asc, desc, top_k_per_key

# ---------------------------------------------------------------------------
# Fixed values of the decision and re-decision logic
# ---------------------------------------------------------------------------
HISTORY_BLEND = 0.15
KNOWN_LINE_NUDGE = 0.05
CLOSE_MARGIN = 0.10
MAPF_PENALTY_METERS = 100.0
TIE_MAX_DELAY_S = 60
TIE_MAX_SWITCH_S = 120
FAVOURITE_ROUTES_K = 5
DIST_NORM_M = 5000.0
SPEED_NORM_MS = 6.0
DEVIATION_METERS_DIRECT = 35.0
DEVIATION_METERS_MAPF = 60.0
DEVIATION_STREAKS_REQUIRED = 2
DELAY_THRESHOLD_SECONDS = 180
DEPARTURE_STALE_SECONDS = 45
SETTLE_SECONDS = 2
FUTURE_TOLERANCE = "5 MINUTES"
FRESH_WINDOW = "60 SECONDS"
RESULTS_TOPIC = "results/client/{client_id}/session/{session_id}"
# ---------------------------------------------------------------------------


# -- L2 / L3 / L5 -------------------------------------------------------------

def best_target_poi(combined: DataFrame, as_of) -> DataFrame:
    """L2: per client, predicted POIs first, then rank desc (nulls first, D21),
    then ``coalesce(predicted_visit_time, as_of)`` desc (the farthest future wins, D22),
    then newest; lat/lon break remaining ties."""
    pred = F.when(F.col("poi_type").startswith("predicted_"), 1).otherwise(0)
    order = [pred.desc(), desc("poi_rank"),
             F.coalesce(F.col("predicted_visit_time"), ts_literal(as_of)).desc_nulls_last(),
             desc("created_at"), asc("lat"), asc("lon")]
    return top_k_per_key(combined, ["client_id"], order, 1, None)


def best_departure(candidates: DataFrame) -> DataFrame:
    """L3: per (client, stop) the candidate with least delay (null = 0), then earliest departure."""
    order = [F.coalesce(F.col("delay_seconds"), F.lit(0)).asc(), asc("departure_time"), asc("trip_id"),
             asc("predicted_eta")]
    return top_k_per_key(candidates, ["client_id", "stop_id"], order, 1, None)


def latest_speed(geodata: DataFrame) -> DataFrame:
    """Newest (by update time) speed per client; null or negative -> 0."""
    g = top_k_per_key(geodata, ["client_id"], [desc("updated_at"), desc("timestamp"), desc("id")], 1, None)
    return g.select("client_id", F.greatest(F.coalesce(F.col("speed"), F.lit(0.0)), F.lit(0.0)).alias("speed"))


def latest_locations(geodata: DataFrame, as_of) -> DataFrame:
    """Settled latest position per client: update at least 2 s old, point not > 5 min ahead."""
    now = ts_literal(as_of)
    g = geodata.where((F.col("updated_at") <= now - F.expr(f"INTERVAL {SETTLE_SECONDS} SECONDS"))
                      & (F.col("timestamp") <= now + F.expr(f"INTERVAL {FUTURE_TOLERANCE}")))
    g = top_k_per_key(g, ["client_id"], [desc("updated_at"), desc("timestamp"), desc("id")], 1, None)
    return g.select("client_id", "lat", "lon", "speed", "updated_at")


# -- G4 / G6 -------------------------------------------------------------------

def route_usage_ratios(optimized: DataFrame) -> DataFrame:
    """Per client, share of direct and of multimodal routes among all its routes."""
    st = F.lower(F.coalesce(F.col("segment_type"), F.lit("")))
    g = optimized.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("__n"), F.sum(F.when(st == "direct", 1).otherwise(0)).alias("__a"),
        F.sum(F.when(st == "multimodal", 1).otherwise(0)).alias("__m"))
    return g.select("client_id", (F.col("__a") / F.col("__n")).alias("astar_ratio"),
                    (F.col("__m") / F.col("__n")).alias("mapf_ratio"))


def with_usage_ratios(df: DataFrame, optimized: DataFrame) -> DataFrame:
    """Attach G4 ratios, (0.5, 0.5) for clients without history."""
    r = route_usage_ratios(optimized)
    return df.join(r, "client_id", "left") \
        .withColumn("astar_ratio", F.coalesce("astar_ratio", F.lit(0.5))) \
        .withColumn("mapf_ratio", F.coalesce("mapf_ratio", F.lit(0.5)))


def favourite_routes(candidates: DataFrame, k: int = FAVOURITE_ROUTES_K) -> DataFrame:
    """Each client's ``k`` most frequent route ids among its departure candidates (tie: route_id)."""
    c = candidates.where(F.col("route_id").isNotNull()).groupBy("client_id", "route_id") \
        .agg(F.count(F.lit(1)).alias("cnt"))
    return top_k_per_key(c, ["client_id"], [F.col("cnt").desc(), asc("route_id")], k, "rank")


# -- B10 / B11 -----------------------------------------------------------------

def candidate_features(dist: Column, is_multimodal: bool, as_of, speed: Column, astar_ratio: Column,
                       mapf_ratio: Column) -> Column:
    """[min(dist/5000,1), multimodal, hour/23, min(speed/6,1), astar_ratio, mapf_ratio] (floats)."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.array(clip(dist.cast("double") / F.lit(DIST_NORM_M)), F.lit(1.0 if is_multimodal else 0.0),
                   hour_fraction(ts_literal(as_of)), clip(speed.cast("double") / F.lit(SPEED_NORM_MS)),
                   astar_ratio.cast("double"), mapf_ratio.cast("double")).cast("array<float>")


def blend_scores(score_astar: Column, score_mapf: Column, astar_ratio: Column, mapf_ratio: Column,
                 favourite: Column) -> Column:
    """struct(p_astar, p_mapf) from model scores, usage history and the favourite-line nudge.

    Scores are shifted by their minimum and normalised (D7: one-hot unless
    equal), blended 0.85/0.15 with the normalised ratios, +0.05 to MAPF
    (capped at 1) on a favourite route, then renormalised.
    """
    mn = F.least(score_astar, score_mapf)
    sa, sm = score_astar - mn, score_mapf - mn
    den = sa + sm
    pa = F.when(den <= 1e-9, F.lit(0.5)).otherwise(sa / den)
    pm = F.when(den <= 1e-9, F.lit(0.5)).otherwise(sm / den)
    hs = astar_ratio + mapf_ratio
    ha = F.when(hs <= 1e-9, F.lit(0.5)).otherwise(astar_ratio / hs)
    hm = F.when(hs <= 1e-9, F.lit(0.5)).otherwise(mapf_ratio / hs)
    ba = F.lit(1 - HISTORY_BLEND) * pa + F.lit(HISTORY_BLEND) * ha
    bm = F.lit(1 - HISTORY_BLEND) * pm + F.lit(HISTORY_BLEND) * hm
    bm = F.when(F.coalesce(favourite, F.lit(False)), F.least(F.lit(1.0), bm + F.lit(KNOWN_LINE_NUDGE))).otherwise(bm)
    tot = ba + bm
    return F.struct(F.when(tot > 1e-9, ba / tot).otherwise(ba).alias("p_astar"),
                    F.when(tot > 1e-9, bm / tot).otherwise(bm).alias("p_mapf"))


def route_features(pairs: DataFrame, optimized: DataFrame, geodata: DataFrame, as_of) -> DataFrame:
    """B10 for both candidates of each client: ``pairs`` (client_id, astar_dist, mapf_dist) -> client_id, astar, mapf
    (feature arrays) with the client's latest speed (L5, 0 if unknown) and usage ratios (G4)."""
    j = with_usage_ratios(pairs.join(latest_speed(geodata), "client_id", "left"), optimized)
    speed, ra, rm = F.coalesce(F.col("speed"), F.lit(0.0)), F.col("astar_ratio"), F.col("mapf_ratio")
    return j.select("client_id", candidate_features(F.col("astar_dist"), False, as_of, speed, ra, rm).alias("astar"),
                    candidate_features(F.col("mapf_dist"), True, as_of, speed, ra, rm).alias("mapf"))


def route_scores(pairs: DataFrame, optimized: DataFrame, geodata: DataFrame, as_of, scorer: Callable) -> DataFrame:
    """V1 over B10: (client_id, score_astar, score_mapf).

    ``scorer`` takes two float arrays of shape (rows, 6), the features of the direct and of the multimodal
    candidates, and returns either two scores a row (rows, 2) or one score s a row, read as (1 - s, s).  It runs
    in tasks, once per Arrow batch; what it closes over, such as a model, is broadcast with it.
    """
    import numpy as np

    def run(pdf):
        if not len(pdf):
            return pdf.assign(score_astar=[], score_mapf=[])[["client_id", "score_astar", "score_mapf"]]
        out = np.asarray(scorer(np.stack(pdf["astar"]).astype(float), np.stack(pdf["mapf"]).astype(float)), dtype=float)
        out = out.reshape(len(pdf), -1)
        if out.shape[1] == 1:
            out = np.hstack([1.0 - out, out])
        if out.shape[1] != 2:
            raise ValueError("a scorer gives one or two scores a row")
        return pdf[["client_id"]].assign(score_astar=out[:, 0], score_mapf=out[:, 1])

    from geotide.operators.features import score_with
    return score_with(route_features(pairs, optimized, geodata, as_of), run, "client_id string, score_astar double, score_mapf double")


# -- B12 ---------------------------------------------------------------------

def choose_route(targets: DataFrame, astar: DataFrame, mapf: DataFrame, candidates: DataFrame,
                 profiles: DataFrame, optimized: DataFrame, geodata: DataFrame, as_of,
                 scores: DataFrame | None = None, scorer: Callable | None = None) -> DataFrame:
    """One decision per client with a target POI.

    ``targets``: client_id, lat, lon (from L2).  Branches, in order: no A*
    route to the POI -> ``fallback``; no successful MAPF route -> ``direct``;
    no aligned departure at the MAPF stop -> ``direct``; model scores present
    (``scores``: client_id, score_astar, score_mapf; or ``scorer``, which is run over the B10 features of
    the clients that come this far, see ``route_scores``) -> blended choice with the
    close-margin tie-break; otherwise the distance heuristic
    ``astar < mapf + 100 + max(0, delay)`` -> ``direct`` else ``multimodal``.
    """
    t = targets.select("client_id", F.col("lat").alias("dest_lat"), F.col("lon").alias("dest_lon"))
    loc = latest_locations(geodata, as_of).select(F.col("client_id").alias("l_c"), F.col("lat").alias("l_lat"),
                                                  F.col("lon").alias("l_lon"))
    a = top_k_per_key(astar.where(F.col("target_type") == "poi"),
                      ["client_id", "destination_lat", "destination_lon"], [desc("created_at"), desc("id")], 1, None)
    a = a.select(F.col("client_id").alias("a_c"), F.col("destination_lat").alias("a_lat"),
                 F.col("destination_lon").alias("a_lon"), F.col("path").alias("astar_path"),
                 F.coalesce(F.col("distance"), F.lit(0.0)).alias("astar_dist"), "origin_lat", "origin_lon")
    m = top_k_per_key(mapf.where(F.col("success") == F.lit(True)),
                      ["client_id", "destination_lat", "destination_lon"], [desc("created_at"), desc("id")], 1, None)
    m = m.select(F.col("client_id").alias("m_c"), F.col("destination_lat").alias("m_lat"),
                 F.col("destination_lon").alias("m_lon"), F.col("stop_id").alias("mapf_stop_id"),
                 F.col("path").alias("mapf_path"), F.coalesce(F.col("distance"), F.lit(0.0)).alias("mapf_dist"))
    d = best_departure(candidates).select(F.col("client_id").alias("d_c"), F.col("stop_id").alias("d_s"),
                                          F.coalesce(F.col("delay_seconds"), F.lit(0)).cast("double").alias("delay"),
                                          F.col("route_id").alias("dep_route_id"), F.lit(True).alias("has_dep"))
    j = t.join(a, (t["client_id"] == a["a_c"]) & (t["dest_lat"] == a["a_lat"]) & (t["dest_lon"] == a["a_lon"]), "left") \
        .join(m, (t["client_id"] == m["m_c"]) & (t["dest_lat"] == m["m_lat"]) & (t["dest_lon"] == m["m_lon"]), "left")
    j = j.join(d, (j["client_id"] == d["d_c"]) & (j["mapf_stop_id"] == d["d_s"]), "left")
    has_a, has_m = F.col("a_c").isNotNull(), F.col("m_c").isNotNull()
    # without an A* route the decision starts where the client is; without a location there is none
    j = j.join(loc, F.col("client_id") == F.col("l_c"), "left").where(has_a | F.col("l_c").isNotNull()) \
        .withColumn("origin_lat", F.when(has_a, F.col("origin_lat")).otherwise(F.col("l_lat"))) \
        .withColumn("origin_lon", F.when(has_a, F.col("origin_lon")).otherwise(F.col("l_lon")))
    has_d = F.coalesce(F.col("has_dep"), F.lit(False))
    heuristic_direct = F.col("astar_dist") < (F.col("mapf_dist") + F.lit(MAPF_PENALTY_METERS)
                                              + F.greatest(F.lit(0.0), F.col("delay")))
    if scorer is not None:
        scores = route_scores(j.where(has_a & has_m & has_d).select("client_id", "astar_dist", "mapf_dist"), optimized, geodata, as_of, scorer)
    if scores is not None:
        fav = favourite_routes(candidates).select(F.col("client_id").alias("f_c"), F.col("route_id").alias("f_r"),
                                                  F.lit(True).alias("is_fav"))
        p = profiles.select(F.col("client_id").alias("p_c"), F.col("stop_id").alias("p_s"), "avg_switch_seconds")
        s = scores.select(F.col("client_id").alias("s_c"), "score_astar", "score_mapf")
        j = with_usage_ratios(j, optimized).join(s, j["client_id"] == s["s_c"], "left") \
            .join(fav, (F.col("client_id") == F.col("f_c")) & (F.col("dep_route_id") == F.col("f_r")), "left") \
            .join(p, (F.col("client_id") == F.col("p_c")) & (F.col("mapf_stop_id") == F.col("p_s")), "left")
        b = blend_scores(F.col("score_astar"), F.col("score_mapf"), F.col("astar_ratio"), F.col("mapf_ratio"),
                         F.col("is_fav"))
        j = j.withColumn("__b", b)
        tie = (F.abs(F.col("__b.p_mapf") - F.col("__b.p_astar")) < CLOSE_MARGIN) \
            & F.col("avg_switch_seconds").isNotNull() & (F.col("delay") <= TIE_MAX_DELAY_S) \
            & (F.col("avg_switch_seconds") <= TIE_MAX_SWITCH_S)
        scored_direct = ~((F.col("__b.p_mapf") > F.col("__b.p_astar")) | tie)
        has_s = F.col("s_c").isNotNull()
        direct = F.when(has_s, scored_direct).otherwise(heuristic_direct)
        branch_scored = F.when(has_s, F.lit("scored")).otherwise(F.lit("heuristic"))
    else:
        direct = heuristic_direct
        branch_scored = F.lit("heuristic")
    choice = F.when(~has_a, "fallback").when(~has_m, "direct").when(~has_d, "direct") \
        .when(direct, "direct").otherwise("multimodal")
    branch = F.when(~has_a, "no_astar").when(~has_m, "no_mapf").when(~has_d, "no_departure").otherwise(branch_scored)
    j = j.withColumn("segment_type", choice).withColumn("decision_branch", branch)
    mm = F.col("segment_type") == "multimodal"
    return j.select(
        "client_id", F.when(mm, F.col("mapf_stop_id")).otherwise(F.lit("direct")).alias("stop_id"),
        F.col("dest_lat").alias("destination_lat"), F.col("dest_lon").alias("destination_lon"),
        F.when(F.col("segment_type") == "fallback", F.array().cast(LINE_TYPE))
         .when(mm, F.col("mapf_path")).otherwise(F.col("astar_path")).alias("path"),
        "segment_type", "decision_branch", F.lit(True).alias("is_chosen"), "origin_lat", "origin_lon",
        F.col("astar_dist"), F.col("mapf_dist"), F.col("delay"), ts_literal(as_of).alias("created_at"))


# -- B7 / B9 -------------------------------------------------------------------

def route_candidates(positions: DataFrame, best_poi: DataFrame, pois: DataFrame, stops: DataFrame) -> DataFrame:
    """Up to two routing targets per located client: the best POI and the nearest stop.

    ``positions``: client_id, lat, lon, speed.  ``best_poi``: client_id, lat, lon (L2).
    The POI target carries the nearest stop and the id of the client's own
    POI within 30 m (J13); the stop target is the stop nearest the client.
    """
    from geotide.operators.spatial import nearest_neighbour, poi_match
    st = stops.where(F.coalesce(F.col("location_type"), F.lit(0)) == 0)
    bp = best_poi.select("client_id", F.col("lat").alias("goal_lat"), F.col("lon").alias("goal_lon"))
    bp = poi_match(bp, pois, ["client_id"], "goal_lat", "goal_lon").withColumnRenamed("matched_poi_id", "poi_id")
    bp = nearest_neighbour(bp, st, ["client_id"], "goal_lat", "goal_lon", "stop_lat", "stop_lon",
                           ["stop_id"], ["stop_id"]).drop("__knn_d")
    poi_t = positions.join(bp, "client_id").select(
        "client_id", F.col("lat").alias("origin_lat"), F.col("lon").alias("origin_lon"), "speed",
        "goal_lat", "goal_lon", F.lit("poi").alias("target_type"), "stop_id", "poi_id",
        F.lit("routed_to_poi").alias("decision_context"))
    ns = nearest_neighbour(positions, st, ["client_id"], "lat", "lon", "stop_lat", "stop_lon",
                           ["stop_id", "stop_lat", "stop_lon"], ["stop_id"])
    stop_t = ns.where(F.col("stop_id").isNotNull()).select(
        "client_id", F.col("lat").alias("origin_lat"), F.col("lon").alias("origin_lon"), "speed",
        F.col("stop_lat").alias("goal_lat"), F.col("stop_lon").alias("goal_lon"),
        F.lit("stop_point").alias("target_type"), "stop_id", F.lit(None).cast("long").alias("poi_id"),
        F.lit("fallback_stop_point").alias("decision_context"))
    return poi_t.unionByName(stop_t)


def route_eta(created_at: Column, distance: Column, speed: Column) -> Column:
    """ETA = created + distance / speed, walking speed when speed is null or not positive."""
    sp = F.when(speed.isNotNull() & (speed > 0), speed).otherwise(F.lit(WALKING_SPEED_MS))
    return add_seconds(created_at, distance / sp)


def multimodal_candidates(active_clients: DataFrame, astar: DataFrame, as_of) -> DataFrame:
    """Per active client, the newest A* row; when it has a stop, a MAPF row with the
    path of the newest A* route to that destination (what the reference's solver yields, D8)."""
    la = top_k_per_key(astar, ["client_id"], [desc("created_at"), desc("id")], 1, None) \
        .join(active_clients.select("client_id"), "client_id", "left_semi") \
        .where(F.col("stop_id").isNotNull() & (F.col("stop_id") != ""))
    paths = top_k_per_key(astar, ["client_id", "destination_lat", "destination_lon"],
                          [desc("created_at"), desc("id")], 1, None) \
        .select(F.col("client_id").alias("p_c"), F.col("destination_lat").alias("p_lat"),
                F.col("destination_lon").alias("p_lon"), F.col("path").alias("p_path"))
    j = la.join(paths, (la["client_id"] == paths["p_c"]) & (la["destination_lat"] == paths["p_lat"])
                & (la["destination_lon"] == paths["p_lon"]))
    return j.select("client_id", "stop_id", "destination_lat", "destination_lon", F.col("p_path").alias("path"),
                    path_length_m(F.col("p_path")).alias("distance"), F.lit(True).alias("success"),
                    F.lit("mapf_predicted").alias("decision_context"), ts_literal(as_of).alias("created_at"))


# -- B13 / B14 / W11 -------------------------------------------------------------

def deviation_streaks(ticks: DataFrame, choice: DataFrame) -> DataFrame:
    """Per client and tick, distance to the chosen path, off-path flag and the
    number of consecutive off-path ticks ending at that tick (reset only by an on-path tick).

    ``ticks``: client_id, tick_time, lat, lon.  ``choice``: client_id, segment_type, path.
    Gaps-and-islands: the running count of on-path ticks numbers the islands.
    """
    c = choice.select(F.col("client_id").alias("__c"), F.lower(F.coalesce("segment_type", F.lit(""))).alias("__st"),
                      F.col("path").alias("__path"))
    j = ticks.join(c, ticks["client_id"] == c["__c"])
    thr = F.when(F.col("__st") == "multimodal", F.lit(DEVIATION_METERS_MAPF)).otherwise(F.lit(DEVIATION_METERS_DIRECT))
    j = j.withColumn("deviation_m", point_to_path_m(F.col("lat"), F.col("lon"), F.col("__path"))) \
        .withColumn("off_path", F.col("deviation_m") > thr)
    order = ["tick_time", "lat", "lon", *(["id"] if "id" in ticks.columns else [])]
    w = Window.partitionBy("client_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("__island", F.sum(F.when(F.col("off_path"), 0).otherwise(1)).over(w))
    w2 = Window.partitionBy("client_id", "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("streak", F.sum(F.when(F.col("off_path"), 1).otherwise(0)).over(w2))
    return j.drop("__c", "__st", "__path", "__island")


def reroute_reasons(choice: DataFrame, positions: DataFrame, candidates: DataFrame, as_of,
                    streaks: DataFrame | None = None) -> DataFrame:
    """The first applying reroute reason per client (null = keep the route).

    ``choice``: current chosen route per client (client_id, segment_type, stop_id, path).
    ``positions``: client_id, lat, lon.  ``streaks``: client_id, streak (consecutive
    off-path ticks including this one); without it a single tick counts as 1.
    """
    c = choice.select("client_id", F.lower("segment_type").alias("seg"), F.col("stop_id").alias("choice_stop_id"), "path")
    j = positions.select("client_id", "lat", "lon").join(c, "client_id", "left")
    j = j.withColumn("seg", F.coalesce("seg", F.lit("")))  # also for clients without a choice
    dist = point_to_path_m(F.col("lat"), F.col("lon"), F.col("path"))
    thr = F.when(F.col("seg") == "multimodal", F.lit(DEVIATION_METERS_MAPF)).otherwise(F.lit(DEVIATION_METERS_DIRECT))
    j = j.withColumn("deviation_m", dist)
    if streaks is not None:
        j = j.join(streaks.select("client_id", F.col("streak").alias("__ticks")), "client_id", "left")
        streak = F.when(F.col("deviation_m") > thr, F.greatest(F.coalesce(F.col("__ticks"), F.lit(1)), F.lit(1))).otherwise(0)
    else:
        streak = F.when(F.col("deviation_m") > thr, F.lit(1)).otherwise(F.lit(0))
    j = j.withColumn("streak", streak)
    cand = candidates.select(F.col("client_id").alias("__cc"), F.col("stop_id").alias("__cs")).distinct() \
        .withColumn("__has", F.lit(True))
    dep = best_departure(candidates).select(F.col("client_id").alias("__dc"), F.col("stop_id").alias("__ds"),
                                            F.col("departure_time").alias("__dt"),
                                            F.coalesce(F.col("delay_seconds"), F.lit(0)).cast("double").alias("__dl"))
    j = j.join(cand, (j["client_id"] == cand["__cc"]) & (j["choice_stop_id"] == cand["__cs"]), "left") \
        .join(dep, (j["client_id"] == dep["__dc"]) & (j["choice_stop_id"] == dep["__ds"]), "left")
    mm = F.col("seg") == "multimodal"
    passed = seconds_between(ts_literal(as_of), F.col("__dt")) > DEPARTURE_STALE_SECONDS
    off_txt = F.when(F.isnan(F.col("deviation_m")) | (F.col("deviation_m") == float("inf")), F.lit("off_path_infm")) \
        .otherwise(F.concat(F.lit("off_path_"), F.col("deviation_m").cast("long").cast("string"), F.lit("m")))
    reason = F.when(F.col("path").isNull(), F.lit("no_path_in_choice")) \
        .when(F.col("streak") >= DEVIATION_STREAKS_REQUIRED, off_txt) \
        .when(mm & F.col("choice_stop_id").isNull(), F.lit("missing_stop_id")) \
        .when(mm & F.col("__has").isNull(), F.lit("no_departure_candidate")) \
        .when(mm & F.col("__ds").isNull(), F.lit("no_departure_row")) \
        .when(mm & passed, F.lit("departure_passed")) \
        .when(mm & (F.col("__dl") > DELAY_THRESHOLD_SECONDS),
              F.concat(F.lit("delay_"), F.col("__dl").cast("long").cast("string"), F.lit("s")))
    return j.select("client_id", "seg", "choice_stop_id", "deviation_m", "streak", reason.alias("reason"))


def reroute_events(before: DataFrame, after: DataFrame, reasons: DataFrame) -> DataFrame:
    """A reroute row for each client whose live route changed (segment, stop or path).

    ``before``/``after``: live route per client (client_id, stop_id, segment_type,
    origin/destination, path).  ``reasons``: client_id, reason.
    """
    b = before.select(F.col("client_id").alias("__b"), F.col("stop_id").alias("previous_stop_id"),
                      F.col("segment_type").alias("previous_segment_type"), F.col("path").alias("__bp"))
    j = after.join(reasons.select("client_id", "reason"), "client_id").join(b, F.col("client_id") == F.col("__b"), "left")
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    changed = F.col("__b").isNull() | (e(F.col("previous_segment_type")) != e(F.col("segment_type"))) \
        | (e(F.col("previous_stop_id")) != e(F.col("stop_id"))) | ~F.col("__bp").eqNullSafe(F.col("path"))
    return j.where(changed).select(
        "client_id", "stop_id", "origin_lat", "origin_lon", "destination_lat", "destination_lon",
        F.coalesce(F.col("path"), F.array().cast(LINE_TYPE)).alias("path"),
        F.coalesce(F.col("segment_type"), F.lit("unknown")).alias("segment_type"), "reason",
        "previous_stop_id", "previous_segment_type", F.lit(True).alias("is_chosen"), "created_at")


# -- W10 / G15 / B15 -------------------------------------------------------------

def weekly_schedule(predicted: DataFrame, routes_unified: DataFrame, clients: DataFrame,
                    prediction_type: str = "weekly") -> DataFrame:
    """Per (client, weekday) with >= 2 predictions, the concatenated path of the
    consecutive legs (W10) whose destination has a known route; time of the second
    prediction, position of the first."""
    p = predicted.where(F.col("prediction_type") == prediction_type) \
        .join(clients.select("client_id"), "client_id", "left_semi") \
        .select("client_id", F.col("predicted_lat").alias("lat"), F.col("predicted_lon").alias("lon"),
                F.col("predicted_visit_time").alias("ts"), F.col("id").alias("pid")) \
        .withColumn("visit_day", weekday_name(F.col("ts")))
    w = Window.partitionBy("client_id", "visit_day").orderBy(asc("ts"), asc("pid"))
    p = p.withColumn("seq", F.row_number().over(w)) \
        .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("client_id", "visit_day")))
    p = p.where(F.col("n") >= 2)
    anchor = p.where(F.col("seq") <= 2).groupBy("client_id", "visit_day").agg(
        F.min(F.struct("seq", "lat", "lon")).alias("__first"),
        F.max(F.when(F.col("seq") == 2, F.col("ts"))).alias("predicted_time"))
    # leg i -> i+1: route to the destination (point i+1), i.e. every point but the first
    r = top_k_per_key(routes_unified.where(F.size("path") >= 2), ["client_id", "destination_lat", "destination_lon"],
                      [desc("created_at"), asc("segment_type")], 1, None) \
        .select(F.col("client_id").alias("r_c"), F.col("destination_lat").alias("r_lat"),
                F.col("destination_lon").alias("r_lon"), F.col("path").alias("r_path"))
    legs = p.where(F.col("seq") >= 2).join(
        r, (F.col("client_id") == F.col("r_c")) & (F.col("lat") == F.col("r_lat")) & (F.col("lon") == F.col("r_lon")))
    segs = legs.groupBy("client_id", "visit_day").agg(
        F.sort_array(F.collect_list(F.struct("seq", "r_path"))).alias("__segs"))
    out = anchor.join(segs, ["client_id", "visit_day"])
    return out.select(
        F.xxhash64("client_id", "visit_day", F.lit(prediction_type)).alias("id"), "client_id", "visit_day",
        "predicted_time", F.lit(prediction_type).alias("prediction_type"),
        F.col("__first.lat").alias("poi_lat"), F.col("__first.lon").alias("poi_lon"),
        F.flatten(F.transform("__segs", lambda s: s["r_path"])).alias("path"),
        F.lit("behavioral_path").alias("segment_type"), F.lit(None).cast("timestamp_ntz").alias("created_at"))


def consecutive_legs(points: DataFrame, part: list[str], order: str) -> DataFrame:
    """origin = point i, destination = point i+1 within ``part``."""
    w = Window.partitionBy(*part).orderBy(order)
    return points.withColumn("dest_lat", F.lead("lat").over(w)).withColumn("dest_lon", F.lead("lon").over(w)) \
        .where(F.col("dest_lat").isNotNull())


def path_concat(segments: DataFrame, keys: list[str], pos: str = "pos", path: str = "path") -> DataFrame:
    """Vertices of ordered segments joined into one line per key."""
    g = segments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(pos, path))).alias("__s"))
    return g.select(*keys, F.flatten(F.transform("__s", lambda s: s[path])).alias("path"))


# -- B16 / K9 --------------------------------------------------------------------

def fresh_results(optimized: DataFrame, reroutes: DataFrame, sessions: DataFrame, as_of) -> DataFrame:
    """Valid optimized routes and reroutes of the last 60 s, each with the latest session
    containing its creation time (J5), newest first."""
    from geotide.operators.joins import session_asof
    cols = ["client_id", "stop_id", "destination_lat", "destination_lon", "path", "segment_type", "created_at"]
    o = optimized.where(F.col("is_valid") == F.lit(True)).select(*cols, F.lit("optimized").alias("__src"),
                                                                 F.col("id").alias("__id"))
    r = reroutes.select(*cols, F.lit("reroute").alias("__src"), F.col("id").alias("__id"))
    u = o.unionByName(r).where(F.col("created_at") >= ts_literal(as_of) - F.expr(f"INTERVAL {FRESH_WINDOW}"))
    j = session_asof(u, sessions, ["__src", "__id"])
    return j.withColumnRenamed("asof_session_id", "session_id").drop("__src", "__id") \
        .orderBy(F.col("created_at").desc())


def publish_payloads(results: DataFrame) -> DataFrame:
    """K9: (topic, payload JSON) per result row, deduplicated on (client, session, created_at) (T5)."""
    from geotide.functions.geo import wkt_linestring
    from geotide.functions.timefn import iso_format
    # of rows with one key the smallest by stop, segment and destination is published
    rest = [F.col(c).asc_nulls_last() for c in ("stop_id", "segment_type", "destination_lat", "destination_lon")]
    r = top_k_per_key(results, ["client_id", "session_id", "created_at"], rest, 1, None)
    topic = F.format_string("results/client/%s/session/%s", F.col("client_id"), F.col("session_id").cast("string"))
    payload = F.to_json(F.struct(
        F.col("client_id").cast("string").alias("client_id"), F.col("session_id").alias("session_id"),
        F.col("stop_id").alias("stop_id"),
        F.struct(F.col("destination_lat").alias("lat"), F.col("destination_lon").alias("lon")).alias("destination"),
        wkt_linestring(F.col("path")).alias("route_path"),
        F.coalesce(iso_format(F.col("created_at")), F.lit("")).alias("timestamp")), {"ignoreNullFields": "false"})
    return r.select(topic.alias("topic"), payload.alias("payload"), "client_id", "session_id", "created_at")
