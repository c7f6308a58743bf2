import datetime as dt

from pyspark.sql import functions as F

from geotide.functions.geo import LINE_TYPE
from geotide.operators import routing as rt

AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
LINE = "array<struct<lon:double,lat:double>>"


def test_blend_scores(spark):
    df = spark.createDataFrame([(0.6, 0.4, 0.5, 0.5), (0.3, 0.3, 0.5, 0.5)],
                               "sa double, sm double, ra double, rm double")
    out = df.select(rt.blend_scores(F.col("sa"), F.col("sm"), F.col("ra"), F.col("rm"), F.lit(False)).alias("b")) \
        .collect()
    assert abs(out[0]["b"]["p_astar"] - 0.925) < 1e-12 and abs(out[0]["b"]["p_mapf"] - 0.075) < 1e-12
    assert out[1]["b"]["p_astar"] == 0.5 and out[1]["b"]["p_mapf"] == 0.5


def _route_frames(spark):
    t0 = dt.datetime(2024, 1, 30, 12, 0, 0)
    path = [(18.0, 59.3), (18.01, 59.31)]
    # targets for c1..c5 (c0 has no POI, so it is absent)
    targets = spark.createDataFrame([(f"c{i}", 59.31, 18.01) for i in range(1, 6)], "client_id string, lat double, lon double")
    astar = spark.createDataFrame(
        [(i, f"c{i}", "poi", 59.31, 18.01, path, dist, 59.3, 18.0, t0)
         for i, dist in [(2, 1000.0), (3, 1000.0), (4, 500.0), (5, 2000.0)]],
        f"id long, client_id string, target_type string, destination_lat double, destination_lon double, path {LINE}, "
        "distance double, origin_lat double, origin_lon double, created_at timestamp_ntz")
    mapf = spark.createDataFrame(
        [(i, f"c{i}", "7", 59.31, 18.01, path, 600.0, True, t0) for i in (3, 4, 5)],
        f"id long, client_id string, stop_id string, destination_lat double, destination_lon double, path {LINE}, "
        "distance double, success boolean, created_at timestamp_ntz")
    cand = spark.createDataFrame(
        [(f"c{i}", "7", "t1", t0, 30, "r1", t0) for i in (4, 5)],
        "client_id string, stop_id string, trip_id string, departure_time timestamp_ntz, delay_seconds int, "
        "route_id string, predicted_eta timestamp_ntz")
    prof = spark.createDataFrame([], "client_id string, stop_id string, avg_switch_seconds int")
    opt = spark.createDataFrame([], "client_id string, segment_type string")
    geo = spark.createDataFrame([("c1", 59.31, 18.02, 1.0, t0 - dt.timedelta(hours=1), t0 - dt.timedelta(hours=1), 1)],
                                "client_id string, lat double, lon double, speed double, updated_at timestamp_ntz, "
                                "timestamp timestamp_ntz, id long")
    return targets, astar, mapf, cand, prof, opt, geo


def test_choose_route_branches(spark):
    out = {r["client_id"]: r for r in rt.choose_route(*_route_frames(spark), AS_OF).collect()}
    assert "c0" not in out
    assert out["c1"]["segment_type"] == "fallback" and out["c1"]["decision_branch"] == "no_astar"
    assert (out["c1"]["origin_lat"], out["c1"]["origin_lon"]) == (59.31, 18.02)  # where the client is
    assert out["c2"]["segment_type"] == "direct" and out["c2"]["decision_branch"] == "no_mapf"
    assert out["c3"]["segment_type"] == "direct" and out["c3"]["decision_branch"] == "no_departure"
    # heuristic: 500 < 600 + 100 + 30 -> direct ; 2000 >= 730 -> multimodal
    assert out["c4"]["segment_type"] == "direct"
    assert out["c5"]["segment_type"] == "multimodal" and out["c5"]["stop_id"] == "7"


def test_choose_route_with_a_scorer(spark):
    """Only clients with both routes and a departure are scored; one or two scores a row; the tie-break."""
    targets, astar, mapf, cand, prof, opt, geo = _route_frames(spark)

    def run(scorer, profiles=prof):
        out = rt.choose_route(targets, astar, mapf, cand, profiles, opt, geo, AS_OF, scorer=scorer).collect()
        return {r["client_id"]: (r["segment_type"], r["decision_branch"]) for r in out}

    others = {"c1": ("fallback", "no_astar"), "c2": ("direct", "no_mapf"), "c3": ("direct", "no_departure")}
    # one score, for the multimodal route: of the longer direct route c5's is larger
    assert run(lambda a, m: a[:, 0]) == {**others, "c4": ("direct", "scored"), "c5": ("direct", "scored")}
    assert run(lambda a, m: a[:, 0] * 2) == {**others, "c4": ("direct", "scored"), "c5": ("multimodal", "scored")}
    assert run(lambda a, m: a[:, [1, 1]] + [[0.2, 0.7]]) == {**others, "c4": ("multimodal", "scored"), "c5": ("multimodal", "scored")}
    # equal scores: direct, but where departures are late by little and the client switches fast
    fast = spark.createDataFrame([("c4", "7", 120), ("c5", "7", 121)], "client_id string, stop_id string, avg_switch_seconds int")
    nobody = spark.createDataFrame([("c9", "7", 1)], "client_id string, stop_id string, avg_switch_seconds int")
    tie = lambda a, m: 0.5 + 0 * a[:, 0]
    cand = cand.withColumn("route_id", F.lit(None).cast("string"))
    assert run(tie, nobody) == {**others, "c4": ("direct", "scored"), "c5": ("direct", "scored")}
    assert run(tie, fast) == {**others, "c4": ("multimodal", "scored"), "c5": ("direct", "scored")}


def test_route_features(spark):
    pairs = spark.createDataFrame([("a", 2500.0, 9000.0), ("b", 0.0, -1.0)], "client_id string, astar_dist double, mapf_dist double")
    opt = spark.createDataFrame([("a", "direct"), ("a", "Multimodal"), ("a", "fallback"), ("a", "direct")], "client_id string, segment_type string")
    geo = spark.createDataFrame([("a", 3.0, AS_OF, AS_OF, 1), ("a", 99.0, AS_OF - dt.timedelta(hours=1), AS_OF, 2)],
                                "client_id string, speed double, updated_at timestamp_ntz, timestamp timestamp_ntz, id long")
    noon = AS_OF.replace(hour=23)
    f = {r["client_id"]: (list(r["astar"]), list(r["mapf"])) for r in rt.route_features(pairs, opt, geo, noon).collect()}
    assert f["a"] == ([0.5, 0.0, 1.0, 0.5, 0.5, 0.25], [1.0, 1.0, 1.0, 0.5, 0.5, 0.25])
    assert f["b"] == ([0.0, 0.0, 1.0, 0.0, 0.5, 0.5], [0.0, 1.0, 1.0, 0.0, 0.5, 0.5])


def test_reroute_reasons(spark):
    t_old = AS_OF - dt.timedelta(seconds=100)
    line = [(18.0, 59.3), (18.01, 59.3)]
    choice = spark.createDataFrame([
        ("nopath", "direct", "direct", None),
        ("off", "direct", "direct", line),
        ("onpath", "direct", "direct", line),
        ("nostop", "multimodal", None, line),
        ("nocand", "multimodal", "9", line),
        ("passed", "multimodal", "7", line),
        ("late", "multimodal", "8", line)],
        f"client_id string, segment_type string, stop_id string, path {LINE}")
    pos = spark.createDataFrame([(c, 59.3 if c != "off" else 59.31, 18.005) for c in
                                 ["nopath", "off", "onpath", "nostop", "nocand", "passed", "late"]],
                                "client_id string, lat double, lon double")
    cand = spark.createDataFrame([("passed", "7", "t", t_old, 0), ("late", "8", "t", AS_OF, 200)],
                                 "client_id string, stop_id string, trip_id string, departure_time timestamp_ntz, "
                                 "delay_seconds int").withColumn("predicted_eta", F.lit(None).cast("timestamp_ntz"))
    streaks = spark.createDataFrame([("off", 2)], "client_id string, streak int")
    got = {r["client_id"]: r["reason"] for r in rt.reroute_reasons(choice, pos, cand, AS_OF, streaks).collect()}
    assert got["nopath"] == "no_path_in_choice"
    assert got["off"].startswith("off_path_") and got["off"].endswith("m")
    assert got["onpath"] is None
    assert got["nostop"] == "missing_stop_id"
    assert got["nocand"] == "no_departure_candidate"
    assert got["passed"] == "departure_passed"
    assert got["late"] == "delay_200s"
    single = {r["client_id"]: r["reason"] for r in rt.reroute_reasons(choice, pos, cand, AS_OF).collect()}
    assert single["off"] is None  # one off-path tick is not enough


def test_deviation_streaks(spark):
    t0 = dt.datetime(2024, 1, 1)
    line = [(18.0, 59.3), (18.01, 59.3)]
    ticks = spark.createDataFrame([("c", t0 + dt.timedelta(seconds=5 * i), 59.3 if on else 59.31, 18.005)
                                   for i, on in enumerate([True, False, False, True, False])],
                                  "client_id string, tick_time timestamp_ntz, lat double, lon double")
    choice = spark.createDataFrame([("c", "direct", line)], f"client_id string, segment_type string, path {LINE}")
    got = [r["streak"] for r in rt.deviation_streaks(ticks, choice).orderBy("tick_time").collect()]
    assert got == [0, 1, 2, 0, 1]


def test_reroute_events_only_changes(spark):
    line = [(18.0, 59.3), (18.01, 59.3)]
    cols = (f"client_id string, stop_id string, segment_type string, origin_lat double, origin_lon double, "
            f"destination_lat double, destination_lon double, path {LINE}, created_at timestamp_ntz")
    before = spark.createDataFrame([("a", "direct", "direct", 1.0, 1.0, 2.0, 2.0, line, AS_OF),
                                    ("b", "direct", "direct", 1.0, 1.0, 2.0, 2.0, line, AS_OF)], cols)
    after = spark.createDataFrame([("a", "direct", "direct", 1.0, 1.0, 2.0, 2.0, line, AS_OF),
                                   ("b", "7", "multimodal", 1.0, 1.0, 2.0, 2.0, line, AS_OF),
                                   ("c", "direct", "direct", 1.0, 1.0, 2.0, 2.0, line, AS_OF)], cols)
    reasons = spark.createDataFrame([(c, "delay_200s") for c in "abc"], "client_id string, reason string")
    got = {r["client_id"]: r for r in rt.reroute_events(before, after, reasons).collect()}
    assert set(got) == {"b", "c"}
    assert got["b"]["previous_segment_type"] == "direct" and got["b"]["segment_type"] == "multimodal"
