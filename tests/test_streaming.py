import datetime as dt
import json
import os
import tempfile

import pandas as pd

from geotide.sources import telemetry
from geotide.streaming import pipelines as sp

T0 = dt.datetime(2024, 1, 1)


def _rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def _base(tag):
    return tempfile.mkdtemp(prefix=f"{tag}-", dir="/tmp")


def _batches(spark, folder, frames):
    """One file per frame, in order."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"b{i}"))


def _stream(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)


TICK = "client_id string, tick_time timestamp, off_path boolean"


def _ticks(spark, flags, start, client="c"):
    pdf = pd.DataFrame({"client_id": [client] * len(flags), "tick_time": [start + dt.timedelta(seconds=5 * j) for j in range(len(flags))],
                        "off_path": flags})
    return spark.createDataFrame(pdf, TICK)


def test_deviation_state_survives_batches(spark):
    base = _base("dev")
    _batches(spark, f"{base}/in", [_ticks(spark, f, T0 + dt.timedelta(minutes=10 * i)) for i, f in enumerate([[True, True], [False, True]])])
    sp.run_available_now(sp.deviation_state(_stream(spark, f"{base}/in", TICK)), f"{base}/out", f"{base}/ck")
    assert [r["streak"] for r in spark.read.parquet(f"{base}/out").orderBy("tick_time").collect()] == [1, 2, 0, 1]


def test_deviation_state_counts_across_chunks_and_drops_nothing(spark):
    """More rows than an Arrow chunk, shuffled; then a batch days behind the newest tick; then a long pause."""
    base = _base("dev")
    flags = [k % 97 != 0 for k in range(500)]
    late = T0 - dt.timedelta(days=3)
    _batches(spark, f"{base}/in", [_ticks(spark, flags, T0).orderBy("off_path"), _ticks(spark, [True], late),
                                   _ticks(spark, [True, True], T0 + dt.timedelta(days=4))])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        sp.run_available_now(sp.deviation_state(_stream(spark, f"{base}/in", TICK)), f"{base}/out", f"{base}/ck")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    got = {r["tick_time"]: r["streak"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert len(got) == 503
    n, want = 0, []
    for f in flags:
        n = n + 1 if f else 0
        want.append(n)
    assert [got[T0 + dt.timedelta(seconds=5 * k)] for k in range(500)] == want
    assert got[late] == n + 1  # in order of arrival
    assert [got[T0 + dt.timedelta(days=4, seconds=5 * k)] for k in (0, 1)] == [1, 2]  # idle for over 26 h


def test_ingest_and_migration_do_not_depend_on_batches(spark):
    """Files in no order, one, two or all of them per micro-batch: equal tables, and those of a batch run."""
    from geotide.operators.behaviour import trajectory_build
    from geotide.operators.joins import sessionize_by_window
    from geotide.sources.bindings import AS_OF, MobilityTables
    t = MobilityTables(spark, "/root/testdata/sf0.001")
    base = _base("ing")
    messages = telemetry.telemetry_messages(t.trajectories, t.mqtt_sessions)
    messages.repartition(4).write.json(f"{base}/in")
    parsed = telemetry.telemetry_parse(messages)
    sessions = _rows(telemetry.telemetry_sessions(parsed), "client_id", "start_time", "end_time")
    points = _rows(telemetry.telemetry_points(parsed), "client_id", "lat", "lon", "timestamp")
    for files in (1, 2, 100):
        tables = sp.stream_ingest(sp.read_telemetry_stream(spark, f"{base}/in", files), f"{base}/out{files}", f"{base}/ck{files}")
        assert _rows(tables["sessions"].rows(), "client_id", "start_time", "end_time") == sessions
        assert _rows(tables["points"].rows(), "client_id", "lat", "lon", "timestamp") == points
    pts = sessionize_by_window(t.geodata, t.mqtt_sessions).select(*sp.MIGRATED_POINT)
    pts.repartition(4).write.parquet(f"{base}/pts")
    want = _rows(trajectory_build(pts.where(pts["end_time"] <= AS_OF)), "id", "client_id", "trajectory", "created_at")
    for files in (1, 100):
        sp.stream_migrate(_stream(spark, f"{base}/pts", pts.schema, files), f"{base}/mig{files}", f"{base}/mck{files}", AS_OF)
        assert _rows(sp.migrated(spark, f"{base}/mig{files}"), "id", "client_id", "trajectory", "created_at") == want


def _message(client, start, end, points):
    iso = lambda t: None if t is None else t.isoformat()
    track = [{"lat": 1.0, "lon": 2.0, "elevation": None, "speed": s, "activity": a, "timestamp": iso(x)} for x, s, a in points]
    return {"topic": f"client/{client}/session/1/", "payload": json.dumps({"start_time": iso(start), "end_time": iso(end), "trajectory": track})}


def test_the_earliest_end_and_the_least_point_win_in_any_batches(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    files = [_message("a", h(8), h(10), [(h(9), 3.0, "walk")]), _message("a", h(8), h(9), [(h(9), 2.0, "run")]),
             _message("a", h(8), h(11), [(h(9), 2.0, "bus"), (h(10), None, None)]), _message("b", h(8), None, [(h(9), 1.0, "walk")])]
    results = []
    for order, per_batch in (((0, 1, 2, 3), 1), ((2, 1, 0, 3), 1), ((0, 1, 2, 3), 2), ((0, 1, 2, 3), 100)):
        base = _base("end")
        os.makedirs(f"{base}/in")
        for n, k in enumerate(order):
            with open(f"{base}/in/{n}.json", "w") as f:
                f.write(json.dumps(files[k]) + "\n")
            os.utime(f"{base}/in/{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
        tables = None
        for _ in range(2):  # the second run finds nothing new
            tables = sp.stream_ingest(sp.read_telemetry_stream(spark, f"{base}/in", per_batch), f"{base}/out", f"{base}/ck",
                                      sp.DEFAULT_SESSION_LENGTH)
        results.append((_rows(tables["sessions"].rows(), "client_id", "end_time"),
                        _rows(tables["points"].rows(), "client_id", "timestamp", "speed", "activity")))
    assert all(r == results[0] for r in results)
    sessions, points = results[0]
    assert sessions == sorted(map(str, spark.createDataFrame([("a", h(9)), ("b", h(34))], "client_id string, end_time timestamp_ntz").collect()))
    assert len(points) == 3 and "speed=2.0, activity='bus'" in points[1] + points[0]
    base = _base("end")
    os.makedirs(f"{base}/in")
    with open(f"{base}/in/x.json", "w") as f:
        f.write(json.dumps(files[3]) + "\n")
    assert sp.stream_ingest(sp.read_telemetry_stream(spark, f"{base}/in"), f"{base}/out", f"{base}/ck")["sessions"].rows().count() == 0


def test_sessions_close_by_the_timer(spark):
    """Session 2 has its last point at 09:00 and ends at 12:00; 4 gets a late point after it was migrated."""
    h = lambda n: T0 + dt.timedelta(hours=n)
    schema = ("client_id string, session_id long, lat double, lon double, elevation double, speed double, activity string, "
              "timestamp timestamp_ntz, start_time timestamp_ntz, end_time timestamp_ntz")

    def points(*of):
        return spark.createDataFrame([("c", s, 1.0, float(k), None, 1.0, "walk", h(t), h(0), h(end)) for k, (s, t, end) in enumerate(of)], schema)

    for files in (1, 2, 100):
        base = _base("close")
        _batches(spark, f"{base}/in", [points((1, 8, 9), (2, 9, 12)), points((4, 7, 9.5), (1, 8.5, 9))])
        got = []
        for as_of, more in ((h(10), points((3, 13, 13.5), (4, 7.5, 9.5))), (h(14), None), (h(20), None)):
            src = _stream(spark, f"{base}/in", schema, files)
            sp.stream_migrate(src, f"{base}/out", f"{base}/ck", as_of)
            got.append({r["session_id"]: len(r["trajectory"]) for r in sp.migrated(spark, f"{base}/out").collect()})
            if more is not None:
                more.coalesce(1).write.parquet(f"{base}/in/more")
        assert got == [{1: 2, 4: 1}, {1: 2, 2: 1, 3: 1, 4: 2}, {1: 2, 2: 1, 3: 1, 4: 2}]
        versions = spark.read.parquet(f"{base}/out/log").groupBy("session_id").count()
        assert {r[0]: r[1] for r in versions.collect()} == {1: 1, 2: 1, 3: 1, 4: 2}  # the last trigger rebuilt nothing


def test_results_are_published_once_over_two_runs(spark):
    schema = "client_id string, session_id long, created_at timestamp_ntz"
    row = lambda c, s: (c, 1, T0 + dt.timedelta(seconds=s))
    base = _base("pub")

    def run(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/b{k}")
        sp.publish_once(_stream(spark, f"{base}/in", schema), f"{base}/out", f"{base}/ck")
        return sorted((r[0], (r[2] - T0).seconds) for r in spark.read.schema(schema).parquet(f"{base}/out").collect())

    assert run(0, [row("a", 600), row("a", 600), row("b", 610)]) == [("a", 600), ("b", 610)]
    assert run(1, [row("a", 600), row("c", 615), row("c", 900)]) == [("a", 600), ("b", 610), ("c", 615), ("c", 900)]
    # 30 s is long before the newest result less the horizon: stale; the repeat of 900 is not published again
    assert run(2, [row("d", 30), row("c", 900), row("d", 890)]) == [("a", 600), ("b", 610), ("c", 615), ("c", 900), ("d", 890)]


FEED = {"header": {"timestamp": "1704067200"}, "entity": [
    {"id": "1", "vehicle": {"vehicle": {"id": "v"}, "trip": {"tripId": "t", "routeId": "r"}, "stopId": "s", "timestamp": "1704067201",
                            "position": {"latitude": 1.5, "longitude": 2.5, "speed": 3.0, "bearing": 90.0}}},
    {"id": "2", "tripUpdate": {"trip": {"tripId": "t"}, "stopTimeUpdate": [
        {"stopId": "s", "arrival": {"time": "1704067210", "delay": "7"}, "departure": {"time": 1704067220, "delay": 99},
         "scheduleRelationship": "SKIPPED"}, {"stopId": "q"}]}},
    {"id": "3", "alert": {"cause": "STRIKE", "headerText": {"translation": [{"text": "H"}, {"text": "zweite"}]},
                          "informedEntity": [{"routeId": "", "stopId": "s1"}, {"trip": {"tripId": "t9"}}, {}],
                          "activePeriod": [{"start": "1704067200"}]}},
    {"id": "4"}]}


def test_feeds_go_into_three_tables_once(spark):
    base = _base("feed")
    os.makedirs(f"{base}/in")

    def put(name, feed):
        with open(f"{base}/in/{name}", "w") as f:
            f.write(json.dumps({"feed_json": json.dumps(feed), "read_at": "2024-01-01 00:00:05"}) + "\n")

    put("a.json", FEED)
    put("b.json", {"entity": []})
    tables = sp.rt_feed_ingest(sp.read_feed_stream(spark, f"{base}/in", 1), f"{base}/out", f"{base}/ck")
    ts = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    v = tables["vehicle_positions"].collect()
    assert [tuple(r) for r in v] == [("v", "t", "r", "s", 1.5, 2.5, 3.0, 90.0, ts(1), ts(5))]
    u = sorted(tuple(r) for r in tables["trip_updates"].collect())
    assert u == [("t", "q", None, None, None, "SCHEDULED", ts(5)), ("t", "s", ts(10), ts(20), 7, "SKIPPED", ts(5))]
    alerts = {r["affected_entity"]: r for r in tables["service_alerts"].collect()}
    assert set(alerts) == {"s1", "t9", "unknown"} and len({r["alert_id"] for r in alerts.values()}) == 3
    one = alerts["s1"]
    assert (one["cause"], one["effect"], one["header_text"], one["description_text"], one["start_time"], one["end_time"]) \
        == ("STRIKE", "UNKNOWN_EFFECT", "H", "", ts(0), None)
    # a batch delivered again, as after a lost commit of the stream, adds nothing
    log = sp.BatchLog(spark, f"{base}/out")
    feeds = spark.createDataFrame([(json.dumps(FEED), dt.datetime(2024, 1, 1, 0, 0, 5))], "feed_json string, read_at timestamp_ntz")
    assert not log.append(0, sp.rt_feed_tables(feeds))
    tables = sp.rt_feed_ingest(sp.read_feed_stream(spark, f"{base}/in", 1), f"{base}/out", f"{base}/ck")
    assert [tables[n].count() for n in sp.FEED_TABLES] == [1, 2, 3]
    put("c.json", FEED)  # the same feed in a further file: rows append, alerts are known by id
    tables = sp.rt_feed_ingest(sp.read_feed_stream(spark, f"{base}/in", 1), f"{base}/out", f"{base}/ck")
    assert [tables[n].count() for n in sp.FEED_TABLES] == [2, 4, 3]


def test_clients_leave_when_idle(spark):
    schema = "client_id string, timestamp timestamp_ntz, updated_at timestamp_ntz"
    h = lambda n: T0 + dt.timedelta(hours=n)
    base = _base("live")

    def run(k, as_of, rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/b{k}")
        sp.stream_last_seen(_stream(spark, f"{base}/in", schema), f"{base}/out", f"{base}/ck", as_of)
        return sorted(r[0] for r in sp.live_active_clients(spark, f"{base}/out", as_of).collect())

    assert run(0, h(10), [("a", h(1), h(1)), ("b", h(9), h(9)), ("old", h(-20), h(-20)), ("fresh", h(-20), h(10) - dt.timedelta(seconds=1))]) \
        == ["a", "b", "fresh"]
    assert run(1, h(28), [("c", h(28), h(28)), ("b", h(2), h(2))]) == ["b", "c"]
    assert run(2, h(40), []) == ["c"]
    assert run(3, h(41), [("a", h(41), h(41))]) == ["a", "c"]
    assert {r[0] for r in sp.last_seen(spark, f"{base}/out").collect()} == {"a", "c"}  # idle clients are not kept


def test_sessions_by_gap(spark):
    pts = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=m)) for m in (0, 10, 29, 60, 61)] + [("b", T0), ("b", None)],
                                "client_id string, timestamp timestamp_ntz")
    got = sorted((r[0], int((r[1] - T0).total_seconds() / 60), int((r[2] - T0).total_seconds() / 60), r[3])
                 for r in telemetry.sessions_by_gap(pts, "30 minutes").collect())
    assert got == [("a", 0, 59, 3), ("a", 60, 91, 2), ("b", 0, 30, 1)]
