import datetime as dt
import os
import tempfile

from geotide.operators import writes
from geotide.sources import gtfs, telemetry


def test_telemetry_points_filter(spark):
    payload = ('{"start_time": "2024-01-01T08:00:00", "end_time": "2024-01-01T09:00:00", "trajectory": ['
               '{"lat": null, "lon": 18.0, "timestamp": "2024-01-01T08:00:01"},'
               '{"lat": 59.3, "lon": 18.0, "timestamp": ""},'
               '{"lat": 59.3, "lon": 18.0, "timestamp": "null"},'
               '{"lat": 59.3, "lon": 18.0, "speed": 1.5, "timestamp": "2024-01-01T08:00:04"}]}')
    msgs = spark.createDataFrame([("client/abc/session/1/", payload), ("bad", payload),
                                  ("client/x/session/2/", '{"trajectory": []}')], "topic string, payload string")
    parsed = telemetry.telemetry_parse(msgs)
    assert [r["client_id"] for r in parsed.collect()] == ["abc"]
    pts = telemetry.telemetry_points(parsed).collect()
    assert len(pts) == 1 and pts[0]["timestamp"] == dt.datetime(2024, 1, 1, 8, 0, 4) and pts[0]["speed"] == 1.5


def test_gtfs_csv_lenient(spark):
    d = tempfile.mkdtemp(prefix="gtfs-", dir="/tmp")
    with open(os.path.join(d, "stops.txt"), "w") as f:
        f.write("stop_id,stop_name,stop_lat,stop_lon,location_type\n1,A,59.3,18.0,3\n2,B,abc,18.1,999\n3,C,59.4,18.2,\n")
    with open(os.path.join(d, "calendar_dates.txt"), "w") as f:
        f.write("service_id,date,exception_type\ns1,20240105,7\ns2,notadate,0\n")
    b = gtfs.read_gtfs_bundle(spark, d)
    assert set(b) == {"gtfs_stops", "gtfs_calendar_dates"}
    st = {r["stop_id"]: r for r in b["gtfs_stops"].collect()}
    assert st["2"]["stop_lat"] is None and st["2"]["location_type"] == 255
    assert st["3"]["location_type"] == 0 and st["1"]["platform_code"] is None
    cd = {r["service_id"]: r for r in b["gtfs_calendar_dates"].collect()}
    assert cd["s1"]["date"] == dt.date(2024, 1, 5) and cd["s1"]["exception_type"] == 2
    assert cd["s2"]["date"] is None and cd["s2"]["exception_type"] == 1


def test_insert_ignore_and_delete(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 3)], "k string, v int")
    from pyspark.sql import functions as F
    got = writes.insert_ignore(target, new, ["k"], [F.col("v").asc()]).collect()
    assert [(r["k"], r["v"]) for r in got] == [("b", 2)]
    left = writes.delete_by_keys(new, spark.createDataFrame([("b",)], "k string"), ["k"]).collect()
    assert [r["k"] for r in left] == ["a"]


def test_upsert_hotspots_keeps_created(spark):
    t0, now = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
    old = spark.createDataFrame([(1, "c", 59.3, 18.0, 5.0, 3.0, "hotspot", None, "trajectory", t0, t0)],
                                "hotspot_id long, client_id string, lat double, lon double, radius double, "
                                "density double, type string, time_spent double, source_type string, "
                                "created_at timestamp_ntz, updated_at timestamp_ntz")
    new = spark.createDataFrame([("c", 59.3, 18.0, 9.0, 7.0, "hotspot", "poi"),
                                 ("c", 59.4, 18.0, 1.0, 5.0, "hotspot", "poi")],
                                "client_id string, lat double, lon double, radius double, density double, type string, "
                                "source_type string")
    got = {r["lat"]: r for r in writes.upsert_hotspots(old, new, now).collect()}
    assert got[59.3]["radius"] == 9.0 and got[59.3]["created_at"] == t0 and got[59.3]["updated_at"] == now
    assert got[59.4]["created_at"] == now


def test_retention(spark):
    now = dt.datetime(2024, 1, 31)
    df = spark.createDataFrame([(now - dt.timedelta(days=d),) for d in (1, 27, 29, 40)], "created_at timestamp_ntz")
    kept, expired = writes.retention_ttl(df, now)
    assert kept.count() == 2 and expired.first()["expired"] == 2


def test_gtfs_zip(spark):
    """Archives read by tasks: doubled quotes, line ends in a field, a byte-order mark, numbers out of range, short rows, a missing member."""
    import datetime as dt
    import zipfile
    d = tempfile.mkdtemp(prefix="zip-", dir="/tmp")
    stops = '\ufeffstop_id,stop_name,stop_lat,stop_lon,location_type,extra\n1,"The ""Old"" Square, north",59.3,18.1,99999999999,x\n' \
        '2,"two\nlines",abc,,-5,\n3,short\n\n'
    with zipfile.ZipFile(f"{d}/a.zip", "w") as z:
        z.writestr("stops.txt", stops)
        z.writestr("calendar_dates.txt", "service_id,date,exception_type\r\ns,20240229,7\r\ns,20240230,\r\n")
        z.writestr("calendar.txt", "service_id,monday,sunday,start_date,end_date\ns,1,5,20240101,never\n")
        z.writestr("routes.txt", "route_id,route_type\n")
        z.writestr("feed_info.txt", "ignored")
    with zipfile.ZipFile(f"{d}/b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("trips.txt", "trip_id,route_id,direction_id\n" + "".join(f"t{k},r,{k}\n" for k in range(20_000)))
        z.writestr("stops.txt", "stop_id\n9\n")
    one = gtfs.read_gtfs_zip(spark, f"{d}/a.zip")
    assert set(one) == {"gtfs_stops", "gtfs_calendar_dates", "gtfs_calendar", "gtfs_routes"}
    st = {r["stop_id"]: r for r in one["gtfs_stops"].collect()}
    assert set(st) == {"1", "2", "3"} and one["gtfs_routes"].count() == 0
    assert (st["1"]["stop_name"], st["1"]["stop_lat"], st["1"]["location_type"]) == ('The "Old" Square, north', 59.3, 255)
    assert (st["2"]["stop_name"], st["2"]["stop_lat"], st["2"]["stop_lon"], st["2"]["location_type"]) == ("two\nlines", None, None, 0)
    assert (st["3"]["stop_name"], st["3"]["stop_lat"], st["3"]["location_type"]) == ("short", None, 0)
    assert sorted((r["date"], r["exception_type"]) for r in one["gtfs_calendar_dates"].where("date is not null").collect()) == [(dt.date(2024, 2, 29), 2)]
    assert [r["exception_type"] for r in one["gtfs_calendar_dates"].where("date is null").collect()] == [1]
    cal = one["gtfs_calendar"].collect()[0]
    assert (cal["monday"], cal["tuesday"], cal["sunday"], cal["start_date"], cal["end_date"]) == (1, 0, 1, dt.date(2024, 1, 1), None)
    both = gtfs.read_gtfs_zip(spark, d)
    assert both["gtfs_stops"].count() == 4 and both["gtfs_trips"].count() == 20_000
    assert [r[0] for r in both["gtfs_trips"].select("direction_id").distinct().orderBy("direction_id").collect()] == [0, 1]
