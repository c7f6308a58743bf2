import datetime as dt

from geotide.operators.behaviour import detect_pois


def test_detect_pois_fixture(spark):
    t0 = dt.datetime(2024, 1, 1, 8, 0, 0)
    rows = [("c", 1, 59.3, 18.0, 5.0, t0),
            ("c", 1, 59.31, 18.0, 5.0, t0 + dt.timedelta(seconds=591)),
            ("c", 1, 59.32, 18.0, 5.0, t0 + dt.timedelta(seconds=1181)),
            ("c", 1, 59.33, 18.0, 0.5, t0 + dt.timedelta(seconds=1182))]
    df = spark.createDataFrame(rows, "client_id string, session_id long, lat double, lon double, speed double, "
                                     "timestamp timestamp_ntz")
    out = sorted(detect_pois(df).collect(), key=lambda r: r["visit_start"])
    assert [r["time_spent"] for r in out] == [591.0, 0.0]
    assert [r["lat"] for r in out] == [59.3, 59.33]
    assert out[0]["visit_end"] == t0 + dt.timedelta(seconds=591)
    assert out[0]["poi_rank"] == 591.0 and out[0]["duration_seconds"] == 591
