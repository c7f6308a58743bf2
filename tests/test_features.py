"""Training vectors from seven sources, windows across block borders, padding with ties, scalers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from geotide.operators import features as ft

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_seven_sources_take_one_form(spark):
    pos = "lat double, lon double, timestamp timestamp_ntz"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    patterns = frame([(1.0, 1.0, at(5)), (None, 1.0, at(5)), (9.0, 9.0, None)], pos)
    pois = frame([(1.0, 1.0, at(5)), (2.0, 2.0, at(6))], "lat double, lon double, visit_start timestamp_ntz")
    predicted = frame([(3.0, 3.0, at(7))], "predicted_lat double, predicted_lon double, predicted_visit_time timestamp_ntz")
    astar = frame([(4.0, 4.0, at(8)), (4.0, 4.0, at(8))], "origin_lat double, origin_lon double, created_at timestamp_ntz")
    mapf = frame([(5.0, 5.0, at(8))], "destination_lat double, destination_lon double, created_at timestamp_ntz")
    stops = frame([(6.0, 6.0)], "stop_lat double, stop_lon double")
    vehicles = frame([(1.0, 1.0, at(29)), (7.0, 7.0, at(1))], "position_lat double, position_lon double, timestamp timestamp_ntz")
    point = "struct<lat:double,lon:double,elevation:double,speed:double,activity:string,timestamp:string>"
    track = [(1.0, 1.0, 2.0, 3.0, " Walking ", at(4.9).isoformat()), (1.0, 1.0, 8.0, 9.0, "bus", at(29).isoformat()),
             (8.0, 8.0, None, 1.0, "idle", at(1).isoformat()), (8.5, 8.5, 1.0, None, "idle", at(1).isoformat()),
             (8.6, 8.6, 1.0, 1.0, "idle", "nonsense"), (8.7, 8.7, 1.0, 0.5, "stop", at(0).isoformat())]
    trajectories = frame([(track,)], f"trajectory array<{point}>")
    out = {(r["lat"], round(r["hour"] * 23)): r for r in ft.training_vectors(patterns, pois, predicted, astar, mapf, stops, vehicles, trajectories).collect()}
    assert set(out) == {(1.0, 5), (1.0, 4), (2.0, 6), (3.0, 7), (4.0, 8), (5.0, 8), (7.0, 1), (8.7, 0)}
    first = out[1.0, 5]  # pattern before POI at the same time; the vehicle and the trajectory point come a day later
    assert (first["timestamp"], first["speed"], first["act_unknown"], first["act_walk"]) == (at(5), 0.0, 1, 0)
    assert (out[1.0, 4]["speed"], out[1.0, 4]["elevation"], out[1.0, 4]["act_walk"]) == (3.0, 2.0, 1)
    assert out[8.7, 0]["act_stationary"] == 1


@pytest.mark.parametrize("n, steps, block", [(500, 7, 16), (100, 60, 64), (61, 60, 4096), (60, 60, 4096), (0, 5, 8)])
def test_windows_cross_blocks_and_ties(spark, n, steps, block):
    r = random.Random(n)
    rows = [(float(k), float(r.randint(0, 3)), r.random(), T0 + dt.timedelta(minutes=r.randint(0, n // 4))) for k in range(n)]
    df = spark.createDataFrame(rows, "lat double, lon double, speed double, timestamp timestamp_ntz").repartition(5)
    got = ft.sequence_windows(df, order=("timestamp", "lon", "lat"), features=("lat", "lon", "speed"), steps=steps, block=block)
    ordered = sorted(rows, key=lambda x: (x[3], x[1], x[0]))
    want = {k: ([list(x[:3]) for x in ordered[k - steps:k]], ordered[k][0], ordered[k][1]) for k in range(steps, n)}
    assert {x["idx"]: ([list(w) for w in x["window"]], x["label_lat"], x["label_lon"]) for x in got.collect()} == want


def test_pad_repeats_the_earliest_row(spark):
    df = spark.createDataFrame([("a", at(2), 3.0), ("a", at(1), 1.0), ("a", at(1), 2.0), ("b", at(0), 7.0)], "client_id string, timestamp timestamp_ntz, x double")
    got = {r["client_id"]: [v[0] for v in r["sequence"]] for r in ft.sequence_pad(df, features=("x",), steps=4).collect()}
    assert got == {"a": [1.0, 1.0, 2.0, 3.0], "b": [7.0] * 4}
    two = {r["client_id"]: [v[0] for v in r["sequence"]] for r in ft.sequence_pad(df, features=("x",), steps=2).collect()}
    assert two == {"a": [2.0, 3.0], "b": [7.0, 7.0]}  # of equal times the larger comes later


def test_scalers(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0), ("b", 10.0, 5.0)], "client_id string, x double, y double")
    st = ft.feature_scaler(df, ["x", "y"])
    scaled = ft.standardise(df, st, ["x", "y"])
    assert abs(scaled.agg(F.avg("x")).first()[0]) < 1e-12 and [r["y"] for r in scaled.collect()] == [0.0] * 3
    back = ft.standardise(scaled, st, ["x", "y"], inverse=True)
    assert sorted(round(r["x"], 9) for r in back.collect()) == [1.0, 3.0, 10.0]
    per = {r["client_id"]: (r["x_mean"], r["x_std"], r["y_std"]) for r in ft.key_scaler(df, "client_id", ["x", "y"]).collect()}
    assert per == {"a": (2.0, 1.0, 1.0), "b": (10.0, 1.0, 1.0)}


def test_trajectory_tasks_do_not_grow(spark, tmp_path, monkeypatch):
    """More telemetry makes more tasks of the sort and the gathering of sessions, not larger ones."""
    from geotide.sources import bindings
    monkeypatch.setattr(bindings, "POINTS_PER_TASK", 40)
    rows = [(k, T0 + dt.timedelta(minutes=k), k % 50, ("click", "view", "signup")[k % 3], float(k), "{}") for k in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(str(tmp_path / "events.parquet"))
    tracks = bindings.MobilityTables(spark, str(tmp_path)).trajectories
    assert tracks.rdd.getNumPartitions() == 10
    # a user's session starts with the first event and lasts six hours
    assert sum(len(r["trajectory"]) for r in tracks.collect()) == sum(k - k % 50 <= 360 for k in range(400))
