"""Stored tables: first writer, least row, delete, retention, batches that are visible whole or not at all."""

import datetime as dt
import tempfile

import pytest

from geotide.operators import stored
from geotide.operators.stored import BUCKET, DAY, BatchLog, DayTable

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "client_id string, at timestamp_ntz, v int, w string"


def at(day, hour=0):
    return T0 + dt.timedelta(days=day, hours=hour)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, prefer=None):
    path = tempfile.mkdtemp(prefix="day-", dir="/tmp") + "/t"
    return DayTable(spark, path, frame(spark, []).schema, ["client_id", "at"], "at", prefer, buckets=4)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_first_writer_wins_and_a_repeat_adds_nothing(spark):
    t = table(spark)
    assert rows(t.rows()) == []
    one = [("a", at(0), 5, "x"), ("b", at(0), 1, None), (None, at(1), 2, "n"), ("c", None, 3, "no day")]
    t.insert(frame(spark, one))
    t.insert(frame(spark, [("a", at(0), 1, "later"), ("a", at(1), 7, "new"), (None, at(1), 9, "later"), ("c", None, 9, "later"),
                           ("d", at(2), 4, "b"), ("d", at(2), 4, "a")]))
    want = sorted([*one, ("a", at(1), 7, "new"), ("d", at(2), 4, "a")], key=repr)
    assert rows(t.rows()) == want
    t.insert(t.rows())
    assert rows(t.rows()) == want and t.raw().count() == len(want)


def test_least_row_wins_in_any_order(spark):
    new = [("a", at(0), 5, "x"), ("a", at(0), 3, "z"), ("a", at(0), 3, "y"), ("b", at(0), None, "x"), ("b", at(0), 9, None), ("c", at(3), 1, "x")]
    for batches in ([new], [[r] for r in new], [[r] for r in reversed(new)], [new[:2], new[2:], new]):
        t = table(spark, ["v"])
        for b in batches:
            t.insert(frame(spark, b))
        assert rows(t.rows()) == sorted([("a", at(0), 3, "y"), ("b", at(0), 9, None), ("c", at(3), 1, "x")], key=repr)


def test_an_insert_reads_the_touched_days_only(spark):
    t = table(spark)
    for d in range(5):
        t.insert(frame(spark, [(f"c{k}", at(d), k, "x") for k in range(20)]))
    new = frame(spark, [("c1", at(2), 1, "x"), ("q", at(2), 1, "x")])
    plan = t.fresh(new)._jdf.queryExecution().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "2024-01-03" in pruned and f"{DAY}#" in pruned and BUCKET in pruned
    scanned = t.raw().where(t.parts(t._placed(new))).select("_metadata.file_path").distinct().collect()
    assert scanned and all(f"{DAY}=2024-01-03" in r[0] for r in scanned)


def test_delete_rewrites_only_what_it_must_and_empties_parts(spark):
    t = table(spark)
    all_rows = [(f"c{k}", at(d), k, "x") for d in range(3) for k in range(10)]
    t.insert(frame(spark, all_rows))
    before = {f for f in t.raw().inputFiles() if f"{DAY}=2024-01-03" in f}
    gone = [r for r in all_rows if r[1] == at(0)] + [("c3", at(1), 0, ""), ("absent", at(2), 0, "")]
    t.delete(frame(spark, gone).select("client_id", "at"))
    left = [r for r in all_rows if r[1] != at(0) and r[:2] != ("c3", at(1))]
    assert rows(t.rows()) == sorted(left, key=repr)
    assert before == {f for f in t.raw().inputFiles() if f"{DAY}=2024-01-03" in f}
    t.delete(t.rows().select("client_id", "at"))
    assert rows(t.rows()) == []
    t.insert(frame(spark, all_rows[:3]))
    assert len(rows(t.rows())) == 3


def test_retention_counts_drops_days_and_cuts_the_last_one(spark):
    t = table(spark)
    t.insert(frame(spark, [("a", at(d, h), d, "x") for d in range(5) for h in (1, 13)] + [("n", None, 0, "x")]))
    assert t.expire(at(32, 12), 28 + 2) == 5
    assert rows(t.rows()) == sorted([("a", at(2, 13), 2, "x"), ("n", None, 0, "x")] + [("a", at(d, h), d, "x") for d in (3, 4) for h in (1, 13)], key=repr)
    assert t.expire(at(32, 12), 30) == 0


def test_a_batch_counts_once_and_whole(spark):
    log = BatchLog(spark, tempfile.mkdtemp(prefix="log-", dir="/tmp") + "/l")
    a, b = frame(spark, [("a", at(0), 1, "x")]), frame(spark, [("b", at(0), 1, "x")])
    assert rows(log.read("one", a.schema)) == []
    assert log.append("first", {"one": a, "two": b}) and not log.append("first", {"one": b, "two": b})
    assert rows(log.read("one", a.schema)) == rows(a) and rows(log.read("two", a.schema)) == rows(b)

    class Broken(Exception):
        pass

    def fails(batch):
        raise Broken

    broken = type("F", (), {"write": property(fails)})()
    with pytest.raises(Broken):
        log.append("half", {"one": b, "two": broken})
    assert rows(log.read("one", a.schema)) == rows(a)  # the half batch is invisible
    assert log.append("half", {"one": b, "two": a})
    assert rows(log.read("one", a.schema)) == rows(a.union(b)) and log.has("half")


def test_append_validated_splits_by_rules(spark):
    log = BatchLog(spark, tempfile.mkdtemp(prefix="log-", dir="/tmp") + "/l")
    new = spark.createDataFrame([("a", "Monday", at(0), "weekly"), (None, "Monday", at(0), "weekly"), ("b", None, at(0), "daily"),
                                 ("c", "Friday", at(0), "yearly"), ("d", "Friday", at(0), None)],
                                "client_id string, visit_day string, predicted_time timestamp_ntz, prediction_type string")
    stored.append_validated(log, 1, {"weekly_schedule": new})
    assert sorted(r["client_id"] for r in log.read("weekly_schedule", new.schema).collect()) == ["a", "d"]
    schema = new.selectExpr("*", "'' as reject_reason").schema
    assert sorted(r["reject_reason"] for r in log.read("weekly_schedule_rejects", schema).collect()) \
        == ["bad_prediction_type", "null_client_id", "null_visit_day"]
