import os

from pyspark import SparkContext

from geotide.llm import ngram_join, shared
from geotide.session import materialize


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(shared, "materialize", lambda df, tag: written.append(tag) or materialize(df, tag))
    stars = [(2, 1), (3, 1), (1, 4), (9, 7), (7, 8), (8, 7), (5, 5), (None, 6)]
    got = sorted(map(tuple, shared.components(spark.createDataFrame(stars, "u long, v long")).collect()))
    assert got == [(2, 1), (3, 1), (4, 1), (8, 7), (9, 7)] and len(written) == 1
    chain = [(k + 1, k) for k in range(9)]
    got = sorted(map(tuple, shared.components(spark.createDataFrame(chain, "u long, v long")).collect()))
    assert got == [(k, 0) for k in range(1, 10)]
    assert shared.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_a_written_table_is_read_without_a_job(spark):
    sc = spark.sparkContext
    df = spark.createDataFrame([(1, "a", [1, None]), (None, None, None)], "k long, s string, l array<long>")
    sc.setJobGroup("one-write", "materialize")
    try:
        back = materialize(df, "test")
        jobs = sc.statusTracker().getJobIdsForGroup("one-write")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert len(jobs) == 1 and back.dtypes == df.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_the_join_leaves_no_broadcast_behind(spark, monkeypatch):
    made, send = [], SparkContext.broadcast

    def spy(self, value):
        made.append(send(self, value))
        return made[-1]

    monkeypatch.setattr(SparkContext, "broadcast", spy)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:39])), (3, "a b c d")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))
    assert got == [(1, 38, 1), (2, 37, 1), (3, 2, 3)]
    assert len(made) == 2 and not any(os.path.exists(b._path) for b in made)
