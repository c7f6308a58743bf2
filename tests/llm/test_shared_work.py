import importlib.util
import os
import random
import sys
from collections import Counter

from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(HERE)))
spec = importlib.util.spec_from_file_location("llm_brute", os.path.join(HERE, "brute.py"))
brute = importlib.util.module_from_spec(spec)
spec.loader.exec_module(brute)

import corpus_pipeline  # noqa: E402
from geotide.llm import ngram_join  # noqa: E402


def families():
    """Near copies on both sides of the threshold, some rows twice, some ids with two texts."""
    rng = random.Random(11)
    data = []
    for g in range(8):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))]
        for _ in range(10):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                text[rng.randrange(len(text))] = f"e{rng.randint(0, 60)}"
            data.append((len(data), " ".join(text[:rng.randint(len(text) * 9 // 10, len(text))])))
    return data


def test_a_list_of_sets_opens_its_pairs_once(spark, monkeypatch):
    data = families()
    docs = spark.createDataFrame(data + data[5:15], "doc_id long, text string").repartition(4)
    kept, write = {}, ngram_join.materialize

    def spy(df, tag):
        kept[tag] = write(df, tag)
        return kept[tag]

    monkeypatch.setattr(ngram_join, "materialize", spy)
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs, size=5, threshold=(80, 100)).collect()}
    assert {i for i, c in got if i == c} == brute.near_kept(data) and len(got) == len(data)
    lists = kept["shared"].groupBy("t").agg(F.sort_array(F.collect_list(F.struct("id", "s1"))).alias("m")).select("m").collect()
    assert len(lists) > 50 and max(Counter(str(r["m"]) for r in lists).values()) == 1


def test_families_agree_with_brute_force(spark):
    data = families()
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {tuple(r) for r in brute.ngram_join(data)} and len({c for *_, c in got}) < len(data)
    kept = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == brute.near_kept(data)
