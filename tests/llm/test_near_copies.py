import importlib.util
import os
import random
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(HERE)))
spec = importlib.util.spec_from_file_location("llm_brute", os.path.join(HERE, "brute.py"))
brute = importlib.util.module_from_spec(spec)
spec.loader.exec_module(brute)

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


near_kept = brute.near_kept


def test_near_copies_of_five_words_go(spark):
    """Pairs between 5 words at 0.8 and op1's 3 words at 0.9, and pairs just under 0.8."""
    rng = random.Random(5)
    data = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(100)]
        for spots in ((), (50,), (20, 60), (10, 40, 80)):  # 5, 10 or 15 of 96 shingles differ from the first
            text = list(base)
            for k in spots:
                text[k] = f"e{rng.randint(0, 10 ** 9)}"
            data.append((len(data), " ".join(text), "en", "s", None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(data, schema).repartition(4)
    got = {r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()}
    want = near_kept([r[:2] for r in data])
    assert got == want and got != near_kept([r[:2] for r in data], 3, 90)


def test_stage_agrees_with_five_word_brute_force(spark):
    docs = corpus_pipeline.without_copies(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect()]
    assert set(got) == near_kept(pairs) != near_kept(pairs, 3, 90) and len(got) == len(set(got))
