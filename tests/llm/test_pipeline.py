import collections
import importlib.util
import os
import sys
import zlib

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(HERE)))
spec = importlib.util.spec_from_file_location("llm_brute", os.path.join(HERE, "brute.py"))
brute = importlib.util.module_from_spec(spec)
spec.loader.exec_module(brute)

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    """Each stage on its predecessor's rows; run() gives the last stage's."""
    import public_tokenizers
    from tokenizers import Tokenizer
    from geotide.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    frames, now = [], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, SF)
        frames.append(now.toPandas())
        if k < 4:
            assert now.columns == COLUMNS
            now = spark.createDataFrame(frames[-1], docs.schema)

    def pairs(df):
        return list(zip(df["doc_id"].tolist(), df["text"].tolist()))

    one, two, three, four, five = frames
    whole = docs.toPandas()
    assert set(one["doc_id"]) == set(whole[whole["text"].map(lambda t: any(c.isalpha() for c in t))]["doc_id"])
    assert set(two["doc_id"]) == {r[0] for r in brute.exact(pairs(one)) if r[3]} and len(two) == two["doc_id"].nunique()
    assert set(three["doc_id"]) == brute.near_kept(pairs(two)) and len(three) == three["doc_id"].nunique()

    size = three["text"].str.len().clip(lower=1)
    per = size.groupby(three["source"]).sum().astype(float)
    target = per ** mixing.TEMPERATURE
    rate = target / target.sum() * per.sum() / per
    import hashlib
    import math
    want = {}
    for i, s in zip(three["doc_id"], three["source"]):
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2 ** 52
        p, n = math.exp(-rate[s]), 0
        total = p
        while total <= u:
            n += 1
            p *= rate[s] / n
            total += p
        if n:
            want[i] = n
    assert collections.Counter(four["doc_id"]) == collections.Counter(want)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.Counter()
    for i, text in pairs(four):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 1024):
            p = ids[a:a + 1024]
            pieces[i, a, len(p), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p)), len(ids)] += 1
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert collections.Counter(map(tuple, five[cols].values.tolist())) == pieces
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert collections.Counter(map(tuple, got[cols].values.tolist())) == pieces


def test_entry_lists_the_queries():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= names


def test_nothing_else_imports_the_package():
    root = os.path.dirname(os.path.dirname(HERE))
    for folder, _, files in os.walk(os.path.join(root, "geotide")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "geotide.llm" not in open(os.path.join(folder, f)).read(), f
