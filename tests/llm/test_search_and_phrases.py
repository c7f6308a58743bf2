"""MaxScore search, lexical ranking and collocations against brute force, and their odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotide.llm import collocations, lexical, maxscore

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType()), T.StructField("uid", T.StringType()),
                        T.StructField("score", T.StringType()), T.StructField("id", T.LongType())])


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 1, "u", "s", 3) for i, v in data], VECTORS).repartition(3)


def brute_topk(data, k, every):
    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(data)
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for n, i, v in ok:
        if i is None or i % every:
            continue
        best = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, j, w in ok if m != n)[:k]
        for r, (s, absent, j) in enumerate(best, 1):
            out[i, r, None if absent else j, -s] += 1
    return out


def f32(x):
    return float(np.float32(x))


@pytest.mark.parametrize("shard_rows, block_queries", [(1 << 14, 1 << 13), (40, 7)])
def test_topk_equals_brute_force(spark, shard_rows, block_queries):
    """Ties, copies, sparse, short, empty, huge and invalid vectors, null and repeated ids; one shard or many."""
    rng = random.Random(3)
    data = [(k, [f32(rng.gauss(0, 0.2)) for _ in range(12)]) for k in range(180)]
    data += [(200 + k, [f32(x) for x in data[k % 5][1]]) for k in range(30)]                    # ties
    data += [(300 + k, [0.0] * 11 + [f32(rng.random())]) for k in range(20)]                    # one term
    data += [(400, None), (401, [1.0, None]), (402, [1.0, float("nan")]), (403, [float("inf")] * 12), (450, [float("-inf")]),
             (500, []), (501, [0.5]), (510, [f32(x) for x in data[0][1]]), (510, [f32(x) for x in data[0][1]]), (None, data[0][1]), (None, None)]
    got = maxscore.top_k(vectors(spark, data), F.col("vec_id") % 10 == 0, k=5, shard_rows=shard_rows, block_queries=block_queries)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert collections.Counter(map(tuple, got.collect())) == brute_topk(data, 5, 10)


def test_topk_is_exact_beyond_small_numbers(spark):
    for scale in (3e3, 3e5, 2e6):
        rng = random.Random(5)
        data = [(k, [f32(rng.uniform(-scale, scale)) for _ in range(6)]) for k in range(60)]
        got = maxscore.top_k(vectors(spark, data), F.col("vec_id") % 5 == 0, k=3)
        assert collections.Counter(map(tuple, got.collect())) == brute_topk(data, 3, 5)


def test_topk_of_few_or_no_rows(spark):
    for data in ([], [(1, [1.0])], [(0, [1.0])], [(0, [1.0]), (50, [2.0])], [(0, None)]):
        got = maxscore.top_k(vectors(spark, data), F.col("vec_id") % 50 == 0)
        assert collections.Counter(map(tuple, got.collect())) == brute_topk(data, 5, 50)


def test_essential_terms_prune():
    """The traversal finds all competitive rows, and skips a block whose bounds fall short."""
    rng = np.random.default_rng(1)
    weights = rng.integers(-9, 10, (300, 16)).astype(np.float32)
    block = maxscore.Postings(weights, 0)
    for _ in range(30):
        query = rng.integers(-9, 10, 16).astype(np.float32)
        score = weights @ query
        for least in (score.max(), np.sort(score)[-5], np.sort(score)[100], score.min()):
            rows, found = block.competitive(query, least)
            assert set(rows) == set(np.flatnonzero(score >= least)) and (score[rows] == found).all()
        assert not len(block.competitive(query, np.maximum(query * block.high, query * block.low).sum() + 1)[0])


# ------------------------------------------------------------------ lexical ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_rank(docs, items, k):
    tf = [(i, collections.Counter(TERM.findall(low(t)))) for i, t in docs]
    holders = collections.Counter(x for _, c in tf for x in c)
    n_docs = sum(1 for _, c in tf if c)
    total = sum(sum(c.values()) for _, c in tf)
    terms = collections.defaultdict(set)
    for item, text in items:
        terms[item] |= set(TERM.findall(low(text)))
    out = collections.Counter()
    for item, own in terms.items():
        found = []
        for i, c in tf:
            n = sum(c.values())
            if not n:
                continue
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 20 * m))
                    for x in own if c[x])
            if s > 0:
                found.append((-s, i is None, i or 0))
        for r, (s, absent, i) in enumerate(sorted(found)[:k], 1):
            out[item, r, None if absent else i, -s] += 1
    return out


ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()),
                      T.StructField("doc_id", T.StringType()), T.StructField("score", T.IntegerType())])


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ITEMS)


ITEM_ROWS = [(1, "One two, w12 w77 w3999 TOKEN"), (2, "the and of; passage w5"), (2, "w6 again"), (None, "ß 中文 É é"), (3, None), (4, ""),
             (5, "!!! ---"), (6, "nothing_of_this zzzq"), (7, " ".join(f"w{k}" for k in range(0, 4000, 3))), (8, "again SAY the same, same"), (8, "again")]


@pytest.mark.parametrize("automaton_bytes", [lexical.AUTOMATON_BYTES, 2000])
def test_ranks_equal_brute_force(spark, odd, monkeypatch, automaton_bytes):
    monkeypatch.setattr(lexical, "SCAN_BYTES", 300)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = lexical.rank_documents(odd, items_of(spark, ITEM_ROWS), 7, automaton_bytes=automaton_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_rank(docs, ITEM_ROWS, 7)
    assert len(want) > 20 and collections.Counter(map(tuple, got.collect())) == want


def test_ranks_of_empty_tables(spark, odd, none):
    for docs, rows in ((none, ITEM_ROWS), (odd, []), (none, []), (odd, [(1, None), (2, "?")])):
        assert lexical.rank_documents(docs, items_of(spark, rows)).count() == 0


def test_scan_cuts_long_texts_between_terms(monkeypatch):
    import pyarrow as pa
    pairs = pa.table({"item": pa.array([1, 1, 2]), "term": pa.array(["aa", "b", "aa"])})
    plan = lexical.make_plan(pairs)
    rng = random.Random(2)
    text = " ".join(rng.choice(["aa", "b", "aab", "c" * 40, "aa-b"]) for _ in range(500))
    whole = lexical.scan(plan, text.encode())
    want = collections.Counter(TERM.findall(text))
    assert whole[0] == sum(want.values()) and sorted(whole[1].values()) == sorted([want["aa"], want["b"]])
    for size in (1, 7, 64):
        monkeypatch.setattr(lexical, "SCAN_BYTES", size)
        assert lexical.scan(plan, text.encode()) == whole


# -------------------------------------------------------------- collocations ---

def brute_phrases(docs, least, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    big = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        rows = []
        for (g, p), a in big.items():
            if g != lang or len(p) < 2:
                continue
            if any(h == g and len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for (h, q), b in big.items()):
                continue
            cuts = []
            for k in range(1, len(p)):
                left, right = f[g, p[:k]], f[g, p[k:]]
                cuts.append(((1000 * a * n[g]) // (left * right), k, left, right))
            s, _, left, right = min(cuts)
            rows.append((-s, -a, " ".join(p).encode(), left, right))
        for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def phrase_docs(spark, seed=4, n=120):
    rng = random.Random(seed)
    common = ["new york city", "as well as", "in the end of the day", "ß é", "A b c d e f g", "x\ty"]
    words = [f"w{k}" for k in range(12)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append(rng.choice(common) if rng.random() < 0.3 else rng.choice(words))
            if rng.random() < 0.15:
                parts.append(rng.choice([".", ",", "\n", "!", "  "]))
        rows.append((k if k % 11 else None, " ".join(parts) if k % 17 else None, [None, "en", "de"][k % 3], "r"))
    rows += [(999, "same old words here again " * 3, "en", "r")] * 30 + [(1000, "", "en", "r"), (1001, "... ,", "fr", "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string").repartition(4), [(r[2], r[1]) for r in rows]


@pytest.mark.parametrize("share, most_bits, top", [(1 / 8, 27, 2000), (0.0, 27, 15), (1.0, 8, 2000)])
def test_collocations_equal_brute_force(spark, share, most_bits, top):
    """With a sample, with none (every level is a border failure) and with bitmaps cut into many parts."""
    docs, data = phrase_docs(spark)
    got = collocations.collocations(docs, least=12, top=top, share=share, most_bits=most_bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute_phrases(data, 12, top)
    assert len(want) > 30 and sorted(map(tuple, got.collect())) == want


def test_collocations_of_empty_tables(spark, none, odd):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd, least=10 ** 6).count() == 0
    docs = [(r["lang"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, collocations.collocations(odd, least=30).collect())) == brute_phrases(docs, 30, 2000)


def test_scores_stay_exact_beyond_64_bits(spark):
    big = 3 * 10 ** 12
    frequent = spark.createDataFrame([("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 7)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", 9 * 10 ** 14)], "lang string, n long")
    r = collocations.scored(frequent, words, 10).collect()
    assert len(r) == 1 and r[0]["score"] == (1000 * big * 9 * 10 ** 14) // ((big + 1) * (big + 7))
