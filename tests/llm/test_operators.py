import collections
import importlib.util
import math
import os
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(HERE)))
spec = importlib.util.spec_from_file_location("llm_brute", os.path.join(HERE, "brute.py"))
brute = importlib.util.module_from_spec(spec)
spec.loader.exec_module(brute)

from geotide.llm import exact_dedup, language, licenses, mixing, ngram_join, packing, quality, secrets, substring_dedup  # noqa: E402
from geotide.llm.token_rollups import TokenRollup, corpus_rollup  # noqa: E402
from geotide.llm.tokens import encoder  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.select(*cols).collect()}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["edge", "sf"])
def docs(request, spark, edge):
    return edge if request.param == "edge" else spark.read.parquet(f"{SF}/documents.parquet")


def test_ngram_join_agrees(docs):
    got = ngram_join.jaccard_components(docs)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute.ngram_join(pairs(docs))


def test_substring_agrees(docs):
    got = substring_dedup.substring_dedup(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(pairs(docs))


def test_substring_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_CHARS", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    got = substring_dedup.substring_dedup(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(pairs(docs))


def test_secrets_agree(docs):
    got = secrets.scan_secrets(docs)
    assert rows(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == brute.secrets(pairs(docs))


def test_secret_spans_point_at_the_secret(edge):
    texts = dict(pairs(edge))
    for r in secrets.scan_secrets(edge).where("spans <> ''").collect():
        for span in r["spans"].split(","):
            kind, a, b = span.split(":")
            hit = texts[r["doc_id"]][int(a):int(b)]
            assert hit.startswith({"access": "AKIA", "pem": "-----BEGIN", "jwt": "eyJ", "forge": "ghp_"}.get(kind, hit[:1])), span


def test_ledger_scans_only_the_unseen(spark, edge):
    ledger = secrets.BlobLedger(spark)
    ledger.scan(edge, rules=secrets.BASE_RULES)
    blobs = len({t or "" for _, t in pairs(edge)})
    assert ledger.table().count() == blobs
    assert ledger.unseen(edge, "text", secrets.BASE_RULES).count() == 0
    todo = ledger.unseen(edge, "text", secrets.ALL_RULES).select("todo").distinct().collect()
    assert [set(r["todo"]) for r in todo] == [{r.key for r in secrets.ADDED_RULES}]
    ledger.scan(edge)
    ledger.scan(edge)
    assert ledger.table().count() == 2 * blobs
    new = edge.limit(1).withColumn("text", F.lit("password=abcdefgh12"))
    assert ledger.unseen(edge.union(new), "text", secrets.ALL_RULES).count() == 1
    whole = secrets.scan_secrets(edge)
    stepwise = secrets.secret_digest(ledger.findings(edge))
    assert rows(stepwise, "doc_id", "spans", "base_sha256") == rows(whole, "doc_id", "spans", "base_sha256")


@pytest.mark.parametrize("bits", [8, 24])  # a full filter changes nothing but cost
def test_exact_dedup_agrees(docs, bits):
    got = exact_dedup.exact_dedup(docs, bits=bits)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(pairs(docs))
    assert got.count() == docs.count()


def test_licenses_agree(docs):
    got = licenses.scan_licenses(docs)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == brute.licenses(pairs(docs))


def test_template_matches_are_all_found(spark):
    """Prefix, length and positional filters lose no block: compare with all pairs."""
    import random
    rng = random.Random(3)
    vocabulary = sorted({w for _, s in licenses.TEMPLATES for w in s.split()}) + ["zebra", "lion"]
    blocks = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 14))] for _ in range(300)]
    for _, s in licenses.TEMPLATES:
        w = s.split()
        blocks += [w, w[1:], w[:-1], w[2:] + ["zebra"], w[::-1], w + w]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(blocks)], "k int, tokens array<string>")
    got = {(r["k"], r["label"], round(r["containment"], 9)) for r in licenses.match_blocks(df, threshold=0.7).collect()}
    want = set()
    for k, b in enumerate(blocks):
        for label, s in licenses.TEMPLATES:
            t = set(s.split())
            if len(t & set(b)) >= math.ceil(0.7 * len(t) - 1e-9):
                want.add((k, label, round(len(t & set(b)) / len(t), 9)))
    assert got == want


def test_quality_agrees(docs):
    got = quality.quality(docs)
    assert rows(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == brute.quality(pairs(docs))
    assert got.where("base_failed and kept").count() == 0


def test_quality_removes_lines_by_host(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    data = [(k, f"Share  this page now\n{text} {k}", "a") for k in range(30)]  # frequent on a
    data += [(100 + k, "share this PAGE now\n" * 3 + f"tiny {k}", "a") for k in range(3)]  # little else
    data += [(200 + k, "share this page now\n" * 3 + f"tiny {k}", "b") for k in range(3)]  # rare on b
    data += [(300 + k, text, "a") for k in range(40)]  # copies make no line frequent
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["kept"] and got[k]["n_removed_words"] == 4 for k in range(30))
    assert all(not got[100 + k]["kept"] and got[100 + k]["n_removed_words"] == 12 for k in range(3))
    assert all(got[200 + k]["n_removed_words"] == 0 for k in range(3))
    assert all(got[300 + k]["kept"] and got[300 + k]["n_removed_words"] == 0 for k in range(40))


def reference_ids():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_packing_agrees(docs):
    got = packing.pack(docs).toPandas()
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert collections.Counter(map(tuple, got[cols].values.tolist())) == brute.pieces(pairs(docs), reference_ids())
    assert_places(got)


def assert_places(got):
    g = got.sort_values(["sequence_id", "offset"])
    assert (g["offset"] == g.groupby("sequence_id")["length"].cumsum() - g["length"]).all()
    filled = g.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 1024 and (filled.index == range(len(filled))).all()
    return filled.mean() / 1024


def test_packing_plan_holds_the_histogram():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000, 200_000):
        hist = np.bincount(np.minimum(1024, rng.gamma(2, 150, n).astype(int) + 1), minlength=1025) if n else np.zeros(1025, int)
        held = np.zeros(1025, int)
        for lengths, times in packing.plan(hist):
            assert sum(lengths) <= 1024 and times > 0
            for length in lengths:
                held[length] += times
        assert (held == hist).all()
        if n >= 5000:
            used = sum(t for _, t in packing.plan(hist))
            assert (hist * np.arange(1025)).sum() / (used * 1024) > 0.98


def test_fast_ids_equal_the_vocabulary(spark):
    encode, slow = encoder(), reference_ids()
    texts = ["", " ", "a　b c\x85d", "don't  we'll\n\n\tx ", "ÀÉ 中文字 ١٢٣ ²½ \U0001f469‍\U0001f680 é", "\x00\x1f\x7f", "<|endoftext|><|endoftext|> a"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        assert encode(t).tolist() == slow(t)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_languages(docs, columns=["doc_id", "lang"]).toPandas()
    import zlib
    held = got[got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.99
    assert got["score"].between(0, 1).all()


def test_language_equals_naive_bayes(spark):
    """The batch scorer against a document-by-document one with the same counts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model, columns=["doc_id"]).collect()}
    for i, text in pairs(docs)[:40]:
        data = np.frombuffer(text.encode(), np.uint8)
        codes, at = language.letters(data, np.array([0, len(data)]))
        keep = language._weights(codes, at)
        score = model.prior.copy()
        for size in language.LENGTHS:
            for bucket, use in zip(language.ngram_buckets(codes, size), keep):
                if use:
                    score += model.logs[bucket]
        assert got[i]["lang_pred"] == model.names[int(score.argmax())]
        assert got[i]["score"] == pytest.approx(1 / np.exp(score - score.max()).sum(), abs=1e-3)


def test_language_never_reads_its_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs.where(language.in_training(F.col("doc_id"))))
    plain = language.predict(docs, model, columns=["doc_id"])
    other = language.predict(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")}), model, columns=["doc_id"])
    assert rows(plain, "doc_id", "lang_pred", "score") == rows(other, "doc_id", "lang_pred", "score")


def test_language_unknown(edge):
    got = {r["doc_id"]: r for r in language.identify_languages(edge).collect()}
    for i, t in pairs(edge):
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), (i, t)


def test_mixing_follows_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mix_sources(docs, columns=["doc_id", "source"], weights={"src0": 3.0, "src1": 1.0})
    n = docs.where("source in ('src0', 'src1')").groupBy("source").agg(F.sum(F.length("text")).alias("all")).toPandas().set_index("source")["all"]
    size = got.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").groupBy("source").agg(F.sum("n").alias("s")).toPandas().set_index("source")["s"]
    assert set(size.index) == {"src0", "src1"} and len(n) == 2
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    assert size["src0"] / total == pytest.approx(0.75, rel=0.15) and size["src1"] / total == pytest.approx(0.25, rel=0.35)


def test_poisson_inversion(spark):
    """Copies per document follow the distribution, for small and large means."""
    for mean in (0.05, 1.0, 7.5, 900.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(mean)).alias("c")).first()["c"]
        log = [-mean + k * math.log(mean) - math.lgamma(k + 1) for k in range(len(cdf))]
        assert np.allclose(cdf, np.cumsum(np.exp(log)), atol=1e-9) and cdf[-1] == pytest.approx(1, abs=1e-9)


def test_mixing_is_repeatable_and_whole(odd):
    a = mixing.mix_sources(odd).toPandas()
    b = mixing.mix_sources(odd.repartition(5)).toPandas()
    assert collections.Counter(map(str, a[["doc_id", "copy", "n_copies"]].values.tolist())) == collections.Counter(
        map(str, b[["doc_id", "copy", "n_copies"]].values.tolist()))
    per = a[a["doc_id"] < 900].groupby("doc_id").agg(n=("n_copies", "first"), rows=("copy", "nunique"))
    assert (per["n"] == per["rows"]).all()


def test_rollup_is_additive_and_idempotent(spark):
    roll = TokenRollup(spark)
    encode = reference_ids()
    schema = "doc_id long, op string, text string, source string, lang string"

    def batch(*changes):
        return spark.createDataFrame(list(changes), schema)

    def totals():
        return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in roll.totals().collect()}

    n = {t: len(encode(t)) for t in ("hello world", "a longer text here", "bye", "again")}
    first = batch((1, "upsert", "hello world", "a", "en"), (2, "upsert", "bye", "b", None), (None, "upsert", "bye", None, "en"), (3, "upsert", None, "a", "en"))
    assert roll.apply("one", first, "v1") and not roll.apply("one", first, "v1")
    assert totals() == {("a", "en", "v1"): (2, n["hello world"]), ("b", None, "v1"): (1, n["bye"]), (None, "en", "v1"): (1, n["bye"])}
    assert roll.apply("two", batch((1, "upsert", "a longer text here", "c", "en"), (2, "delete", None, None, None), (9, "delete", None, None, None)), "v2")
    assert totals() == {("a", "en", "v1"): (1, 0), ("c", "en", "v2"): (1, n["a longer text here"]), (None, "en", "v1"): (1, n["bye"])}
    assert roll.apply("three", batch((2, "upsert", "again", "b", None), (2, "upsert", "again", "b", None), (1, "delete", None, None, None)), "v2")
    assert not roll.apply("two", first, "v1")
    assert totals() == {("a", "en", "v1"): (1, 0), ("b", None, "v2"): (1, n["again"]), (None, "en", "v1"): (1, n["bye"])}
    assert roll.apply("four", batch((2, "delete", None, None, None), (1, "delete", None, None, None)), "v3")
    assert ("b", None, "v2") not in totals()


def test_corpus_rollup_agrees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    encode = reference_ids()
    lab = labels.toPandas().groupby("doc_id").agg(toxic=("toxic", "max"), quality=("quality", "min"))
    want = collections.Counter()
    for r in docs.collect():
        i = r["doc_id"]
        if i in lab.index and lab.loc[i, "toxic"] == 1:
            continue
        text = r["text"].replace("\n", " ") if i in lab.index and lab.loc[i, "quality"] == 0 else r["text"]
        want[r["source"], r["lang"], "docs"] += 1
        want[r["source"], r["lang"], "tokens"] += len(encode(text))
    got = collections.Counter()
    for r in corpus_rollup(docs, labels).collect():
        got[r["source"], r["lang"], "docs"] += r["docs"]
        got[r["source"], r["lang"], "tokens"] += r["tokens"]
    assert got == want


def test_odd_rows_have_defined_results(odd):
    n = odd.count()
    got = exact_dedup.exact_dedup(odd)
    assert got.count() == n and got.columns.count("kept") == 1
    group = [r for r in got.collect() if r["text"] and r["text"].startswith("v0 v1 ") and not r["text"].endswith("more")]
    assert len(group) == 5 and {r["keep_id"] for r in group} == {900} and sum(r["kept"] for r in group) == 1
    comp = ngram_join.jaccard_components(odd).collect()
    assert len(comp) == n and all((r["component_id"] is None) == (r["doc_id"] is None) for r in comp)
    assert {r["component_id"] for r in comp if r["doc_id"] in (900, 901)} == {900}
    sub = substring_dedup.substring_dedup(odd).collect()
    assert len(sub) == n
    assert all(r["n_removed"] == 0 for r in sub if r["doc_id"] == 900) and all(r["n_removed"] == 50 for r in sub if r["doc_id"] == 901)
    assert sorted(r["n_removed"] for r in sub if r["doc_id"] is None) == [0, 50, 50]
    assert secrets.scan_secrets(odd).count() == n
    assert licenses.scan_licenses(odd).count() == n
    assert quality.quality(odd).count() == n
    assert language.identify_languages(odd).count() == n
    packed = packing.pack(odd).toPandas()
    assert (packed["start"] == 0).sum() == n
    assert_places(packed)


def test_empty_tables(spark, none):
    for out in (exact_dedup.exact_dedup(none), ngram_join.jaccard_components(none), substring_dedup.substring_dedup(none),
                secrets.scan_secrets(none), licenses.scan_licenses(none), quality.quality(none), language.identify_languages(none),
                packing.pack(none), mixing.mix_sources(none),
                corpus_rollup(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))):
        assert out.count() == 0


def test_large_groups_of_copies(spark):
    """A third of all rows in one group of copies and one of near copies."""
    base = " ".join(f"b{k}" for k in range(200))
    data = [(k, base) for k in range(300)]
    data += [(1000 + k, " ".join([*(f"c{j}" for j in range(150)), f"u{k}"])) for k in range(300)]
    data += [(2000 + k, " ".join(f"d{k}x{j}" for j in range(40))) for k in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    assert rows(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == brute.ngram_join(data)
    assert rows(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(data)
    assert rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact(data)


def test_links_at_the_threshold(spark):
    """Pairs around the threshold, chains, and groups whose smallest member is not in every link."""
    import random
    rng = random.Random(11)
    data = []
    for g in range(25):
        size = rng.choice([12, 30, 40, 100, 190])
        base = [f"g{g}w{rng.randint(0, 10 ** 6)}" for _ in range(size)]
        for _ in range(12):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                text[rng.randrange(size)] = f"e{rng.randint(0, 10 ** 6)}"
            if rng.random() < 0.3:
                base = text  # a chain drifts away
            data.append((rng.randrange(10 ** 9), " ".join(text)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(ngram_join.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == brute.ngram_join(data)


def test_components(spark):
    from geotide.llm.shared import components
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)] + [(500 - k, 500 - k - 1) for k in range(30)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute.components({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == c for n, c in want.items())


def test_oracle_agreement(spark):
    """The SQL of every query that has one, on the smallest tables."""
    import duckdb
    from geotide.llm.queries import ORACLE, QUERIES
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SF).toPandas()
        want = con.execute(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)

        def plain(df):
            return collections.Counter(tuple(None if pd.isna(x) else round(float(x), 9) if isinstance(x, (int, float, np.number)) else x
                                             for x in r) for r in df[cols].itertuples(index=False))
        assert plain(got) == plain(want), name
