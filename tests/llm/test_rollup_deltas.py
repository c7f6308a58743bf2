"""Rollups: a second tokenizer version, restricted batches, compaction, and odd rows."""

import collections

from geotide.llm.tokens import encoder_of
from geotide.llm.token_rollups import TokenRollup, corpus_rollup

CHANGE = "doc_id long, op string, text string, source string, lang string"


def totals(roll):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in roll.totals().collect()}


def test_versions_and_restricted_batches(spark):
    one, two = encoder_of("byte_bpe_50k"), encoder_of("byte_bpe_multi_50k")
    text = {1: "Größe und Länge der Straße", 2: "<|endoftext|> tail", 3: "hello world"}
    docs = spark.createDataFrame([(k, "upsert", t, "s", "de") for k, t in text.items()], CHANGE)
    roll = TokenRollup(spark)
    roll.apply("load", docs, "byte_bpe_50k")
    only = spark.createDataFrame([(1,), (2,), (2,), (77,), (None,)], "doc_id long")
    assert roll.apply("newer", docs, "byte_bpe_multi_50k", only) and not roll.apply("newer", docs, "byte_bpe_multi_50k", only)
    want = {("s", "de", "byte_bpe_50k"): (1, len(one(text[3]))), ("s", "de", "byte_bpe_multi_50k"): (2, len(two(text[1])) + len(two(text[2])))}
    assert totals(roll) == want
    assert len(one(text[1])) != len(two(text[1]))
    roll.compact()
    assert totals(roll) == want and roll.journal().count() == 3 and not roll.apply("load", docs, "byte_bpe_50k")
    roll.apply("gone", docs.selectExpr("doc_id", "'delete' op", "text", "source", "lang"), "byte_bpe_50k", only)
    assert totals(roll) == {("s", "de", "byte_bpe_50k"): (1, len(one(text[3])))}
    roll.compact()
    assert totals(roll) == {("s", "de", "byte_bpe_50k"): (1, len(one(text[3])))}


def test_a_batch_stores_its_sums(spark):
    """Totals read one small table a batch, whatever the number of documents."""
    docs = spark.range(500).selectExpr("id doc_id", "'upsert' op", "concat('word ', id) text", "concat('s', id % 3) source", "'en' lang")
    roll = TokenRollup(spark)
    roll.apply("a", docs, "v")
    roll.apply("b", docs.where("doc_id < 10"), "v")
    assert roll._read("deltas", "source string, docs long").count() == 6
    assert sum(d for d, _ in totals(roll).values()) == 500


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(900, 0, 0), (901, 0, 1), (None, 0, 1), (12, 0, None), (12, 1, 0), (10 ** 6, 0, 0)], "doc_id long, quality int, toxic int")
    encode = encoder_of("byte_bpe_50k")
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in odd.collect()]
    want = collections.Counter()
    last = {}
    for i, text, source, lang in rows:
        n = len(encode(text or ""))
        if i is None:
            want[source, lang, "docs"] += 1
            want[source, lang, "tokens"] += n
        elif i not in last or (n, source or "", lang or "") > last[i][0]:
            last[i] = ((n, source or "", lang or ""), source, lang, text)
    low = {900, 12}
    for i, (_, source, lang, text) in last.items():
        if i == 901:
            continue
        flat = (text or "").replace("\n", " ") if i in low else (text or "")
        want[source, lang, "docs"] += 1
        want[source, lang, "tokens"] += len(encode(flat))
    got = collections.Counter()
    for r in corpus_rollup(odd, labels).collect():
        got[r["source"], r["lang"], "docs"] += r["docs"]
        got[r["source"], r["lang"], "tokens"] += r["tokens"]
    assert got == want
