"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are overlapping runs of words across line ends, so that every window in which a template can
stand lies whole in one of them.  Tokens of the templates are ordered by their frequency over all
blocks.  A block reaches containment ``t`` of a template only if it holds one of the template's
rarest tokens (prefix filter), is long enough (length filter), and can still gather enough tokens
after the first common one (positional filter).  What is left is verified by intersecting the sets,
and then window by window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotide.llm.shared import text_or_empty

#: Phrases and labels of the base scan.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: One characteristic sentence of well-known licenses, and its label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
)

#: Share of a template's tokens that a window of words has to hold.
CONTAINMENT = 0.8

#: Words that tell licenses apart: a window has to hold those of its template, and a template without any in full.
DISTINGUISHING = frozenset("2 apache by general gnu mit mozilla nc permission redistribution sharealike".split())

#: A window is so many words longer than its template; a block starts every so many words.
SLACK = 4
STRIDE = 100

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _all_words(text: Column) -> Column:
    """Lower-case words of the text, each after one space; empty without words."""
    words = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.rtrim(F.regexp_replace(F.concat(F.lit(" "), words), "^ +", " "))


def _needed(n: int, t: float) -> int:
    """Smallest number of common tokens that reaches the containment."""
    return max(1, math.ceil(n * t - 1e-9))


def token_order(blocks: DataFrame, templates, tokens: str = "tokens") -> dict[str, int]:
    """Number of blocks that hold each token of the templates (a bounded vocabulary)."""
    vocabulary = sorted({w for _, s in templates for w in s.split()})
    held = blocks.select(F.explode(F.array_intersect(tokens, F.array(*[F.lit(w) for w in vocabulary]))).alias("w"))
    counted = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def match_blocks(blocks: DataFrame, templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """Every pair of a block and a template with containment >= ``threshold``.

    ``blocks`` has an array ``tokens``; returns its columns, ``template``, ``label`` and ``containment``.  Empty
    blocks match nothing; repeated tokens count once.
    """
    order = token_order(blocks, templates)
    rank = {w: k for k, w in enumerate(sorted(order, key=lambda w: (order[w], w)))}
    index, sets = [], []
    for label, sentence in templates:
        tokens = sorted(set(sentence.split()), key=rank.get)
        need = _needed(len(tokens), threshold)
        sets.append((label, tokens, need))
        index += [(w, len(sets) - 1, at, len(tokens), need) for at, w in enumerate(tokens[:len(tokens) - need + 1])]
    prefix = F.array(*[F.lit(w) for w in sorted({x[0] for x in index})])
    spark = blocks.sparkSession
    ordered = F.array(*[F.lit(w) for w in sorted(rank, key=rank.get)])
    names = blocks.columns
    # array_intersect keeps the order of its first argument: the block's tokens come out in global order
    held = (blocks.where(F.arrays_overlap("tokens", prefix))
            .select(F.struct(*names).alias("b"), F.array_intersect(ordered, F.col("tokens")).alias("held"),
                    F.size(F.array_distinct("tokens")).alias("size")))
    probes = held.select("b", "held", "size", F.posexplode("held").alias("j", "w"))
    rows = spark.createDataFrame(index, "w string, template int, i int, n int, need int")
    full = spark.createDataFrame([(k, label, tokens) for k, (label, tokens, _) in enumerate(sets)],
                                 "template int, label string, full array<string>")
    fixed = rows.join(full, "template")  # a few rows per template
    shared = F.size(F.array_intersect("held", "full"))
    passed = (probes.join(F.broadcast(fixed), "w")
              .where("size >= need")
              .where(F.least(F.col("n") - F.col("i"), F.size("held") - F.col("j")) >= F.col("need"))
              .withColumn("shared", shared).where("shared >= need"))
    # a pair may pass by several prefix tokens: keep its first
    first = F.element_at(F.array_intersect("held", F.slice("full", F.lit(1), F.col("n") - F.col("need") + 1)), 1)
    return passed.where(F.col("w") == first).select("b.*", "template", "label", (F.col("shared") / F.col("n")).alias("containment"))


def _rules(templates, threshold: float) -> list[tuple[int, int, list[str], list[str], int]]:
    """Per template: number, words of a window, tokens, tokens that may not be missing, smallest number of tokens."""
    out = []
    for k, (_, sentence) in enumerate(templates):
        tokens = sorted(set(sentence.split()))
        own = [w for w in tokens if w in DISTINGUISHING]
        out.append((k, len(sentence.split()) + SLACK, tokens, own or tokens, _needed(len(tokens), threshold)))
    return out


def may_match(w: Column, templates, threshold: float) -> Column:
    """Does the whole text hold the tokens that some template needs in one window?  Texts that do not match nothing."""
    any_of = F.lit(False)
    for _, _, tokens, own, least in _rules(templates, threshold):
        one = F.lit(True)
        for token in sorted(own, key=len, reverse=True):
            one = one & w.contains(f" {token}")
        any_of = any_of | (one & (sum(w.contains(f" {x}").cast("int") for x in tokens) >= least))
    return any_of


def word_blocks(rows: DataFrame, templates, threshold: float) -> DataFrame:
    """(doc_id, h, tokens): runs of words that overlap by a window of the longest template, of texts that may match."""
    longest = max(len(s.split()) for _, s in templates) + SLACK
    starts = F.sequence(F.lit(0), F.greatest(F.size("t") - longest, F.lit(0)) + STRIDE - 1, F.lit(STRIDE))
    return (rows.where(may_match(F.col("w"), templates, threshold)).select("doc_id", "h", F.split(F.ltrim("w"), " ").alias("t"))
            .select("doc_id", "h", F.explode(F.transform(starts, lambda i: F.slice("t", i + 1, STRIDE + longest - 1))).alias("tokens"))
            .where(F.size("tokens") > 0))


def match_windows(blocks: DataFrame, templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """Pairs of a block and a template that one of the block's windows holds, with the best window's containment."""
    fixed = blocks.sparkSession.createDataFrame(_rules(templates, threshold), "template int, width int, whole array<string>, own array<string>, least int")

    def held(i):
        window = F.slice("tokens", i, F.col("width"))
        some = F.size(F.array_intersect(F.col("whole"), window))
        return F.when(F.size(F.array_except(F.col("own"), window)) == 0, some).otherwise(0)

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("tokens")), held))
    return (match_blocks(blocks, templates, threshold).drop("containment").join(F.broadcast(fixed), "template")  # a row per template
            .withColumn("best", best).where("best >= least")
            .select(*blocks.columns, "label", (F.col("best") / F.size("whole")).alias("containment")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
                  threshold: float = CONTAINMENT) -> DataFrame:
    """License labels of every document, from base phrases and templates anywhere.

    Null text counts as empty: no words, null first_word and last_word, empty labels, score 0.  Rows
    with equal id and text get equal results.  Score is the largest containment of a matched template,
    1 where a base phrase stands.  Other columns are ignored; an empty table gives an empty table.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), _all_words(text).alias("w"))
    matched = (match_windows(word_blocks(rows, templates, threshold), templates, threshold)
               .groupBy(F.col("doc_id").alias("m_id"), F.col("h").alias("m_h"))
               .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best")))
    n_words = _spaces(F.col("w"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE_PHRASES:
        pieces = F.split("w", f" {phrase}(?= |$)", -1)
        there = F.col("w").contains(f" {phrase}")
        n = F.when(there, F.size(pieces) - 1).otherwise(0)
        counts.append(n)
        firsts.append(F.when(n > 0, _spaces(pieces[0])))
        lasts.append(F.when(n > 0, n_words - _spaces(F.element_at(pieces, -1)) - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    own = F.array_sort(F.array_compact(F.array(*labels)))
    facts = rows.select("doc_id", "h", n_words.cast("long").alias("n_words"), sum(counts).cast("long").alias("n_base"),
                        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
                        own.alias("own"))
    out = facts.join(matched, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("h") == F.col("m_h")), "left")
    every = F.array_sort(F.array_union("own", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
                      F.array_join(every, ",").alias("labels"), score.alias("score"))
