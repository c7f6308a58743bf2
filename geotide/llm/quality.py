"""Quality rules by cross-document line frequency.

Normalised lines are hashed, and per host (source) the distinct documents that hold a line are
counted.  Lines above a share of the host are removed; a document is rejected when too little of it is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotide.llm.words import chunks, mix, per_document, running, sequences, words
from geotide.session import materialize

_U = np.uint64

#: A line is removed when more than this share of its host's distinct documents hold it, whatever the size of the host.
SHARE_OF_HOST = 0.05
#: The share says nothing of a handful of documents: lines of so many or fewer stay.
MIN_DOCS = 3
#: A document is rejected when fewer words, or a smaller share of its words, are left.
LEAST_WORDS = 10
LEAST_SHARE = 0.2

_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1

FACTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "lines array<struct<h:long,words:int>>")


def _distinct(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each document's distinct keys (their first ones), and how often each key stands in its document."""
    own = mix(keys ^ mix(doc.astype(_U) + _U(1)))
    _, first, inverse, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    return first, n[inverse]


def facts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The base statistics of each document of a chunk, and its distinct normalised lines with their words."""
    w = words(data, at)
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    n_words = np.diff(w.first)
    doc = w.doc_of_word()

    run, ok = sequences(w, 5)
    starts = np.flatnonzero(ok)
    cover = np.zeros(len(run) + 1, np.int64)
    if len(starts):
        _, n = _distinct(run[starts], doc[starts])
        again = starts[n > 1]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + 5, -1)
    repeated = np.cumsum(cover[:-1]) > 0

    raw = words(data, at, separators=_LINE_END)  # lines as written, empty ones left out
    low = words(data, at, lower=True)
    a, b = np.searchsorted(low.start, raw.start), np.searchsorted(low.start, raw.end)
    with_word = np.flatnonzero(b > a)
    line_doc = raw.doc_of_word()[with_word]
    first, _ = _distinct(raw.hash[with_word], line_doc)
    n_lines = np.bincount(line_doc, minlength=len(n_words))
    n_unlike = np.bincount(line_doc[first], minlength=len(n_words))

    a, b = a[with_word], b[with_word]
    total, back = running(low.hash)
    plain = mix((total[b] - total[a]) * back[a] + (b - a).astype(_U))
    first, times = _distinct(plain, line_doc)
    order = np.sort(first)
    return {"n_words": n_words, "word_chars": per_document(w, lead[w.end] - lead[w.start]),
            "n_symbols": np.diff(np.concatenate([[0], np.cumsum(_SYMBOL[data])])[at]), "n_dup_lines": n_lines - n_unlike,
            "n_repeat_words": per_document(w, repeated), "line_h": plain[order].view(np.int64),
            "line_words": ((b - a) * times)[order].astype(np.int32),
            "line_at": np.searchsorted(line_doc[order], np.arange(len(n_words) + 1))}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in chunks(batch.column(batch.num_columns - 1)):
            f = facts(data, at)
            lines = pa.ListArray.from_arrays(pa.array(f["line_at"].astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(f["line_h"]), pa.array(f["line_words"])], names=["h", "words"]))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *(pa.array(f[n].astype(np.int64)) for n in names), lines],
                names=[*batch.schema.names[:-1], *names, "lines"])


def line_facts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id, host, a hash of the text, base statistics and distinct normalised lines."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
                       F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_rows, "doc_id long, host string, h long, " + FACTS)


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE_OF_HOST) -> DataFrame:
    """(host, line): lines that a larger share of a host's distinct documents hold than allowed.

    Documents with equal text are one document here, so copies alone make no line frequent.  Beyond
    ``min_docs / share`` documents the size of a host does not matter.
    """
    texts = rows.select("host", "h", "lines").dropDuplicates(["host", "h"])
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"))
    held = texts.select("host", F.explode("lines.h").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    return (held.where(F.col("n") > min_docs).join(hosts.withColumnRenamed("host", "h_host"), F.col("host").eqNullSafe(F.col("h_host")))
            .where(F.col("n") > F.lit(share) * F.col("n_docs")).select("host", "line"))


def quality(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
            min_docs: int = MIN_DOCS, share: float = SHARE_OF_HOST) -> DataFrame:
    """Base statistics, base verdict and the verdict after frequent lines are gone, for every row.

    A null text has no words and fails; a null host is a host of its own; rows with equal id, host and
    text get equal results; other columns are ignored; an empty table gives an empty table.
    """
    rows = materialize(line_facts(docs, id_col, host_col, text_col), "lines")
    often = frequent_lines(rows, min_docs, share)
    lines = rows.select(F.col("doc_id").alias("g_id"), F.col("host").alias("g_host"), F.col("h").alias("g_h"),
                        F.explode("lines").alias("l"))
    # repeated rows are collapsed by max below: equal rows carry equal words
    hit = (lines.join(often, F.col("g_host").eqNullSafe(F.col("host")) & (F.col("l.h") == F.col("line")))
           .groupBy("g_id", "g_host", "g_h", "line").agg(F.max("l.words").alias("words"))
           .groupBy("g_id", "g_host", "g_h").agg(F.sum("words").alias("gone")))
    out = rows.drop("lines").join(hit, F.col("doc_id").eqNullSafe(F.col("g_id")) & F.col("host").eqNullSafe(F.col("g_host"))
                                  & (F.col("h") == F.col("g_h")), "left")
    gone = F.coalesce("gone", F.lit(0))
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (left < LEAST_WORDS) | (left < F.lit(LEAST_SHARE) * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.cast("long").alias("n_removed_words"))
