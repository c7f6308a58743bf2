"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

The terms of all items form one automaton whose keys carry a space on either side.  A document is
scanned with its letters lowered and each separator replaced by a space, so that a key matches where
a whole term stands, and the automaton's outputs give the documents' term frequencies directly.  One
scan counts in how many documents each term stands; with these weights a second scan scores every
document for every item, the outputs mapping to items, and keeps the best of each task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A term: a run of characters outside this class.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms that one automaton may hold; more items are searched in several rounds.
AUTOMATON_BYTES = 4 << 20
#: Bytes of a text scanned at once (longer ones are cut between terms), cells of a score table, and rows kept before a cut.
SCAN_BYTES = 1 << 20
CELLS = 1 << 20
PENDING = 1 << 17
#: Groups that the tasks' best rows are merged in before the last merge.
MERGES = 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 0x80 or chr(c) in _LOWER or chr(c) in "0123456789" else ord(chr(c).lower()) if chr(c) in _UPPER else 0x20
              for c in range(256))


@dataclass
class Plan:
    """One automaton's share of the items: its terms, and which items hold each of them (as compressed rows)."""

    automaton: object
    n_terms: int
    items: pa.Array
    start: np.ndarray
    item: np.ndarray


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, term) of all items."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    found = F.regexp_extract_all(low, F.lit(f"({TERM})"))
    return items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def make_plan(pairs: pa.Table) -> Plan:
    """Automaton of the distinct terms; keys are the terms' UTF-8 bytes between two spaces."""
    import ahocorasick

    terms, items = pairs["term"].combine_chunks().dictionary_encode(), pairs["item"].combine_chunks()
    known = items.unique()
    at = {x: k for k, x in enumerate(known.to_pylist())}
    automaton = ahocorasick.Automaton()
    for k, t in enumerate(terms.dictionary.to_pylist()):
        automaton.add_word(f" {t.encode().decode('latin-1')} ", k)
    if len(terms.dictionary):
        automaton.make_automaton()
    of = terms.indices.to_numpy()
    own = np.array([at[x] for x in items.to_pylist()], dtype=np.int64)
    order = np.argsort(of, kind="stable")
    start = np.searchsorted(of[order], np.arange(len(terms.dictionary) + 1))
    return Plan(automaton, len(terms.dictionary), known, start, own[order])


def _pieces(data: bytes) -> Iterator[bytes]:
    """The bytes between two spaces in runs of bounded size; a term that is longer stays whole."""
    a = 0
    while len(data) - a > SCAN_BYTES:
        b = data.find(b" ", a + SCAN_BYTES)
        if b < 0 or b == len(data) - 1:
            break
        yield data[a:b + 1]
        a = b
    yield data[a:]


def scan(plan: Plan, text: bytes | None) -> tuple[int, Counter]:
    """Number of a text's terms, and how often each key of the automaton stands there."""
    data = b" " + (text or b"").translate(_FOLD) + b" "
    space = np.frombuffer(data, np.uint8) == 0x20
    n = int(np.count_nonzero(space[:-1] & ~space[1:]))
    tf: Counter = Counter()
    if plan.n_terms and n:
        for piece in _pieces(data):
            tf.update(map(itemgetter(1), plan.automaton.iter(piece.decode("latin-1"))))
    return n, tf


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.num_columns - 1).cast(pa.large_binary()).to_pylist()


def _frequencies(shared):
    """Per task: documents that hold each term (n), and in row -1 documents with a term and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        df = np.zeros(plan.n_terms, np.int64)
        docs = terms = 0
        for batch in batches:
            for text in _texts(batch):
                n, tf = scan(plan, text)
                docs, terms = docs + (n > 0), terms + n
                if tf:
                    df[np.fromiter(tf, np.int64, len(tf))] += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], docs)),
                                          pa.array(np.append(np.zeros(len(hit), np.int64), terms))], names=["term", "n", "terms"])

    return run


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.ones(items, np.int64)
        self.kept = [np.zeros(0, np.int64)] * 4  # item, score, id is null, id

    def add(self, scores: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        doc, item = np.nonzero(scores >= self.least)
        new = [item, scores[doc, item], absent[doc], ids[doc]]
        self.kept = [np.concatenate(x) for x in zip(self.kept, new)]
        if len(self.kept[0]) > PENDING:
            self.cut()

    def cut(self) -> None:
        item, score, absent, ids = self.kept
        order = np.lexsort((ids, absent, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        full = order[nth == self.k - 1]
        self.least[self.kept[0][full]] = score[full]
        self.kept = [x[order[nth < self.k]] for x in self.kept]


def _scores(shared, weights, totals: tuple[int, int], k: int):
    """Per task: the ``k`` best documents of each item."""
    n_docs, n_terms = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, w = shared.value, weights.value
        best, items = Best(len(plan.items), k), max(1, len(plan.items))
        step = max(1, CELLS // items)
        for batch in batches:
            ids, texts = batch.column(0), _texts(batch)
            absent = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(texts), step):
                rows, terms, adds = [], [], []
                for row, text in enumerate(texts[a:a + step]):
                    n, found = scan(plan, text)
                    if found:
                        term = np.fromiter(found.keys(), np.int64, len(found))
                        tf = np.fromiter(found.values(), np.int64, len(found))
                        m = 100 - 50 + 50 * n * n_docs // n_terms
                        rows.append(np.full(len(term), row))
                        terms.append(term)
                        adds.append(w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m)))
                if not rows:
                    continue
                rows, terms, adds = np.concatenate(rows), np.concatenate(terms), np.concatenate(adds)
                holders = plan.start[terms + 1] - plan.start[terms]
                first = np.repeat(plan.start[terms] - np.concatenate([[0], np.cumsum(holders)[:-1]]), holders)
                item = plan.item[first + np.arange(holders.sum())]
                scores = np.zeros((min(step, len(texts) - a), items), np.int64)
                np.add.at(scores, (np.repeat(rows, holders), item), np.repeat(adds, holders))
                best.add(scores, absent[a:a + step], ids[a:a + step])
        best.cut()
        item, score, absent, ids = best.kept
        yield pa.RecordBatch.from_arrays([plan.items.take(pa.array(item)), pa.array(ids, mask=absent.astype(bool)), pa.array(score)],
                                         names=["item_id", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    Equal scores stand by ascending doc_id, a null id last.  A null text holds no term.  Rows with the
    same item_id, null included, are one item with the terms of all; items without terms get no rows.
    Rows of documents are documents of their own, repeated ids too.  Texts of any length are scanned whole.
    An empty table on either side gives an empty result, and further columns are not read.  Items
    whose terms need more than ``automaton_bytes`` are dealt to several automata, each with scans
    of its own, so that none that is broadcast grows with the number of items.
    """
    spark = docs.sparkSession
    pairs = item_terms(items, item_col, item_text_col)
    volume = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    shares = max(1, -(-int(volume) // automaton_bytes))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    item_type = items.schema[item_col].dataType.simpleString()
    found = spark.createDataFrame([], f"item_id {item_type}, doc_id long, score long")
    for share in range(shares):
        plan = make_plan(pairs.where(F.pmod(F.xxhash64("item"), F.lit(shares)) == share).toArrow())  # bounded by automaton_bytes
        if not plan.n_terms:
            continue
        shared = spark.sparkContext.broadcast(plan)
        counted = (source.select("text").mapInArrow(_frequencies(shared), "term long, n long, terms long")
                   .groupBy("term").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).toArrow())  # one row per term of the automaton
        term, n = counted["term"].to_numpy(), counted["n"].to_numpy()
        if not counted.num_rows or not n[term < 0].sum():
            continue
        totals = int(n[term < 0][0]), int(counted["terms"].to_numpy()[term < 0][0])
        df = np.zeros(plan.n_terms, np.int64)
        df[term[term >= 0]] = n[term >= 0]
        weights = np.array([math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        found = found.unionByName(source.mapInArrow(_scores(shared, spark.sparkContext.broadcast(weights), totals, k), found.schema))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = found.withColumn("merge", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "merge").orderBy(*order))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
