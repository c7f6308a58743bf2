"""Exact top-k inner-product search by MaxScore.

A vector is a document of terms: its components are the terms' weights, and per term all weights of
a block of rows stand together (the term's postings).  For a query the terms are ordered by their
score bounds, the most a term can add in a block.  Those before the point where the bounds of the
rest no longer reach the query's k-th best score are essential: their postings are traversed for all
rows of the block.  The other terms are probed only for rows that stay competitive, a few terms at a
time, and a block whose bounds together fall short is skipped.  Rows are dealt into shards and queries into blocks
of bounded size; each pair of them is one group, and the best of all shards are merged per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geotide.session import materialize

#: Components are multiplied by this and rounded down.
SCALE = 256
#: Rows of a shard and queries of a block: together what one task holds.
SHARD_ROWS = 1 << 14
BLOCK_QUERIES = 1 << 13
#: Rows whose postings are traversed at once, and terms probed between two looks at the bounds.
POSTINGS = 2048
PROBES = 6

_FOUND = "query_uid long, query_id long, vec_id long, uid long, score long"


def quantised(rows: DataFrame, asks: Column, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v, asks): integer components of the rows whose vector and components are all there and finite."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return (rows.where(F.col(vector_col).isNotNull()).where(whole)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
                    F.coalesce(asks, F.lit(False)).alias("asks")))


def _exact(bound: int):
    """The quickest number type in which sums up to ``bound`` are exact."""
    if bound < 1 << 24:
        return np.float32
    if bound < 1 << 53:
        return np.float64
    return np.int64 if bound < 1 << 63 else object


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of components; a vector that is shorter than the widest one holds zero terms behind its end."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


class Postings:
    """Weights of a block of rows, term by term, with each term's largest and smallest weight."""

    def __init__(self, weights: np.ndarray, at: int):
        self.at = at
        self.terms = np.ascontiguousarray(weights.T)
        self.high, self.low = weights.max(axis=0), weights.min(axis=0)

    def competitive(self, query: np.ndarray, least) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the block whose score is ``least`` or more, and their scores (all rows if ``least`` is None)."""
        none = np.zeros(0, np.int64)
        bound = np.maximum(query * self.high, query * self.low)
        order = np.argsort(-bound)
        rest = np.zeros(len(order) + 1, dtype=bound.dtype)  # rest[i]: the most that terms i and later add
        rest[:-1] = np.cumsum(bound[order][::-1])[::-1]
        if least is not None and rest[0] < least:
            return none, none
        essential = len(order)
        if least is not None:
            short = np.flatnonzero(rest < least)
            essential = int(short[0]) if len(short) else essential
        first = order[:essential]
        score = query[first] @ self.terms[first]
        if least is None:
            return np.arange(len(score)), score
        rows = np.flatnonzero(score + rest[essential] >= least)
        score = score[rows]
        for a in range(essential, len(order), PROBES):
            if not len(rows):
                break
            probe = order[a:a + PROBES]
            score = score + query[probe] @ self.terms[np.ix_(probe, rows)]
            stay = score + rest[min(a + PROBES, len(order))] >= least
            rows, score = rows[stay], score[stay]
        return rows, score


def _searcher(k: int, width: int, kind):
    """Best ``k`` rows of a shard for each query of a block."""

    def search(shard: pa.Table, queries: pa.Table) -> pa.Table:
        weights = _matrix(shard["v"], width).astype(kind)
        asked = _matrix(queries["v"], width).astype(kind)
        uid, vec = shard["uid"].to_numpy(), shard["id"].combine_chunks()
        order_id = vec.fill_null(0).to_numpy(zero_copy_only=False)
        absent = vec.is_null().to_numpy(zero_copy_only=False)
        own = queries["uid"].to_numpy()
        best_rows = [np.zeros(0, np.int64)] * len(asked)
        best_scores = [np.zeros(0, kind)] * len(asked)
        for at in range(0, len(weights), POSTINGS):
            block = Postings(weights[at:at + POSTINGS], at)
            for q in range(len(asked)):
                least = best_scores[q][-1] if len(best_scores[q]) == k else None
                rows, score = block.competitive(asked[q], least)
                rows = rows + at
                other = uid[rows] != own[q]
                rows, score = np.concatenate([best_rows[q], rows[other]]), np.concatenate([best_scores[q], score[other]])
                keep = np.lexsort((uid[rows], order_id[rows], absent[rows], -score))[:k]
                best_rows[q], best_scores[q] = rows[keep], score[keep]
        n = [len(r) for r in best_rows]
        rows = np.concatenate([*best_rows, np.zeros(0, np.int64)]).astype(np.int64)
        scores = np.concatenate([*best_scores, np.zeros(0, kind)]).astype(np.int64)
        times = np.repeat(np.arange(len(asked)), n)
        return pa.table({"query_uid": pa.array(own[times]), "query_id": queries["id"].combine_chunks().take(pa.array(times)),
                         "vec_id": vec.take(pa.array(rows)), "uid": pa.array(uid[rows]), "score": pa.array(scores)})

    return search


def top_k(rows: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For each row whose id fulfils ``asks``: the ``k`` other rows of the largest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; equal scores by ascending id, a null id last.
    Vectors that are null or hold a null or non-finite component take no part.  An empty vector has
    score 0 with all; of vectors of different lengths the common part counts.  Rows with a repeated
    id are rows of their own: each asks for itself and finds its twins.  An empty table gives an empty
    one; further columns are not read.  A sum beyond 64 bits is an error.
    """
    spark = rows.sparkSession
    # stored, so that the row numbers that tell rows with equal ids apart stay as they are
    table = quantised(rows, asks, id_col, vector_col, scale).withColumn("uid", F.monotonically_increasing_id())
    table = materialize(table, "vectors")
    size = F.coalesce(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))), F.lit(0))
    n, asked, width, largest = table.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0)),
                                         F.coalesce(F.max(size), F.lit(0))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards, blocks = -(-n // shard_rows), -(-asked // block_queries)
    kind = _exact(max(1, width) * (largest + 1) ** 2)
    dealt = F.xxhash64("uid")
    left = table.select("uid", "id", "v", F.pmod(dealt, F.lit(shards)).cast("long").alias("shard"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = table.where("asks").select("uid", "id", "v", F.pmod(dealt, F.lit(blocks)).cast("long").alias("block"),
                                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    search = _searcher(k, max(1, width), kind)
    found = (left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
             .applyInArrow(lambda a, b: search(a, b), _FOUND))
    best = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
