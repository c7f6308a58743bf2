"""Packing documents into token windows by non-negative least squares on the length histogram.

Whole windows are cut off each document; what is left has one of window-1 lengths.  All combinations
of up to three lengths that fill a window are enumerated, their repeat counts are solved against the
histogram of left-over lengths under non-negativity, rounded to what the histogram holds, and the
residual is packed greedily (longest first, tightest window).  Solving works on the histogram alone,
whose size does not grow with the corpus; documents are dealt their places by rank.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotide.llm.shared import in_arrow
from geotide.llm.tokens import encoder
from geotide.session import materialize

WINDOW = 1024
END_ID = 0
#: Steps of the solver at most; fewer steps only leave more for the greedy packing.
STEPS = 30_000


def _pieces(window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder()
    part = TaskContext.get().partitionId()
    rank = np.zeros(window + 1, dtype=np.int64)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "local")}
        for doc, text in zip(ids, batch.column(1)):
            tokens = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
            for at in range(0, len(tokens), window):
                piece = tokens[at:at + window]
                for k, v in zip(out, (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(tokens), rank[len(piece)])):
                    out[k].append(v)
                rank[len(piece)] += 1
        n = len(out["start"])
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()] + [pa.array([part] * n, pa.int64())],
                                         names=[*out, "part"])


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """All a >= b >= c >= 0 with a + b + c = window, a and b and c (unless 0) among ``lengths``."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    has[0] = True
    out = []
    for a in range(window, 0, -1):
        if has[a]:
            b = np.arange(min(a, window - a), -1, -1)
            c = window - a - b
            ok = (c <= b) & (c >= 0)
            b, c = b[ok], c[ok]
            ok = has[b] & has[c]
            out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def solve(hist: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative least squares of combination counts against the histogram, by coordinate descent.

    Each step moves the combination with the largest gain to its best non-negative value; a step
    touches only the combinations that share one of its lengths.
    """
    n = len(hist)
    if not len(combos):
        return np.zeros(0)
    cols = np.where(combos > 0, combos, n)  # zero lengths point past the end
    by_length = defaultdict(list)
    order = np.argsort(cols.ravel(), kind="stable")
    flat = cols.ravel()[order]
    cut = np.searchsorted(flat, np.arange(n + 1))
    for length in range(n):
        by_length[length] = order[cut[length]:cut[length + 1]] // 3
    many = np.zeros(len(combos))
    for k in range(3):
        many += ((cols == cols[:, [k]]) * (cols < n)).sum(axis=1) * (cols[:, k] < n)  # sum of squared multiplicities
    grad = np.append(hist.astype(float), 0.0)[cols].sum(axis=1)
    x = np.zeros(len(combos))
    stop = max(0.5, 1e-7 * float(hist.sum()))
    for _ in range(steps):
        step = np.maximum(grad / many, -x)
        j = int(np.argmax(np.abs(step)))
        if abs(step[j]) < stop:
            break
        x[j] += step[j]
        for length in cols[j]:
            if length < n:
                np.subtract.at(grad, by_length[length], step[j])
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths, how many), which together hold exactly the histogram."""
    left = hist.astype(np.int64).copy()
    out = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(window, np.flatnonzero(left))
    x = solve(left, combos)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        lengths, need = np.unique(combos[j][combos[j] > 0], return_counts=True)
        times = min(int(x[j] + 0.5), int((left[lengths] // need).min()))
        if times:
            left[lengths] -= times * need
            out.append((tuple(int(v) for v in combos[j] if v), times))
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # free space: windows begun
    for length in np.flatnonzero(left)[::-1]:
        count = int(left[length])
        length = int(length)
        space = length
        while count and space < window:
            if room.get(space):
                inside, times = room[space].pop()
                used = min(times, count)
                if used < times:
                    room[space].append((inside, times - used))
                room[space - length].append(((*inside, length), used))
                count -= used
            else:
                space += 1
        per = window // length  # the rest opens windows, each filled with as many as fit
        if count >= per:
            room[window - per * length].append(((length,) * per, count // per))
        if count % per:
            room[window - count % per * length].append(((length,) * (count % per), 1))
    return out + [x for windows in room.values() for x in windows if x[1]]


def _places(plans: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: from which rank on a slot holds, the first sequence of the slot, and its offset."""
    rows = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, times in plans:
        offset = 0
        for length in lengths:
            rows[length].append((used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in rows.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty and still has its end id.  Every row is packed, repeated rows each on their
    own; a null id stays null; other columns are ignored; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "local", "part")
    # written once: a piece's rank among the pieces of its length and task has to stay the same
    pieces = materialize(in_arrow(rows, lambda b: _pieces(window, b), ", ".join(f"{c} long" for c in fields)), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row per length
        hist[r["length"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(_places(plan(hist, window)))  # bounded by the combinations

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(2).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                low, first, at = places.value[int(value)]
                own = length == value
                slot = np.searchsorted(low, rank[own], side="right") - 1
                sequence[own] = first[slot] + rank[own] - low[slot]
                offset[own] = at[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=[*fields[:5], "sequence_id", "offset"])

    ranked = pieces.join(base, ["part", "length"]).select(*fields[:5], (F.col("local") + F.col("base")).alias("rank"))
    schema = ", ".join(f"{c} long" for c in (*fields[:5], "sequence_id", "offset"))
    return in_arrow(ranked, put, schema)
