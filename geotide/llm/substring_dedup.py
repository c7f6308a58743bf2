"""Substring dedup by repeated-phrase automata.

1. Anchors: each window of ``size`` words has an anchor, the smallest hash of its shorter word runs, so
   equal windows have equal anchors.  Consecutive windows with one anchor are one phrase.  A bounded bitmap
   rules out anchors that occur once (false positives only cost time).
2. Phrases: the others are confirmed by grouping their hashes; each has a first place.  A window can stand in
   differing phrases only where these share an anchor: such windows are confirmed by grouping too, each from the first
   place of its phrase, because all other places of the phrase are known.
3. Automata: all documents are dealt to shards of bounded text, confirmed phrases to the shards that hold
   them, and each shard compiles one Aho-Corasick automaton over word numbers and streams its documents
   through it.  Every occurrence but the first is removed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotide.llm.bitmaps import bitmap, in_bitmap, upper_half
from geotide.llm.shared import text_or_empty
from geotide.llm.words import Words, chunks, mix, running, sequences, words
from geotide.session import materialize

_U = np.uint64

#: Words of a window, and of the runs whose smallest hash is its anchor.
SIZE = 20
RUN = 8
#: Characters of text per shard.
SHARD_CHARS = 1_000_000


def anchors(w: Words, size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor of the window at each word, which words start a window, and the run hashes with their validity."""
    h, ok_run = sequences(w, run)
    _, ok = sequences(w, size)
    low, width, span = h.copy(), 1, size - run + 1
    while width < span:  # minimum over a growing width, the last step overlapping
        step = min(width, span - width)
        if len(low) > step:
            low[:-step] = np.minimum(low[:-step], low[step:])
        width += step
    return low, ok, h, ok_run


def _keyed(rows: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """(id, shard, text, doc_id): a null id counts after all others."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1).cast("long"))
    shard = F.pmod(F.xxhash64(id_col, text_col), F.lit(shards)).cast("int")
    return rows.select(key.alias("id"), shard.alias("shard"), F.col(text_col).alias("text"),
                       F.col(id_col).cast("long").alias("doc_id"))


def recurring_anchors(docs: DataFrame, size: int, run: int) -> np.ndarray:
    """Bitmap of the anchors that stand at two places or more (a fixed number of bits)."""

    def emit(batches):
        for batch in batches:
            for _, _, data, at in chunks(batch.column(0)):
                w = words(data, at)
                low, ok, h, ok_run = anchors(w, size, run)
                used = np.unique(low[ok])
                u, n = np.unique(h[ok_run], return_counts=True)
                n = n[np.searchsorted(u, used)]
                yield pa.RecordBatch.from_arrays([upper_half(used), pa.array(np.minimum(n, 2))], names=["m", "n"])

    return bitmap(docs.select("text").mapInArrow(emit, "m long, n long"))


def _phrases(w: Words, anchored: np.ndarray, size: int, run: int) -> tuple[np.ndarray, ...]:
    """(start, n, p, m, more): phrases of a chunk whose anchor the bitmap keeps, as first word, number of windows, hash, anchor,
    and whether the anchor stands there more than once, so that windows may recur within the phrase."""
    low, inside, h, _ = anchors(w, size, run)
    inside[inside] = in_bitmap(anchored, low[inside])
    doc = w.doc_of_word()
    begins = inside.copy()
    begins[1:] &= ~(inside[:-1] & (low[1:] == low[:-1]) & (doc[1:] == doc[:-1]))
    ends = inside.copy()
    ends[:-1] &= ~(inside[1:] & ~begins[1:])
    start = np.flatnonzero(begins)
    n = np.flatnonzero(ends) + 1 - start
    runs = n + size - run
    cut = np.cumsum(runs) - runs
    same = h[np.arange(runs.sum()) + np.repeat(start - cut, runs)] == np.repeat(low[start], runs)
    more = np.add.reduceat(same, cut, dtype=np.int64) > 1 if len(cut) else np.zeros(0, bool)
    return start, n, _run_hashes(w, start, n + size - 1), low[start], more


def _run_hashes(w: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of runs of words; for one length the same as ``sequences``."""
    total, back = running(w.hash)
    return mix((total[start + length] - total[start]) * back[start])


def _place_hash(p: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(p ^ mix(ids.astype(_U) + start.astype(_U) * _U(0x9E3779B97F4A7C15)))


def phrases(rows: DataFrame, anchored, size: int, run: int) -> DataFrame:
    """(p, m, id, start, times, more): every phrase with the upper half of its anchor, its first place, its number of places, and
    1 or, where windows may recur within it, 2."""

    def emit(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, data, at in chunks(batch.column(1)):
                w = words(data, at)
                start, _, p, m, more = _phrases(w, anchored.value, size, run)
                of = np.searchsorted(w.first, start, side="right") - 1
                place = (start - w.first[of]).astype(np.int32)
                order = np.lexsort((place, ids[lo + of]))
                _, first, times = np.unique(p[order], return_index=True, return_counts=True)
                pick = order[first]
                yield pa.RecordBatch.from_arrays([pa.array(p[pick].view(np.int64)), upper_half(m[pick]), pa.array(ids[lo + of[pick]]),
                                                  pa.array(place[pick]), pa.array(times), pa.array(1 + more[pick].astype(np.int32))],
                                                 names=["p", "m", "id", "start", "times", "more"])

    found = rows.select("id", "text").mapInArrow(emit, "p long, m long, id long, start int, times long, more int")
    return (found.groupBy("p").agg(F.min("m").alias("m"), F.min(F.struct("id", "start")).alias("f"), F.sum("times").alias("times"), F.max("more").alias("more"))
            .select("p", "m", "f.id", "f.start", "times", "more"))


def _first_places(found: DataFrame, often) -> np.ndarray:
    """Bitmap of the first places of the phrases that the bitmap of recurring ones keeps, false positives included."""

    def emit(batches):
        for batch in batches:
            p, ids, start = (batch.column(k).to_numpy() for k in range(3))
            again = in_bitmap(often.value, p.view(_U))
            h = _place_hash(p.view(_U), ids, start)[again]
            yield pa.RecordBatch.from_arrays([upper_half(h), pa.array(np.full(len(h), 2))], names=["m", "n"])

    return bitmap(found.select("p", "id", "start").mapInArrow(emit, "m long, n long"))


def repeats(rows: DataFrame, anchored, often, ambiguous, firsts, size: int, run: int) -> DataFrame:
    """(p, shard, id, start, len, times): places of recurring phrases, and windows that may stand in differing phrases at first places.

    Within a chunk only the first of equal word runs of a shard is emitted, with the number of their places.
    """

    def emit(batches):
        for batch in batches:
            ids, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, _, data, at in chunks(batch.column(2)):
                w = words(data, at)
                start, n, p, m, _ = _phrases(w, anchored.value, size, run)
                of = np.searchsorted(w.first, start, side="right") - 1
                again = in_bitmap(often.value, p)
                wide = in_bitmap(ambiguous.value, m)
                wide[wide & again] = in_bitmap(firsts.value, _place_hash(p, ids[lo + of], start - w.first[of])[wide & again])
                some = n[wide]
                flat = np.arange(some.sum()) + np.repeat(start[wide] - np.cumsum(some) + some, some)
                name = np.concatenate([p[again], _run_hashes(w, flat, np.full(len(flat), size))])
                word = np.concatenate([start[again], flat])
                length = np.concatenate([n[again] + size - 1, np.full(len(flat), size)])
                of = lo + np.concatenate([of[again], np.repeat(of[wide], some)])
                place = word - w.first[of - lo]
                order = np.lexsort((place, ids[of]))
                _, first, times = np.unique(name[order] ^ mix(shard[of[order]].astype(_U) + _U(1)), return_index=True, return_counts=True)
                pick = order[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[pick].view(np.int64)), pa.array(shard[of[pick]]), pa.array(ids[of[pick]]), pa.array(place[pick].astype(np.int32)),
                     pa.array(length[pick].astype(np.int32)), pa.array(times.astype(np.int32))], names=["p", "shard", "id", "start", "len", "times"])

    return rows.mapInArrow(emit, "p long, shard int, id long, start int, len int, times int")


def confirmed(rows: DataFrame, anchored, size: int, run: int) -> DataFrame:
    """Patterns by shard: (shard, p, id, start, len, f_id, f_start), a word run's place in the shard and its first of all."""
    share = rows.sparkSession.sparkContext.broadcast  # 2**BITMAP_BITS bits each
    found = materialize(phrases(rows, anchored, size, run), "phrases")
    often = found.where("times > 1")
    half = F.shiftrightunsigned("p", 32).alias("m")
    again = share(bitmap(often.select(half, F.lit(2).alias("n"))))
    places = materialize(repeats(rows, anchored, again, share(bitmap(found.select("m", F.col("more").alias("n")))),
                                 share(_first_places(found, again)), size, run), "places")
    first = (places.groupBy("p").agg(F.min(F.struct("id", "start")).alias("f"), F.sum("times").alias("times"))
             .where("times > 1").select("p", "f"))
    return places.join(first, "p").select("shard", "p", "id", "start", "len", F.col("f.id").alias("f_id"), F.col("f.start").alias("f_start"))


def _compile(patterns: pa.Table, w: Words, numbers: list[int], ids: np.ndarray):
    """Automaton over the word numbers of a shard; the words of a phrase are read at its first place in the shard."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    total, back = running(w.hash)
    order = np.argsort(ids, kind="stable")
    name, at, length, p, f_id, f_start = (patterns[c].to_numpy() for c in ("id", "start", "len", "p", "f_id", "f_start"))
    lo, hi = (np.searchsorted(ids[order], name, side=s) for s in ("left", "right"))
    many = hi - lo  # more than one only where texts share an id
    k = np.repeat(np.arange(len(name)), many)
    doc = order[np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + lo[k]]
    a = w.first[doc] + at[k]
    b = a + length[k]
    inside = b <= w.first[doc + 1]
    k, a, b = k[inside], a[inside], b[inside]
    p = p.view(_U)[k]
    same = mix((total[b] - total[a]) * back[a]) == p
    k, a, b = k[same], a[same], b[same]
    _, pick = np.unique(p[same], return_index=True)  # a phrase has one first place, wherever it stands
    k, a, b = k[pick], a[pick], b[pick]
    for i, j, *first in zip(a.tolist(), b.tolist(), f_id[k].tolist(), f_start[k].tolist()):
        machine.add_word(tuple(numbers[i:j]), (j - i, *first))
    machine.make_automaton()
    return machine


def _stream(size: int, docs: pa.Table, patterns: pa.Table) -> pa.Table:
    """One shard: compile its phrases, stream its documents, and say which words go."""
    docs = docs.combine_chunks()
    out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256")}
    for _, _, data, at in chunks(docs["text"], 1 << 62):  # the whole shard at once
        w = words(data, at)
        numbers = (np.unique(w.hash, return_inverse=True)[1] + 1).tolist()
        ids = docs["id"].to_numpy()
        machine = _compile(patterns, w, numbers, ids) if len(patterns) else None
        first, byte = w.first.tolist(), at.tolist()
        for k, (doc_id, here) in enumerate(zip(docs["doc_id"].to_pylist(), ids.tolist())):
            a, b = first[k], first[k + 1]
            kept = data[byte[k]:byte[k + 1]].tobytes().split()
            gone = []
            if machine is not None and len(machine) and b - a >= size:
                for end, (length, f_id, f_start) in machine.iter(tuple(numbers[a:b])):
                    if (f_id, f_start) < (here, end - length + 1):  # an earlier place has the same words
                        gone.append((end - length + 1, end + 1))
            n_lost = 0
            if gone:
                begin, end = np.array(gone).T
                step = np.bincount(begin, minlength=b - a + 1) - np.bincount(end, minlength=b - a + 1)
                stays = np.cumsum(step[:-1]) == 0
                n_lost = b - a - int(np.count_nonzero(stays))
                kept = compress(kept, stays.tolist())
            for c, v in zip(out, (doc_id, b - a, n_lost, hashlib.sha256(b" ".join(kept)).hexdigest())):
                out[c].append(v)
    return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
                     "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row: words in windows that also start earlier go.

    Null text has no words.  A null id comes after all others.  Rows that repeat an id count as one
    document: of equal rows none is earlier than the other.  Other columns are ignored; an empty
    table gives an empty table.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.char_length(text_or_empty(text_col)).cast("long"))).first()[0] or 0
    rows = _keyed(docs, id_col, text_col, max(1, -(-chars // SHARD_CHARS)))
    anchored = spark.sparkContext.broadcast(recurring_anchors(rows, size, run))  # 2**BITMAP_BITS bits
    patterns = confirmed(rows.select("id", "shard", "text"), anchored, size, run)
    return (rows.groupBy("shard").cogroup(patterns.groupBy("shard"))
            .applyInArrow(lambda left, right: _stream(size, left, right), RESULT))
