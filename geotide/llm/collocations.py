"""Phrase collocations by Toivonen's method.

A sample of the documents, mined level by level with a lowered threshold, proposes phrases.  One pass
over all documents counts them and their negative border, which are the phrases that the sample did
not propose but whose two parts (without the last and without the first word) it did; single words
all belong to the border.  Where the exact counts show a border phrase to be frequent, further passes
count the phrases that it opens, until none is left: then every frequent phrase has been counted,
whatever the sample held.  Counts are exact sums over all documents; the sample only decides how many passes there are.

Phrases travel as 64-bit hashes in numpy batches, summed within a task before they are shuffled.  The
phrases that a pass builds on are a bitmap with at least eight bits a phrase.  When these are more
than one bitmap of bounded size can hold, the range of hashes is cut and each cut has a pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotide.llm.words import SPACE, chunks, mix, running, words
from geotide.session import materialize

#: Share of documents in the sample, and the standard deviations that its threshold lies below the share of the real one.
SAMPLE = 1 / 8
SLACK = 2.0
#: Longest phrase, smallest and largest bits of a bitmap as powers of two, bits for each phrase.
WORDS = 5
LEAST_BITS, MOST_BITS = 16, 27
BITS_EACH = 16
#: Distinct phrases that a task sums up before it hands them on.
PENDING = 1 << 20
UNKNOWN = "und"
COUNTED = ["lang", "size", "h", "n"]

_U = np.uint64
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATORS = _PIECE | (SPACE & ~_PIECE)


@dataclass
class Bitmap:
    """Hashes of one cut of their range: cut ``cut`` of ``cuts``."""

    bits: int
    cut: int
    cuts: int
    words: np.ndarray

    def own(self, h: np.ndarray) -> np.ndarray:
        """Does the hash lie in this cut?"""
        return (h >> _U(40)) % _U(self.cuts) == _U(self.cut) if self.cuts > 1 else np.ones(len(h), bool)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & _U((1 << self.bits) - 1)
        return (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def bitmap(found: DataFrame, bits: int, cut: int, cuts: int) -> Bitmap:
    """Bitmap of the hashes ``h`` of one cut; at most 2**(bits-6) words reach the driver."""
    h = F.col("h")
    own = found if cuts == 1 else found.where(F.pmod(F.shiftrightunsigned(h, 40), F.lit(cuts)) == cut)
    at = h.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = own.select(F.shiftrightunsigned(at, 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << max(bits - 6, 0), dtype=_U)
    if rows.num_rows:
        out[rows["w"].to_numpy()] = rows["b"].to_numpy().view(_U)
    return Bitmap(bits, cut, cuts, out)


@dataclass
class Phrases:
    """Phrases of one chunk: hashes of those of each length, by first word; 0 where a piece ends before."""

    at: np.ndarray        # byte offsets of the words, from and to
    end: np.ndarray
    data: np.ndarray
    doc: np.ndarray       # document of each word
    left: np.ndarray      # words from here to the end of the piece
    total: np.ndarray
    back: np.ndarray
    salt: np.ndarray      # language of each word, hashed

    def hashes(self, size: int) -> np.ndarray:
        """Hash of the phrase of ``size`` words at each word that has so many left in its piece."""
        n = len(self.at)
        if n < size:
            return np.zeros(0, _U)
        return mix((self.total[size:] - self.total[:n - size + 1]) * self.back[:n - size + 1] + self.salt[:n - size + 1] + _U(size))

    def fits(self, size: int) -> np.ndarray:
        return np.flatnonzero(self.left >= size)


def phrases(data: np.ndarray, at: np.ndarray, salts: np.ndarray) -> Phrases:
    """Words of a chunk of documents and the pieces that they stand in."""
    w = words(data, at, lower=True, separators=_SEPARATORS)
    n = len(w.start)
    doc = w.doc_of_word()
    piece = np.cumsum(_PIECE[w.data])[w.start] if n else np.zeros(0, np.int64)
    last = np.flatnonzero(np.append((piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1]), True)) if n else np.zeros(0, np.int64)
    left = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1
    total, back = running(w.hash)
    return Phrases(w.start, w.end, w.data, doc, left, total, back, salts[doc])


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


class Sums:
    """Running sums by hash, handed on whenever there are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, h: np.ndarray) -> None:
        h, n = np.unique(h, return_counts=True)
        self.parts.append((h, n))
        self.size += len(h)

    def full(self) -> bool:
        if self.size > 2 * PENDING:
            self.parts = [_summed(*map(np.concatenate, zip(*self.parts)))]
            self.size = len(self.parts[0][0])
        return self.size > PENDING

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _summed(*map(np.concatenate, zip(*self.parts))) if self.parts else (np.zeros(0, _U), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


def _counts(sizes: tuple[int, ...], built_on, before):
    """Sums of the phrases of the given sizes whose parts are in ``built_on`` but not in ``before`` as well.

    Words count in the passes without ``before``, of one cut.  Also gives each language's number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = built_on.value if built_on else None
        old = before.value if before else None
        sums, per_lang = {size: Sums() for size in sizes}, {}

        def rows(size: int):
            h, n = sums[size].take()
            for a in range(0, len(h), 1 << 18):
                m = len(h[a:a + (1 << 18)])
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.array(np.full(m, size, np.int8)),
                                                  pa.array(h[a:a + m].view(np.int64)), pa.array(n[a:a + m])], names=COUNTED)

        def opened(of: Bitmap, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The first part is in this cut of the set, and the second is in it or belongs to another cut."""
            out = of.own(a)
            out[out] = of.has(a[out])
            out[out] = of.has(b[out]) | ~of.own(b[out])
            return out

        for batch in batches:
            langs, salts = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(_U)
            for lo, hi, data, at in chunks(batch.column(2)):
                p = phrases(data, at, salts[lo:hi])
                if not len(p.at):
                    continue
                shorter = p.hashes(sizes[0] - 1) if sizes[0] > 1 else None
                for size in sizes:
                    own = p.hashes(size)
                    fit = p.fits(size)
                    if not len(fit):
                        break
                    if size == 1:
                        if old is None and (known is None or known.cut == 0):
                            sums[1].add(own[fit])
                            per_doc = np.bincount(p.doc, minlength=hi - lo)
                            for k in np.flatnonzero(per_doc):
                                per_lang[langs[lo + k]] = per_lang.get(langs[lo + k], 0) + int(per_doc[k])
                    else:
                        a, b = shorter[fit], shorter[fit + 1]
                        pick = opened(known, a, b)
                        if old is not None:
                            pick[pick] = ~opened(old, a[pick], b[pick])
                        sums[size].add(own[fit[pick]])
                    shorter = own
                    if sums[size].full():
                        yield from rows(size)
        for size in sizes:
            yield from rows(size)
        if per_lang:
            m = len(per_lang)
            yield pa.RecordBatch.from_arrays([pa.array(per_lang, pa.string()), pa.nulls(m, pa.int8()), pa.nulls(m, pa.int64()),
                                              pa.array(per_lang.values(), pa.int64())], names=COUNTED)

    return run


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array?"""
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def _texts(wanted, exact):
    """One (h, lang, phrase) of each phrase of a task whose hash is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = wanted.value, exact.value
        seen = np.zeros(0, _U)
        for batch in batches:
            langs, salts = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(_U)
            for lo, hi, data, at in chunks(batch.column(2)):
                p = phrases(data, at, salts[lo:hi])
                out_h, out_lang, out_text = [], [], []
                for size in range(1, WORDS + 1):
                    own, fit = p.hashes(size), p.fits(size)
                    if not len(fit):
                        break
                    h = own[fit]
                    pick = known.own(h)
                    pick[pick] = known.has(h[pick])
                    pick[pick] = _among(h[pick], hashes)
                    h, first = np.unique(h[pick], return_index=True)
                    new = ~_among(h, seen)
                    h, first = h[new], fit[pick][first[new]]
                    raw = p.data.tobytes() if len(first) else b""
                    for i in first:
                        out_text.append(b" ".join(raw[a:b] for a, b in zip(p.at[i:i + size], p.end[i:i + size])).decode())
                        out_lang.append(langs[lo + p.doc[i]])
                    out_h.append(h)
                    seen = np.union1d(seen, h)
                if out_text:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_h).view(np.int64)), pa.array(out_lang, pa.string()),
                                                      pa.array(out_text, pa.string())], names=["h", "lang", "phrase"])
                if len(seen) > PENDING:  # the same phrases may come again
                    seen = np.zeros(0, _U)

    return run


class Miner:
    """Frequent phrases of a table of (lang, salt, text)."""

    def __init__(self, docs: DataFrame, least: int, most_bits: int):
        self.docs, self.least, self.most_bits = docs, least, most_bits
        self.spark = docs.sparkSession

    def share(self, bitmaps: list) -> list:
        return [self.spark.sparkContext.broadcast(b) for b in bitmaps]

    def bitmaps(self, found: DataFrame, n: int) -> list[Bitmap]:
        bits = min(self.most_bits, max(LEAST_BITS, int(np.ceil(np.log2(max(n, 1) * BITS_EACH)))))
        cuts = -(-n * BITS_EACH // (1 << self.most_bits)) or 1
        return [bitmap(found, bits, c, cuts) for c in range(cuts)]

    def count(self, docs: DataFrame, sizes: tuple[int, ...], built_on: list, before: list, least: int) -> DataFrame:
        """Phrases counted ``least`` times or more, and numbers of words per language, stored."""
        runs = [docs.mapInArrow(_counts(sizes, a, b), "lang string, size byte, h long, n long")
                for a, b in zip(built_on or [None], before or [None] * max(1, len(built_on)))]
        rows = runs[0]
        for more in runs[1:]:
            rows = rows.unionByName(more)
        summed = rows.groupBy("lang", "size", "h").agg(F.sum("n").alias("n"))
        return materialize(summed.where((F.col("n") >= least) | F.col("h").isNull()), "phrases")

    def proposed(self, sample: DataFrame, least: int) -> tuple[list[Bitmap], DataFrame]:
        """Level by level, phrases of the sample whose parts are frequent in it; bitmaps of all levels."""
        found, n, maps = None, 0, []
        for size in range(1, WORDS):
            more = self.count(sample, (size,), self.share(maps), [], least).where("h is not null").select("h")
            new = more.count()
            found, n = more if found is None else found.unionByName(more), n + new
            maps = self.bitmaps(found, n)
            if not new:
                break
        return maps, found

    def frequent(self, sample: DataFrame, sample_least: int) -> tuple[DataFrame, DataFrame]:
        """(size, h, n) of all frequent phrases of up to five words, and (lang, n) of all words."""
        maps, proposed = self.proposed(sample, sample_least)
        first = self.count(self.docs, tuple(range(1, WORDS + 1)), self.share(maps), [], self.least)
        words = first.where("h is null").select("lang", "n")
        found = first.where("h is not null").select("size", "h", "n")
        new = found
        while True:
            # border phrases that are frequent open phrases that no pass has counted
            failed = new.where(F.col("size") < WORDS).join(proposed, "h", "left_anti")
            if failed.isEmpty():
                return found, words
            proposed = proposed.unionByName(failed.select("h"))
            bits, cuts = maps[0].bits, len(maps)
            grown = [Bitmap(m.bits, m.cut, m.cuts, m.words | bitmap(failed, bits, m.cut, cuts).words) for m in maps]
            more = self.count(self.docs, tuple(range(2, WORDS + 1)), self.share(grown), self.share(maps), self.least)
            new = more.where("h is not null").select("size", "h", "n")
            found, maps = found.unionByName(new), grown

    def named(self, found: DataFrame, sample: DataFrame) -> DataFrame:
        """(lang, phrase, a): the texts of frequent phrases, from the sample and, for those it lacks, from all documents."""

        def texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
            maps = self.bitmaps(wanted, wanted.count())
            rows = None
            for m in maps:
                own = wanted if m.cuts == 1 else wanted.where(F.pmod(F.shiftrightunsigned("h", 40), F.lit(m.cuts)) == m.cut)
                hashes = np.sort(own.select("h").toArrow()["h"].to_numpy().view(_U))  # of one cut: 2**most_bits / BITS_EACH at most
                part = docs.mapInArrow(_texts(*self.share([m, hashes])), "h long, lang string, phrase string")
                rows = part if rows is None else rows.unionByName(part)
            return rows.groupBy("h").agg(F.min(F.struct("lang", "phrase")).alias("t"))

        seen = materialize(found.select("h", "n").join(texts(sample, found.select("h")), "h", "left"), "named")
        unseen = seen.where("t is null").select("h", "n")
        out = seen.where("t is not null")
        if not unseen.isEmpty():
            out = out.unionByName(unseen.join(texts(self.docs, unseen.select("h")), "h"))
        return materialize(out.select("t.lang", "t.phrase", F.col("n").alias("a")), "named")


def scored(frequent: DataFrame, words: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """Lowest-scoring cut of every frequent phrase of two words or more, without phrases that a longer one of
    equal count holds, and the first ``top`` of each language."""
    w = F.split("phrase", " ")
    sized = frequent.withColumns({"w": w, "size": F.size(w)})
    longer = sized.where("size >= 2")
    # a longer phrase with the same count holds one of one word more with that count, so one word more is enough
    inner = longer.where("size >= 3").select("lang", "a", F.explode(F.array(
        F.array_join(F.expr("slice(w, 1, size - 1)"), " "), F.array_join(F.expr("slice(w, 2, size - 1)"), " "))).alias("phrase")).distinct()
    kept = longer.join(inner, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("p1"),
                       F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("p2"))
    one = frequent.select("lang", F.col("phrase").alias("p1"), F.col("a").alias("l"))
    two = frequent.select("lang", F.col("phrase").alias("p2"), F.col("a").alias("r"))
    wide = "cast({} as decimal(19, 0))"
    exact = F.expr(f"cast((1000BD * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')}) as bigint)")
    best = (cuts.join(one, ["lang", "p1"]).join(two, ["lang", "p2"]).join(words, "lang").withColumn("score", exact)
            .groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
            .select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (few.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", share: float = SAMPLE, most_bits: int = MOST_BITS) -> DataFrame:
    """The first ``top`` phrases of two to five words of each language by their lowest-scoring cut.

    Returns lang, rank (from 1), phrase, a, l, r, n, score.  A null text holds no words; a null
    language counts as `und`.  Every row is a document of its own, repeated rows and ids too; ids only
    decide what is sampled.  Texts of any length are read whole.  An empty table, or one without a
    frequent phrase, gives an empty result; further columns are not read.  ``share`` is the sample's
    part of the documents and ``most_bits`` bounds a bitmap; both change the passes, not the result.
    """
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"),
                         F.xxhash64(F.col(id_col)).alias("i"))
    source = source.select("lang", F.xxhash64("lang").alias("salt"), "text", "i")
    sample = materialize(source.where(F.shiftrightunsigned("i", 32) < int(share * (1 << 32))).drop("i"), "sample")
    miner = Miner(source.drop("i"), least, most_bits)
    expected = share * least
    found, words = miner.frequent(sample, max(2, int(expected - SLACK * expected ** 0.5)))
    return scored(miner.named(found, sample), words, top)
