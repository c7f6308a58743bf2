"""N-gram Jaccard join by vertical partitioning.

Every text is the set of its distinct word shingles.  Shingles have one global order, by rising
frequency class and then by hash, which is cut into fragments.  A pair of sets can reach the
threshold only if the two share one of their first shingles in that order; such pairs are opened
there, every fragment counts the overlap of its own segments, and the partial counts are summed per
pair.  First shingles that the same sets have open the same pairs, so the earliest stands for them all.  Texts with equal sets are one set; a first round opens only pairs with the smallest set of
each shingle, and the last one pairs sets that are still in different components, so a large group
of near copies costs about its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geotide.llm.bitmaps import bitmap, in_bitmap, upper_half
from geotide.llm.shared import components, give_back, in_arrow, only_ids
from geotide.llm.words import chunks, mix, sequences, words
from geotide.session import materialize

_U = np.uint64

#: Words of a shingle; links need numerator/denominator of Jaccard similarity.
SIZE = 3
THRESHOLD = (90, 100)
#: Fragments of the global order: one per frequency class beyond the rare ones, the rare ones cut by hash.
RARE_FRAGMENTS = 7
#: Buckets of the frequency sketch as a power of two (4 MB), and the text one local count covers.
SKETCH_BITS = 22
LOCAL_BYTES = 32 << 20
#: Counts up to this are one class: rare.
RARE = 8
#: Earlier shingles that a row of the last round brings along, to tell a pair that has met before.
EARLIER = 8


def shingle_hashes(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a chunk's documents in order, and each document's offset; a short text is one shingle."""
    w = words(data, at, lower=True)
    h, ok = sequences(w, size)
    for k in range(1, size):  # texts of k words: one shingle at their first word
        short = w.first[:-1][np.diff(w.first) == k]
        if len(short):
            part, _ = sequences(w, k)
            h[short] = mix(part[short] + _U(k))
            ok[short] = True
    return h[ok], np.concatenate([[0], np.cumsum(ok)])[w.first]


def _sketch(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int32)

    def add(hashes: list[np.ndarray]) -> None:
        u, n = np.unique(np.concatenate(hashes), return_counts=True)
        many = n > 1
        np.add.at(total, (u[many] >> _U(64 - SKETCH_BITS)).astype(np.int64), n[many])

    local, seen = [], 0
    for batch in batches:
        for _, _, data, at in chunks(batch.column(0)):
            local.append(shingle_hashes(data, at, size)[0])
            seen += len(data)
            if seen > LOCAL_BYTES:
                add(local)
                local, seen = [], 0
    if local:
        add(local)
    hit = np.flatnonzero(total > 2)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit].astype(np.int64))], names=["bucket", "n"])


def frequency_classes(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Frequency class of each sketch bucket: 0 is rare, then one class per doubling.

    The sketch adds up, over pieces of the corpus, shingles that repeat within a piece.  Its size is
    fixed; it decides only the order of shingles, never which pairs are found.
    """
    rows = in_arrow(docs.select(F.col(text_col).alias("text")), lambda b: _sketch(size, b), "bucket long, n long")
    counts = rows.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > RARE).toArrow()  # 2**SKETCH_BITS rows at most
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    out[counts["bucket"].to_numpy()] = np.minimum(31, np.log2(counts["n"].to_numpy() / RARE).astype(int) + 1)
    return out


def _ordered(classes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the global order: the class in the top 5 bits, then 59 bits of the hash."""
    return (classes[(h >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(_U) << _U(59)) | (mix(h) >> _U(5))


def _set_id(s: np.ndarray) -> tuple[int, int]:
    one, two = mix(s).sum(dtype=_U), mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _list(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, _U)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _sets(batch: pa.RecordBatch, size: int, classes: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    ids = batch.column(0).to_pylist()
    for lo, _, data, at in chunks(batch.column(1)):
        h, first = shingle_hashes(data, at, size)
        order = _ordered(classes, h)
        for k in range(len(first) - 1):
            yield ids[lo + k], np.unique(order[first[k]:first[k + 1]])


def _prefix(s: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """First shingles of a set: a set that reaches the threshold with it shares one of them."""
    num, den = threshold
    return s[:len(s) - -(-num * len(s) // den) + 1]


def recurring_shingles(rows: DataFrame, size: int, classes, threshold: tuple[int, int]) -> np.ndarray:
    """Bitmap of the first shingles that two rows or more have: the others open no pair."""

    def run(batches):
        for batch in batches:
            first = [_prefix(s, threshold) for _, s in _sets(batch, size, classes.value)]
            u, n = np.unique(mix(np.concatenate(first)) if first else np.zeros(0, _U), return_counts=True)
            yield pa.RecordBatch.from_arrays([upper_half(u), pa.array(np.minimum(n, 2))], names=["m", "n"])

    return bitmap(in_arrow(rows, run, "m long, n long"))


def shingle_sets(rows: DataFrame, size: int, classes, recurring, threshold: tuple[int, int]) -> DataFrame:
    """(id, s1, s2, n, place, prefix): each document's set as a 128-bit name, its size, and its recurring first shingles with their places."""

    def run(batches):
        for batch in batches:
            ids, one, two, n, place, prefix = [], [], [], [], [], []
            for i, s in _sets(batch, size, classes.value):
                a, b = _set_id(s)
                first = _prefix(s, threshold)
                at = np.flatnonzero(in_bitmap(recurring.value, mix(first)))
                ids.append(i)
                one.append(a)
                two.append(b)
                n.append(len(s))
                place.append(at.astype(_U))
                prefix.append(first[at])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                                              pa.array(n, pa.int64()), _list(place), _list(prefix)], names=["id", "s1", "s2", "n", "place", "prefix"])

    return in_arrow(rows, run, "id long, s1 long, s2 long, n long, place array<long>, prefix array<long>")


def segments(docs: DataFrame, size: int, classes) -> DataFrame:
    """(id, s1, f, seg): every document's shingles cut by fragments of the global order."""
    rare = np.arange(1, RARE_FRAGMENTS, dtype=np.uint64) * _U((1 << 59) // RARE_FRAGMENTS)
    cuts = np.append(rare, np.arange(1, 32, dtype=np.uint64) << _U(59))

    def run(batches):
        for batch in batches:
            ids, one, f, seg = [], [], [], []
            for i, s in _sets(batch, size, classes.value):
                a, _ = _set_id(s)
                at = np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])
                for k in np.flatnonzero(np.diff(at)):
                    ids.append(i)
                    one.append(a)
                    f.append(int(k))
                    seg.append(s[at[k]:at[k + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(one, pa.int64()), pa.array(f, pa.int32()), _list(seg)],
                                             names=["id", "s1", "f", "seg"])

    # repeated rows of a document would be counted twice
    return in_arrow(docs, run, "id long, s1 long, f int, seg array<long>").dropDuplicates(["id", "s1", "f"])


def overlaps(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, classes) -> DataFrame:
    """Sum over fragments of the partial overlaps of each pair (a, as1, an, b, bs1, bn), as column ``common``."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = only_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", ids)
    seg = segments(texts, size, classes)
    of_a = seg.select(F.col("id").alias("a"), F.col("s1").alias("as1"), "f", F.col("seg").alias("a_seg"))
    of_b = seg.select(F.col("id").alias("b"), F.col("s1").alias("bs1"), "f", F.col("seg").alias("b_seg"))
    # a pair meets the fragments that its first set has, and of them those that its second one has too
    part = pairs.join(of_a, ["a", "as1"]).join(of_b, ["b", "bs1", "f"])
    return (part.select("a", "as1", "an", "b", "bs1", "bn", F.size(F.array_intersect("a_seg", "b_seg")).cast("long").alias("part"))
            .groupBy("a", "as1", "an", "b", "bs1", "bn").agg(F.sum("part").alias("common")))


def earliest_shared(tokens: DataFrame) -> DataFrame:
    """(t, c, q): of the shingles of ``tokens`` (id, s1, n, i, t) that the same two or more sets have, the earliest in the
    order, its first set and how many they are.

    Two sets' first common shingle is always such an earliest one.  Equal lists of sets have equal counts, sums and
    exclusive ors of 128 bits of hashes; a set that comes twice counts twice in each of its lists.
    """
    h = F.xxhash64("s1", "id")
    low = F.lit((1 << 32) - 1).cast("long")
    lists = tokens.groupBy("t").agg(
        F.min(F.struct("id", "s1", "n", "i")).alias("c"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("id", "s1")).alias("w"),
        F.sum(h.bitwiseAND(low)).alias("v1"), F.sum(F.shiftrightunsigned(h, 32)).alias("v2")).where("k > 1")
    # the first set is the same in all of them, so the least c has the earliest place
    return (lists.groupBy("k", "w", "v1", "v2").agg(F.min(F.struct("c", "t")).alias("e"), F.count(F.lit(1)).alias("q"))
            .select("e.t", "e.c", "q"))


def linked(counted: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    num, den = threshold
    return counted.where(den * F.col("common") >= num * (F.col("an") + F.col("bn") - F.col("common")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                       threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Null and empty texts have no shingles and link with nothing.  A null id is returned with a null
    component and links nothing.  Rows that repeat an id are one node: links of any of their texts are
    its links.  Other columns are ignored; an empty table gives an empty table.
    """
    num, den = threshold
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs, text_col, size))  # 2**SKETCH_BITS bytes
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    recurring = spark.sparkContext.broadcast(recurring_shingles(rows, size, classes, threshold))  # 2**BITMAP_BITS bits
    give_back()
    sets = materialize(shingle_sets(rows, size, classes, recurring, threshold), "sets")
    recurring.destroy()  # the sets are written
    named = sets.where("n > 0 and id is not null")
    groups = named.groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    copies = named.select("id", "s1", "s2").join(groups, ["s1", "s2"]).where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    reps = named.join(groups.withColumnRenamed("rep", "id"), ["s1", "s2", "id"], "left_semi")
    tokens = (reps.select("id", "s1", "n", F.explode(F.arrays_zip("place", "prefix")).alias("e"))
              .select("id", "s1", "n", F.col("e.place").cast("int").alias("i"), F.col("e.prefix").alias("t")))
    shared = materialize(tokens.join(earliest_shared(tokens), "t").select("t", "i", "id", "s1", "n", "c", "q"), "shared")

    def least(x, y):  # common shingles that a pair of these sizes needs
        return F.ceil(F.lit(num) * (x + y) / F.lit(num + den)).cast("long")

    def meet(x, y):  # may this shingle be the pair's first common one, by sizes and places in the order?
        n, i, m, j = F.col(f"{x}.n"), F.col(f"{x}.i"), F.col(f"{y}.n"), F.col(f"{y}.i")
        return (den * F.least(n, m) >= num * F.greatest(n, m)) & (i <= n - least(n, m)) & (j <= m - least(n, m))

    def pair(x, y):
        return [F.col(f"{v}.{c}").alias(w) for v, ws in ((x, ("a", "as1", "an")), (y, ("b", "bs1", "bn")))
                for c, w in zip(("id", "s1", "n"), ws)]

    def spare(n, m):  # common first shingles that a pair which reaches the threshold must have
        return F.least(*[least(n, m) - F.ceil(F.lit(num) * x / F.lit(den)).cast("long") + 1 for x in (n, m)])

    def likely(pairs):
        """Pairs with as many common first shingles as those that reach the threshold must have."""
        pairs = materialize(pairs, "likely")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        of = only_ids(sets.select("id", "s1", "prefix"), "id", ids).dropDuplicates(["id", "s1"])
        both = (pairs.join(of.select(F.col("id").alias("a"), F.col("s1").alias("as1"), F.col("prefix").alias("ap")), ["a", "as1"])
                .join(of.select(F.col("id").alias("b"), F.col("s1").alias("bs1"), F.col("prefix").alias("bp")), ["b", "bs1"]))
        return both.where(F.size(F.array_intersect("ap", "bp")) >= spare(F.col("an"), F.col("bn"))).select(pairs.columns)

    first = shared.select(F.struct("t", "i", "id", "s1", "n").alias("x"), F.col("c").alias("y"))
    first = first.where((F.col("x.id") != F.col("y.id")) | (F.col("x.s1") != F.col("y.s1"))).where(meet("x", "y"))
    first = likely(first.select(*pair("y", "x")).distinct())
    first = materialize(first, "pairs")
    close = materialize(linked(overlaps(first, docs, id_col, text_col, size, classes), threshold).select("a", "b"), "links")
    label = components(close.select(F.col("a").alias("u"), F.col("b").alias("v")).union(copies))
    known = shared.drop("c").join(label, F.col("id") == F.col("node"), "left").select(
        "t", "i", "id", "s1", "n", "q", F.coalesce("component", "id").alias("l"))
    mixed = known.groupBy("t").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo < hi").select("t")
    # r: a set's first shingles from this one on that other components have too; from its first common one on, a pair has no others
    rest = Window.partitionBy("id", "s1").orderBy(F.desc("i"))
    known = known.join(mixed, "t", "left_semi").withColumn("r", F.sum("q").over(rest))
    # b: the ones just before it; a pair that shares one of them has met there, since all other conditions hold earlier too
    known = materialize(known.withColumn("b", F.collect_list("t").over(rest.rowsBetween(1, EARLIER))), "mixed")
    # of a pair the smaller set (the smaller id of equal sizes) has the shingle among its very first
    x, y = known.alias("x"), known.where(F.col("i") <= F.col("n") - least(F.col("n"), F.col("n"))).alias("y")
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.id") < F.col("x.id")))
    enough = F.least("x.r", "y.r") >= spare(F.col("x.n"), F.col("y.n"))
    fresh = ~F.arrays_overlap("x.b", "y.b")
    later = (x.join(y, F.col("x.t") == F.col("y.t")).where((F.col("x.l") != F.col("y.l")) & smaller & meet("x", "y") & enough & fresh)
             .select(*pair("y", "x"), F.col("y.l").alias("al"), F.col("x.l").alias("bl")).distinct())
    key = ["a", "as1", "b", "bs1"]
    # a pair of the first round that failed may come again either way round
    tried = first.select(*key).union(first.select(F.col("b"), F.col("bs1"), F.col("a"), F.col("as1")))
    later = materialize(likely(later.join(tried, key, "left_anti")), "pairs")
    more = linked(overlaps(later.drop("al", "bl"), docs, id_col, text_col, size, classes), threshold).select(*key)
    joined = components(later.join(more, key).select(F.col("al").alias("u"), F.col("bl").alias("v")))
    classes.destroy()  # all that reads texts is written
    final = (label.join(joined.select(F.col("node").alias("j"), F.col("component").alias("c2")), F.col("component") == F.col("j"), "left")
             .select("node", F.coalesce("c2", "component").alias("component")))
    alone = joined.join(label.select(F.col("node").alias("k")), F.col("node") == F.col("k"), "left_anti").select("node", "component")
    final = final.union(alone)
    return sets.join(final, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
