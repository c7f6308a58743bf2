"""Helpers that several operators of this package share: row payloads, bounded Bloom filters, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotide.session import materialize

#: Bits of a Bloom filter as a power of two: the filter has 2**(bits-6) rows of 64 bits at most (4 MB at 24).
FILTER_BITS = 24


#: Bits of a filter for each row that it holds, and the most bits of one (32 MB): what is broadcast stays bounded.
BITS_EACH = 8
MOST_BITS = 28


def sized_bits(n: int, each: int = BITS_EACH, least: int = 16, most: int = MOST_BITS) -> int:
    """Bits, as a power of two, of a filter for ``n`` rows: ``each`` bits a row until the bound is reached."""
    return min(most, max(least, (max(n, 1) * each - 1).bit_length()))


#: Most bytes of an Arrow batch that a task hands to its Python worker.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(rows: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with bounded memory: batches of long texts hold fewer rows, and a worker that has ended its
    task hands what it freed back to the system.  Lowers the session's limit of a batch if that is larger."""
    conf = rows.sparkSession.conf
    now = conf.get(_BATCH_SETTING)
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(bounded, schema)


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_or_empty(column: str | Column) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def packed(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The input row as one struct, so that its column names cannot clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])


def unpacked(row: str, columns: list[str], added: list[str]) -> list[Column]:
    """The packed row's columns without those whose names the operator adds itself."""
    taken = {a.lower() for a in added}
    return [F.col(f"{row}.`{c}`").alias(c) for c in columns if c.lower() not in taken]


def filter_word(h: Column, bits: int = FILTER_BITS) -> Column:
    """The 64-bit word of the filter that a 64-bit hash falls into."""
    return h.bitwiseAND(F.lit((1 << (bits - 6)) - 1).cast("long"))


def filter_bits(h: Column) -> list[Column]:
    """The two bits inside that word."""
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63).cast("long")).cast("int") for s in (40, 52)]


def filter_mask(h: Column) -> Column:
    a, b = filter_bits(h)
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, a).bitwiseOR(F.call_function("shiftleft", one, b))


def bloom_filter(keys: DataFrame, h: Column, bits: int = FILTER_BITS) -> DataFrame:
    """Bloom filter of the hashes ``h`` as rows (bf_word, bf_bits): at most 2**(bits-6) rows."""
    return (keys.select(filter_word(h, bits).alias("bf_word"), filter_mask(h).alias("m"))
            .groupBy("bf_word").agg(F.bit_or("m").alias("bf_bits")))


def twice_filter(keys: DataFrame, h: Column, bits: int = FILTER_BITS) -> DataFrame:
    """Second-pass Bloom filter: only the bits that two or more rows have set."""
    a, b = filter_bits(h)
    one = F.lit(1).cast("long")
    return (keys.select(filter_word(h, bits).alias("bf_word"), F.explode(F.array_distinct(F.array(a, b))).alias("bit"))
            .groupBy("bf_word", "bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .groupBy("bf_word").agg(F.bit_or(F.call_function("shiftleft", one, F.col("bit"))).alias("bf_bits")))


def flagged(rows: DataFrame, h: Column, bloom: DataFrame, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """Add a boolean: may the row's hash be in the filter?  The broadcast side has 2**(bits-6) rows at most."""
    out = (rows.withColumn("bf_own", filter_mask(h)).withColumn("bf_word", filter_word(h, bits))
           .join(F.broadcast(bloom), "bf_word", "left"))
    hit = F.coalesce(F.col("bf_bits").bitwiseAND(F.col("bf_own")) == F.col("bf_own"), F.lit(False))
    return out.withColumn(name, hit).drop("bf_word", "bf_own", "bf_bits")


def only_ids(docs: DataFrame, id_col: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (one column): a Bloom filter keeps most others out of the shuffle."""
    key = ids.columns[0]
    rows = flagged(docs, F.xxhash64(F.col(id_col)), bloom_filter(ids, F.xxhash64(F.col(key)), bits), "bf_maybe", bits)
    wanted = ids.select(F.col(key).alias("bf_id")).distinct()
    return rows.where("bf_maybe").drop("bf_maybe").join(wanted, F.col(id_col) == F.col("bf_id"), "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v: long) as (node, component): the smallest node of each.

    Alternating large-star and small-star steps; every round is one written table in the shared
    checkpoint folder, and the loop ends when every node is the centre of its star, smaller than all
    its neighbours, or a leaf with that one neighbour.
    """
    e = (edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = materialize(e, "edges")
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        if near.where("m < u and n > 1").agg(F.count(F.lit(1))).first()[0] == 0:
            break
        low = near.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        e = materialize(small, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
