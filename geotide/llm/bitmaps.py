"""Bitmaps of recurring hashes: a fixed number of bits, so false positives grow with the data and false negatives never occur."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64

#: Bits of a bitmap as a power of two (16 MB).
BITMAP_BITS = 27


def upper_half(h: np.ndarray) -> pa.Array:
    """The upper 32 bits: enough to count for a bitmap of fewer bits, and half of the shuffle."""
    return pa.array((h >> _U(32)).astype(np.int64))


def bitmap(counted: DataFrame) -> np.ndarray:
    """Bitmap of the upper halves ``m`` of hashes whose counts ``n`` add up to two or more."""
    often = counted.groupBy("m").agg(F.sum("n").alias("n")).where("n > 1")
    word = F.shiftrightunsigned("m", 32 - BITMAP_BITS + 6)
    bit = F.shiftrightunsigned("m", 32 - BITMAP_BITS).bitwiseAND(F.lit(63).cast("long")).cast("int")
    packed = (often.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b"))
              .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())  # 2**(BITMAP_BITS-6) rows at most
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=_U)
    out[packed["w"].to_numpy()] = packed["b"].to_numpy().view(_U)
    return out


def in_bitmap(bits: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the bitmap?"""
    at = m >> _U(64 - BITMAP_BITS)
    return (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
