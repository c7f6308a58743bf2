"""Exact deduplication by two-pass Bloom filtering.

Pass one sets two bits of a bounded Bloom filter per text hash and keeps the bits that several rows
set: a hash that occurs twice always finds all its bits there.  Pass two sends the rows whose bits
are all in that second filter through a shuffle by hash; every other row is certainly unique and
passes straight through.  False positives only shuffle in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotide.llm.shared import FILTER_BITS, flagged, packed, text_or_empty, twice_filter, unpacked
from geotide.session import materialize

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space becomes one space; single spaces are no match, as they stay anyway."""
    return F.regexp_replace(text_or_empty(text), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                columns: list[str] | None = None, bits: int = FILTER_BITS) -> DataFrame:
    """Mark which row of equal texts stays: the one with the smallest id.

    Returns ``columns`` of every input row (all by default) and keep_id, group_size, kept, text_sha256.
    Null text counts as empty.  A null id is larger than all others.  Of repeated rows with the same
    smallest id exactly one is kept.  Input columns named like an added one are replaced.  An empty
    table gives an empty table.  ``bits`` sizes the filter (2**bits bits); it changes only how many
    unique rows shuffle in vain.
    """
    columns = docs.columns if columns is None else columns
    rows = docs.select(packed(docs, columns).alias("r"), F.col(id_col).cast("long").alias("i"),
                       F.sha2(normalised(text_col), 256).alias("s"))
    h = F.xxhash64("s")
    twice = twice_filter(rows, h, bits)
    marked = flagged(rows, h, twice, "maybe", bits)
    single = marked.where(~F.col("maybe")).select(
        "r", F.col("i").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "s")
    # written once, so that the row number that breaks ties is the same for every later reader
    rest = materialize(marked.where("maybe").select("r", "i", "s", F.monotonically_increasing_id().alias("uid")), "maybe")
    groups = rest.groupBy("s").agg(F.min(F.struct(F.col("i").isNull().alias("n"), "i", "uid")).alias("w"),
                                   F.count(F.lit(1)).alias("group_size"))
    resolved = rest.join(groups, "s").select(
        "r", F.col("w.i").alias("keep_id"), "group_size", (F.col("uid") == F.col("w.uid")).alias("kept"), "s")
    out = single.unionByName(resolved)
    return out.select(*unpacked("r", columns, ADDED), "keep_id", "group_size", "kept", F.col("s").alias("text_sha256"))
