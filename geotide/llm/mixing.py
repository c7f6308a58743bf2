"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share over its natural share.  Each document draws its
number of copies by inverting the Poisson distribution at a hash-seeded uniform number, is exploded
by that count, and all copies are dealt out and ordered by a second hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotide.llm.shared import packed, text_or_empty, unpacked
from geotide.session import materialize

SEED = "mix-1"
#: Target share of a source is its natural share to this power, rescaled to sum 1.
TEMPERATURE = 0.5
#: Rows of the rate table up to which it is broadcast; beyond it is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over the seed and the parts."""
    return F.conv(F.substring(_digest(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _digest(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def poisson_cdf(mean: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... up to where what is left is below 2**-53."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.lit(0.0).alias("f"), F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("out"))

    def step(a, k):
        f = a["f"] + F.ln(k.cast("double"))
        p = a["p"] + F.exp(k * F.ln(mean) - mean - f)
        return F.struct(f.alias("f"), p.alias("p"), F.concat(a["out"], F.array(p)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["out"])


def repetition_rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None = None,
                     temperature: float = TEMPERATURE, budget: float = 1.0) -> DataFrame:
    """(source, size, rate): the mean number of copies of each source's documents.

    Size is characters, an empty text counting as one.  ``weights`` are target shares by source (a
    missing source has weight 0); without them the target is the natural share to ``temperature``.
    ``budget`` is the size of the mix over the size of the input.  Null is a source of its own.
    """
    size = F.greatest(F.char_length(text_or_empty(text_col)), F.lit(1)).cast("long")
    per = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        target = F.pow(F.col("size").cast("double"), F.lit(float(temperature)))
    else:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        target = F.coalesce(F.element_at(table, F.col("source")), F.lit(0.0))
    per = per.withColumn("target", target)
    per = materialize(per, "sizes")  # one row per source
    total = per.agg(F.sum("size").alias("size"), F.sum("target").alias("target")).first()
    scale = float(budget) * (total["size"] or 0) / (total["target"] or 1.0)
    return per.select("source", "size", (F.col("target") / F.col("size") * F.lit(scale)).alias("rate"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                columns: list[str] | None = None, weights: dict[str, float] | None = None,
                temperature: float = TEMPERATURE, budget: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every document as often as its draw says, dealt out and ordered by a hash.

    Returns ``columns`` of the input (all by default) and copy (from 1), n_copies, shuffle_key.  The
    draw depends on seed and id alone, so reruns agree; a null id draws as the word null, and rows
    with equal id draw alike.  A null source is a source, null text has size one.  Input columns
    named like an added one are replaced.  An empty table gives an empty table.
    """
    columns = docs.columns if columns is None else columns
    added = ["copy", "n_copies", "shuffle_key"]
    rates = repetition_rates(docs, source_col, text_col, weights, temperature, budget)
    cdf = rates.where("rate > 0").select(F.col("source").alias("rate_source"), poisson_cdf(F.col("rate")).alias("cdf"))
    if rates.count() <= BROADCAST_SOURCES:
        cdf = F.broadcast(cdf)
    i = F.col(id_col)
    rows = docs.select(packed(docs, columns).alias("r"), i.alias("i"), F.col(source_col).alias("s"), uniform(seed, i).alias("u"))
    drawn = (rows.join(cdf, F.col("s").eqNullSafe(F.col("rate_source")))
             .withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("n_copies > 0"))
    copies = drawn.select("r", "i", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    keyed = copies.select(*unpacked("r", columns, added), "copy", "n_copies",
                          F.substring(_digest(seed, F.col("i"), F.col("copy")), 1, 16).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
