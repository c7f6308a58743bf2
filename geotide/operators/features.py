"""Model-feature preparation.

The reference trains and scores a sequence model; we build its *data* on
Spark: harmonised training vectors, standardisation, fixed-length history
windows and padded per-client sequences, plus a Pandas-UDF hook for scoring.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotide.functions.timefn import lenient_ts
from geotide.operators.latest import top_k_per_key
from geotide.session import materialize

# Activity synonym sets (one-hot order walk, vehicle, stationary, unknown).
ACT_WALK = ("walk", "walking", "foot")
ACT_VEHICLE = ("vehicle", "bus", "tram", "train", "car", "bike")
ACT_STATIONARY = ("stationary", "idle", "stop")
FEATURES = ["hour", "speed", "elevation", "act_walk", "act_vehicle", "act_stationary", "act_unknown", "lat", "lon"]
TIME_STEPS = 60


def activity_one_hot(activity) -> list[Column]:
    """four 0/1 ints from the lower-cased, trimmed activity text."""
    a = F.lower(F.trim(F.coalesce(F.col(activity) if isinstance(activity, str) else activity, F.lit(""))))
    w, v, s = a.isin(*ACT_WALK), a.isin(*ACT_VEHICLE), a.isin(*ACT_STATIONARY)
    return [w.cast("int").alias("act_walk"), (~w & v).cast("int").alias("act_vehicle"),
            (~w & ~v & s).cast("int").alias("act_stationary"), (~w & ~v & ~s).cast("int").alias("act_unknown")]


def _placeholder(df: DataFrame, lat: str, lon: str, ts: Column, rank: int) -> DataFrame:
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"),
        (F.coalesce(F.hour(ts), F.lit(0)) / F.lit(23.0)).alias("hour"), ts.alias("timestamp"),
        F.lit(rank).alias("source_rank"))


def training_vectors(patterns: DataFrame, pois: DataFrame, predicted: DataFrame, astar: DataFrame, mapf: DataFrame,
                     stops: DataFrame, vehicle_arrivals: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Seven sources harmonised to FEATURES + timestamp: patterns, POIs (by visit start), predicted
    visits, route origins and destinations (U5), stops (without a time, so never kept), vehicle
    positions and trajectory points.

    Rows without a position or a time are dropped.  Of equal (lat, lon, hour) the earliest stays, then the
    first source in this order, then the least features.  Only trajectory points have speed, elevation
    and activity; those whose speed or elevation is null are skipped.
    """
    from geotide.operators.setops import od_vectors
    none = F.lit(None).cast("timestamp_ntz")
    sources = [(patterns, "lat", "lon", F.col("timestamp")), (pois, "lat", "lon", F.col("visit_start")),
               (predicted, "predicted_lat", "predicted_lon", F.col("predicted_visit_time")),
               (od_vectors(astar, mapf), "lat", "lon", F.col("timestamp")), (stops, "stop_lat", "stop_lon", none),
               (vehicle_arrivals, "position_lat", "position_lon", F.col("timestamp"))]
    p = trajectories.select(F.explode("trajectory").alias("p"))
    p = p.where(F.col("p.lat").isNotNull() & F.col("p.lon").isNotNull() & F.col("p.speed").isNotNull()
                & F.col("p.elevation").isNotNull())
    ts = lenient_ts(F.col("p.timestamp"))
    u = p.select(F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"),
                 (F.coalesce(F.hour(ts), F.lit(0)) / F.lit(23.0)).alias("hour"),
                 F.col("p.speed").alias("speed"), F.col("p.elevation").alias("elevation"),
                 *activity_one_hot(F.col("p.activity")), ts.alias("timestamp"), F.lit(len(sources)).alias("source_rank"))
    # of a source without features only the earliest row counts: times alone are aggregated in place, where
    # whole rows would be sorted by every task that reads the source
    places = reduce(DataFrame.unionByName, [_placeholder(df, lat, lon, time, rank) for rank, (df, lat, lon, time) in enumerate(sources)])
    places = places.where(F.col("timestamp").isNotNull()).groupBy("lat", "lon", "hour", "source_rank").agg(F.min("timestamp").alias("timestamp"))
    u = u.unionByName(places.select(
        "lat", "lon", "hour", F.lit(0.0).alias("speed"), F.lit(0.0).alias("elevation"), F.lit(0).alias("act_walk"), F.lit(0).alias("act_vehicle"),
        F.lit(0).alias("act_stationary"), F.lit(1).alias("act_unknown"), "timestamp", "source_rank"))
    rest = [c for c in FEATURES if c not in ("lat", "lon", "hour")]
    g = u.where(F.col("timestamp").isNotNull()).groupBy("lat", "lon", "hour") \
        .agg(F.min(F.struct("timestamp", "source_rank", *rest)).alias("__m"))
    return g.select("lat", "lon", "hour", *[F.col(f"__m.{c}").alias(c) for c in rest], F.col("__m.timestamp").alias("timestamp"))


def feature_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of mean and population std per feature (std 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    stats = df.agg(*aggs)
    return stats.select(*[x for c in cols for x in (
        F.col(f"{c}_mean"), F.when(F.col(f"{c}_std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_std")).alias(f"{c}_std"))])


def key_scaler(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """G13 per key: one row per key with mean and population std of each feature (std 0 -> 1)."""
    aggs = [x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))]
    fixed = {f"{c}_std": F.when(F.col(f"{c}_std") == 0, F.lit(1.0)).otherwise(F.col(f"{c}_std")) for c in cols}
    return df.groupBy(key).agg(*aggs).withColumns(fixed)


def standardise(df: DataFrame, stats: DataFrame, cols: Sequence[str], inverse: bool = False) -> DataFrame:
    """Scale (or unscale) ``cols`` with a one-row ``stats`` frame (broadcast: exactly one row)."""
    j = df.withColumn("__k", F.lit(0)).join(F.broadcast(stats.withColumn("__k", F.lit(0))), "__k").drop("__k")
    for c in cols:
        m, s = F.col(f"{c}_mean"), F.col(f"{c}_std")
        j = j.withColumn(c, F.col(c) * s + m if inverse else (F.col(c) - m) / s)
    return j.drop(*[f"{c}_{x}" for c in cols for x in ("mean", "std")])


#: A total order of the training vectors: no two have the same position and hour.
SEQUENCE_ORDER = ("timestamp", "lat", "lon", "hour")


def sequence_windows(df: DataFrame, order: Sequence[str] = SEQUENCE_ORDER, features: Sequence[str] = tuple(FEATURES),
                     steps: int = TIME_STEPS, block: int = 4096) -> DataFrame:
    """For each row after the first ``steps`` (global order), the previous ``steps`` feature rows
    and the row's (lat, lon) label.

    ``order`` must tell all rows apart, or those that it does not fall in any order.  Distributed
    without a single global window: a contiguous row index comes
    from a range sort plus per-partition offsets (one small count per
    partition); rows are grouped into blocks of ``block`` indices and each
    block also receives the ``steps`` rows before it (halo), so every group is
    bounded by ``block + steps`` rows and cut into windows by numpy.
    """
    feats, by = list(features), [f"__o{k}" for k in range(len(order))]
    s = df.select(*feats, *[F.col(c).alias(o) for c, o in zip(order, by)]).repartitionByRange(*by).sortWithinPartitions(*by)
    s = s.withColumn("__pid", F.spark_partition_id())
    s = s.withColumn("__lrn", F.row_number().over(Window.partitionBy("__pid").orderBy(*by)) - 1)
    s = materialize(s, "seqidx")  # fixes the partition ids both uses below see
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offs = counts.withColumn("__off", F.coalesce(F.sum("__n").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__pid", "__off")
    # ``offs`` has one row per partition (a fixed, small bound): broadcast.
    idx = s.join(F.broadcast(offs), "__pid").withColumn("__idx", F.col("__off") + F.col("__lrn")).select("__idx", *feats)
    own = idx.withColumn("__blk", F.floor(F.col("__idx") / block))
    halo = idx.where((F.col("__idx") % block) >= block - steps) \
        .withColumn("__blk", F.floor(F.col("__idx") / block) + 1)
    groups = own.unionByName(halo)
    out_schema = T.StructType([T.StructField("idx", T.LongType()),
                               T.StructField("window", T.ArrayType(T.ArrayType(T.DoubleType()))),
                               T.StructField("label_lat", T.DoubleType()),
                               T.StructField("label_lon", T.DoubleType())])
    li, lo = feats.index("lat"), feats.index("lon")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__idx")
        ix, mat = pdf["__idx"].to_numpy(), pdf[feats].to_numpy(dtype=float)
        at = np.arange(steps, len(pdf))
        at = at[ix[at] // block == int(pdf["__blk"].iloc[0])]
        if not len(at):
            return pd.DataFrame({"idx": ix[at], "window": pd.Series([], dtype=object), "label_lat": mat[at, li], "label_lon": mat[at, lo]})
        windows = np.lib.stride_tricks.sliding_window_view(mat, steps, axis=0).transpose(0, 2, 1)[at - steps]
        return pd.DataFrame({"idx": ix[at], "window": windows.tolist(), "label_lat": mat[at, li], "label_lon": mat[at, lo]})

    return groups.groupBy("__blk").applyInPandas(build, out_schema)


def sequence_pad(df: DataFrame, key: str = "client_id", order: str = "timestamp",
                 features: Sequence[str] = tuple(FEATURES), steps: int = TIME_STEPS) -> DataFrame:
    """Per key the last ``steps`` feature rows in time order (equal times by their features), left-padded
    with the earliest of them."""
    last = top_k_per_key(df, [key], [F.col(order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in features]], steps, "__r")
    g = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("__t"),
                                                                   *[F.col(c) for c in features]))).alias("__s"))
    vec = F.transform("__s", lambda r: F.array(*[r[c].cast("double") for c in features]))
    return g.select(key, F.concat(F.array_repeat(F.element_at(vec, 1), F.lit(steps) - F.size(vec)), vec)
                    .alias("sequence"))


def rounded_text(vectors, digits: int = 6):
    """Rows of numbers as text, in units of the last digit, for comparison: '1,2;3,4'."""
    unit = F.lit(float(10 ** digits))
    return F.array_join(F.transform(vectors, lambda row: F.array_join(F.transform(row, lambda x: F.round(x * unit).cast("long").cast("string")), ",")), ";")


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """V1: apply a user scorer (pandas in, pandas out) batch-wise over Arrow (``mapInPandas``).

    A scorer returning a single score column ``s`` is read as (1 - s, s).
    """
    def run(it):
        for pdf in it:
            out = scorer(pdf)
            if "s" in out.columns and "score_mapf" not in out.columns:
                out = out.assign(score_astar=1.0 - out["s"], score_mapf=out["s"]).drop(columns=["s"])
            yield out

    return df.mapInPandas(run, schema)


__all__ = ["activity_one_hot", "training_vectors", "feature_scaler", "key_scaler", "standardise", "rounded_text", "sequence_windows",
           "sequence_pad", "score_with", "np"]
