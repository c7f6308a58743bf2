"""Stored tables that grow and shrink in place (K1, K5, K6, K8).

Two layouts, both plain Parquet:

* ``DayTable``: rows lie by day and by bucket of the key, so that an insert reads the key columns of
  the days and buckets it touches and nothing else, a delete rewrites only the parts that hold a
  deleted row (dynamic partition overwrite), and retention drops whole days.
* ``BatchLog``: several tables that take one batch together.  A batch is written to folders of its
  own and counts once its mark is there, so a batch that failed half-way is invisible and one that
  comes again replaces itself or, once marked, adds nothing.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geotide.functions.timefn import ts_literal
from geotide.operators.latest import top_k_per_key
from geotide.operators.writes import (ASTAR_TARGET_TYPES, PREDICTION_TYPES, RETENTION_DAYS, ASTAR_CONTEXTS, MAPF_CONTEXTS,
                                      validate_rows)

DAY, BUCKET, BATCH = "part_day", "part_bucket", "part_batch"
#: Fixed value: how Spark names the folder of a null partition value.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table, whatever file system it lies on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class DayTable:
    """A keyed table stored by day of ``time`` and bucket of ``key``; ``time`` is one of the key columns.

    Without ``prefer`` the first writer of a key wins (K1).  With it, the row that is least by those
    columns wins, then by all others: such a rule does not depend on the order or number of inserts.
    A row that loses is not stored; one that beats a stored row is stored beside it, and ``rows``
    gives the winner.  Nulls are values of a key.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], time: str,
                 prefer: Sequence[str] | None = None, buckets: int = 4):
        if time not in key:
            raise ValueError("the column that gives the day must be part of the key")
        self.spark, self.path, self.schema, self.key, self.time = spark, path, schema, list(key), time
        self.prefer = None if prefer is None else [*prefer, *[c for c in schema.names if c not in (*prefer, *key)]]
        self.buckets = buckets
        self.stored = T.StructType([*schema.fields, T.StructField(DAY, T.DateType()), T.StructField(BUCKET, T.IntegerType())])
        spark.createDataFrame([], self.stored).write.mode("ignore").parquet(path)

    def _bucket(self, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(*[df[c].cast(self.schema[c].dataType) for c in self.key]), F.lit(self.buckets)).cast("int")

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names],
                         F.to_date(self.time).alias(DAY), self._bucket(df).alias(BUCKET))

    def parts(self, placed: DataFrame) -> Column:
        """The days and buckets that rows fall into, as a filter on partition columns: two short lists of literals."""
        found = placed.select(DAY, BUCKET).distinct().agg(F.collect_set(DAY), F.collect_set(BUCKET), F.count_if(F.col(DAY).isNull())).first()
        days, buckets, null = found
        day = F.col(DAY).isin([F.lit(d) for d in days]) if days else F.lit(False)
        return (day | F.col(DAY).isNull() if null else day) & F.col(BUCKET).isin(buckets or [-1])

    def raw(self) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self.path)

    def _winners(self, df: DataFrame) -> DataFrame:
        order = [F.col(c).asc_nulls_last() for c in (self.prefer or [c for c in self.schema.names if c not in self.key])]
        return top_k_per_key(df, self.key, order, 1, None)

    def rows(self, where: Column | None = None) -> DataFrame:
        """The table's rows; ``where`` may use the partition columns to read only some days."""
        df = self.raw() if where is None else self.raw().where(where)
        return (df if self.prefer is None else self._winners(df)).drop(DAY, BUCKET)

    def fresh(self, new: DataFrame) -> DataFrame:
        """Rows of ``new`` that an insert would store: winners of their key that beat what the touched parts hold."""
        placed = self._winners(self._placed(new))
        old = self.raw().where(self.parts(placed))
        held = old.select(*[F.col(c).alias(f"held_{c}") for c in [*self.key, *(self.prefer or [])]])
        same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in self.key]
        if self.prefer:
            rank = lambda p: F.struct(*[x for c in self.prefer for x in (F.col(p + c).isNull(), F.col(p + c))])
            same.append(rank("held_") <= rank(""))
        return placed.join(held, same, "left_anti")

    def insert(self, new: DataFrame) -> None:
        """K1: store what is new.  A repeated insert finds its rows and adds none."""
        self.fresh(new).repartition(DAY, BUCKET).write.mode("append").partitionBy(DAY, BUCKET).parquet(self.path)

    def _replace(self, hit: DataFrame, keep: Column | None, gone: DataFrame | None) -> None:
        """Rewrite the parts in ``hit`` without the rows that go; a part that has none left is removed."""
        parts = [(r[0], r[1]) for r in hit.select(DAY, BUCKET).distinct().collect()]  # days x buckets at most
        if not parts:
            return
        place = F.concat_ws("/", F.coalesce(F.col(DAY).cast("string"), F.lit(NO_DAY)), F.col(BUCKET))
        left = self.raw().where(place.isin([f"{day or NO_DAY}/{bucket}" for day, bucket in parts]))  # one flat list: partitions are pruned by it
        left = left.where(keep) if gone is None else left.join(gone, [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in self.key], "left_anti")
        full = {(r[0], r[1]) for r in left.select(DAY, BUCKET).distinct().collect()}
        left.repartition(DAY, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(DAY, BUCKET).parquet(self.path)
        for day, bucket in set(parts) - full:
            remove(self.spark, f"{self.path}/{DAY}={day or NO_DAY}/{BUCKET}={bucket}")

    def delete(self, keys: DataFrame) -> None:
        """K5: remove the rows with the listed keys; parts that hold none of them are not rewritten."""
        own = keys.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.key]).distinct()
        placed = own.select("*", F.to_date(self.time).alias(DAY), self._bucket(own).alias(BUCKET))
        gone = own.select(*[F.col(c).alias(f"gone_{c}") for c in self.key])
        hit = self.raw().where(self.parts(placed)).join(gone, [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in self.key], "left_semi")
        self._replace(hit, None, gone)

    def expire(self, as_of, days: int = RETENTION_DAYS) -> int:
        """K6: drop what is older than ``days`` and return how many rows that were (stored rows, before they compete).

        Whole days are removed; only the day of the cutoff is rewritten.  Rows without a time stay.
        """
        cutoff = as_of - _dt.timedelta(days=days)
        old = self.raw().where((F.col(DAY) <= F.lit(cutoff.date())) & (F.col(self.time) < ts_literal(cutoff)))
        n = old.count()
        last = F.col(DAY) == F.lit(cutoff.date())
        self._replace(old.where(last), F.col(self.time) >= ts_literal(cutoff), None)
        for (day,) in old.where(~last).select(DAY).distinct().collect():  # one row a day
            remove(self.spark, f"{self.path}/{DAY}={day}")
        return n


class BatchLog:
    """Tables below one folder that take each batch together and once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _marks(self) -> DataFrame:
        self.spark.createDataFrame([], f"{BATCH} string").write.mode("ignore").parquet(f"{self.path}/marks/none")
        return self.spark.read.schema(f"{BATCH} string").parquet(f"{self.path}/marks/*")

    def has(self, batch) -> bool:
        return not self._marks().where(F.col(BATCH) == str(batch)).isEmpty()

    def append(self, batch, tables: dict[str, DataFrame]) -> bool:
        """Write all tables' rows of a batch, then its mark; False if the batch is there already."""
        if self.has(batch):
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/tables/{name}/{BATCH}={batch}")
        mark = self.spark.createDataFrame([(str(batch),)], f"{BATCH} string").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{self.path}/marks/{uuid.uuid5(uuid.NAMESPACE_OID, str(batch)).hex}")
        return True

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """Rows of all marked batches."""
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/tables/{name}/{BATCH}=none")
        whole = T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])
        rows = self.spark.read.schema(whole).parquet(f"{self.path}/tables/{name}")
        return rows.join(self._marks().distinct(), BATCH, "left_semi").select(*schema.names)


# Required fields and allowed values of the six appended tables.
APPEND_RULES: dict[str, tuple[tuple[str, ...], dict[str, tuple[str, ...]]]] = {
    "astar_routes": (("client_id", "target_type", "origin_lat", "origin_lon", "destination_lat", "destination_lon", "path", "distance"),
                     {"target_type": ASTAR_TARGET_TYPES, "decision_context": ASTAR_CONTEXTS}),
    "mapf_routes": (("client_id", "destination_lat", "destination_lon"), {"decision_context": MAPF_CONTEXTS}),
    "reroutes": (("client_id", "destination_lat", "destination_lon"), {}),
    "weekly_schedule": (("client_id", "visit_day", "predicted_time"), {"prediction_type": PREDICTION_TYPES}),
    "pois": (("client_id", "lat", "lon", "time_spent", "poi_rank"), {}),
    "user_patterns": (("client_id", "lat", "lon"), {}),
}


def append_validated(log: BatchLog, batch, tables: dict[str, DataFrame]) -> bool:
    """K8: append rows that keep their table's rules, and the others to ``<table>_rejects`` with a reason.

    ``tables`` maps the names of ``APPEND_RULES`` to new rows.  All of them are one batch.
    """
    frames = {}
    for name, df in tables.items():
        required, allowed = APPEND_RULES[name]
        frames[name], frames[f"{name}_rejects"] = validate_rows(df, required, allowed)
    return log.append(batch, frames)
