"""Token counts as delta-maintained rollups.

A batch of changes is tokenised once and becomes signed rows: plus for inserted or revised documents,
minus for what the journal says they counted before.  The batch also stores the sums of its signed
rows by source, language and tokenizer version, and totals add up these few rows: neither totals nor a later batch
aggregate the history again.  A batch is written to a folder of its own and counts only once its
id is in the commit table, so a batch that is delivered again, or that failed half-way, adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotide.llm.shared import bloom_filter, flagged, sized_bits
from geotide.llm.tokens import encoder_of
from geotide.session import checkpoint_dir, materialize

JOURNAL = "doc_id long, source string, lang string, version string, tokens long, sign int"
DELTAS = "source string, lang string, version string, docs long, tokens long"
COMMITS = "batch_id string, seq long, folder string, base boolean"


def _tokenise(version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(version)
        for batch in batches:
            n = [None if t.as_py() is None else len(encode(t.as_py())) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    return run


def _maybe(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be among ``ids`` (one column doc_id); the filter has eight bits an id, up to its bound."""
    bits = sized_bits(ids.count())
    h = F.xxhash64("doc_id")
    return flagged(rows, h, bloom_filter(ids, h, bits), "bf_maybe", bits).where("bf_maybe").drop("bf_maybe")


class TokenRollup:
    """Journal of signed rows, sums of each batch and table of commits in a folder that driver and executors share.

    Batches that touch the same documents are applied one after another.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}"
        spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{self.path}/commits")

    def _commits(self) -> list[tuple[str, int, str, bool]]:
        """Committed batches in order: of writers of one batch the first commit counts."""
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        rows = rows.groupBy("batch_id").agg(F.min(F.struct("seq", "folder", "base")).alias("c"))
        return sorted(((r["batch_id"], r["c"]["seq"], r["c"]["folder"], r["c"]["base"]) for r in rows.collect()), key=lambda c: (c[1], c[3]))

    def _read(self, part: str, schema: str) -> DataFrame:
        """One part of the newest base and of all batches after it."""
        commits = self._commits()
        base = max((k for k, c in enumerate(commits) if c[3]), default=0)
        folders = [f"{c[2]}/{part}" for c in commits[base:]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def journal(self) -> DataFrame:
        """Signed rows of all committed batches."""
        return self._read("rows", JOURNAL)

    def _commit(self, batch_id: str, seq: int, signed: DataFrame, base: bool) -> None:
        folder = f"{self.path}/batch-{uuid.uuid4().hex}"
        signed.write.parquet(f"{folder}/rows")
        written = self.spark.read.schema(JOURNAL).parquet(f"{folder}/rows")
        sums = written.groupBy("source", "lang", "version").agg(
            F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))
        sums.coalesce(1).write.parquet(f"{folder}/deltas")
        self.spark.createDataFrame([(batch_id, seq, folder, base)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def apply(self, batch_id: str, changes: DataFrame, version: str, only: DataFrame | None = None) -> bool:
        """Commit a batch of changes (doc_id, op, text, source, lang); False if it was committed before.

        ``op`` is upsert or delete.  A document that exists is revised: its old counts leave their group
        and the new ones join theirs.  Of several changes of one id in a batch the largest by (op,
        tokens, source, lang) counts.  A null text has no tokens; null source or lang are groups of
        their own; rows with a null id are inserts that nothing can revise.  Long texts are counted whole.
        ``only`` (a column doc_id) restricts the changes to these ids: a filter keeps most other texts from the
        tokenizer, and the ids meet after it, so that no text is shuffled.
        """
        commits = self._commits()
        if any(c[0] == batch_id for c in commits):
            return False
        seq = max([c[1] for c in commits], default=0) + 1
        rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("op").alias("op"),
                              F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                              F.when(F.col("op") == "upsert", F.coalesce("text", F.lit(""))).alias("text"))
        if only is not None:
            only = materialize(only.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "only")
            rows = _maybe(rows, only)
            rows = rows.select("doc_id", "op", "source", "lang", "text")
        counted = materialize(rows.mapInArrow(_tokenise(version), "doc_id long, op string, source string, lang string, tokens long"), "counted")
        if only is not None:
            counted = counted.join(only, "doc_id", "left_semi")
        last = (counted.where("doc_id is not null").groupBy("doc_id")
                .agg(F.max(F.struct("op", "tokens", "source", "lang")).alias("c")).select("doc_id", "c.*"))
        plain = counted.where("doc_id is null and op = 'upsert'").select("doc_id", "op", "tokens", "source", "lang")
        new = (last.where("op = 'upsert'").unionByName(plain)
               .select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens", F.lit(1).alias("sign")))
        signed = new if not commits else new.unionByName(self._taken_back(last.select("doc_id")))
        self._commit(batch_id, seq, signed, False)
        return True

    def _taken_back(self, ids: DataFrame) -> DataFrame:
        """Minus rows of what the given documents count now; other rows of the journal are not shuffled."""
        ids = materialize(ids, "ids")
        own = _maybe(self.journal().where("doc_id is not null"), ids)
        group = ["doc_id", "source", "lang", "version", "tokens"]
        live = own.groupBy(*group).agg(F.sum("sign").alias("n")).where("n > 0")
        return live.join(ids, "doc_id", "left_semi").select(*group, F.lit(-1).alias("sign"))

    def compact(self) -> None:
        """Fold all batches into one, so that later batches read what is live instead of the history.

        Batch ids stay known; their folders are no longer read."""
        commits = self._commits()
        if not commits:
            return
        group = ["doc_id", "source", "lang", "version", "tokens"]
        named = self.journal().where("doc_id is not null").groupBy(*group).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
        plain = self.journal().where("doc_id is null")
        self._commit(f"base {uuid.uuid4().hex}", commits[-1][1], plain.unionByName(named), True)

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of all that is live; groups that came to nothing are gone."""
        summed = self._read("deltas", DELTAS).groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 or tokens <> 0")


def corpus_rollup(docs: DataFrame, labels: DataFrame, version: str = "byte_bpe_50k", newer: str | None = None) -> DataFrame:
    """Totals of a corpus after three batches: all documents come in, documents labelled toxic are
    deleted, and documents labelled low quality are revised (line ends become spaces) and, with ``newer``, counted by that
    tokenizer version from then on; the first two batches are delivered twice, which changes nothing.

    Null and repeated ids, null texts, sources and languages are as ``TokenRollup.apply`` says; empty
    tables give empty totals; further columns are not read.
    """
    roll = TokenRollup(docs.sparkSession)
    loads = docs.select("doc_id", F.lit("upsert").alias("op"), "text", "source", "lang")
    per_id = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    none = F.lit(None).cast("string")
    deletes = per_id.where("toxic = 1").select("doc_id", F.lit("delete").alias("op"), none.alias("text"), none.alias("source"), none.alias("lang"))
    low = per_id.where("quality = 0 and coalesce(toxic, 0) = 0").select("doc_id")
    flat = loads.withColumn("text", F.translate("text", "\n", " "))
    for batch_id, changes, by, only in (("load", loads, version, None), ("load", loads, version, None), ("toxic", deletes, version, None),
                                        ("flat", flat, newer or version, low), ("toxic", deletes, version, None)):
        roll.apply(batch_id, changes, by, only)
    return roll.totals()
