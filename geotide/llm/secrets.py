"""Secret scans over an incremental blob ledger.

Every text is content-addressed by its SHA-256.  The ledger, a table in a shared folder, records per
blob which rule versions have scanned it and what they found.  A scan reads only blobs with unseen
(blob, rule version) pairs, one copy each, and findings join back to all rows that hold the blob.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geotide.llm.shared import packed, text_or_empty, unpacked
from geotide.session import checkpoint_dir

SPAN = "array<struct<start:int,`end`:int,kind:string,rule:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and how long a group of a match has to be."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: Base kinds in listed order.  Longest runs of a class, so a minimum length inside the pattern drops the same matches.
BASE_RULES = (
    Rule("assign", 1, f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)

#: Kinds that the method adds.
ADDED_RULES = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", 1, "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
)
ALL_RULES = BASE_RULES + ADDED_RULES


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule as (start, end, kind, rule key), in code points, end exclusive.

    The matches and the pieces between them alternate, so running lengths give the positions.
    """
    pattern = F.lit(rule.pattern)
    pairs = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a, x):
        begin = a["at"] + F.char_length(x["gap"])
        end = begin + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        size = F.char_length(F.regexp_extract(x["hit"], rule.pattern, rule.group)) if rule.group else end - begin
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"))
        keep = x["hit"].isNotNull() & (size >= rule.least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    found = F.aggregate(pairs, start, step, lambda a: a["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(SPAN))


class BlobLedger:
    """Table of (blob, rules seen, spans found) in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
        empty = spark.createDataFrame([], f"blob string, seen array<string>, spans {SPAN}")
        empty.write.mode("ignore").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(f"blob string, seen array<string>, spans {SPAN}").parquet(self.path)

    def unseen(self, docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
        """(blob, text, todo): one copy of each blob, with the rule versions that have not scanned it."""
        text = text_or_empty(text_col)
        blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        keys = F.array(*[F.lit(r.key) for r in rules])
        known = self.table().groupBy("blob").agg(F.flatten(F.collect_set("seen")).alias("known"))
        todo = F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))
        return blobs.join(known, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)

    def scan(self, docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES) -> None:
        """Scan what is unseen and append it to the ledger.  A repeated call finds nothing left to do."""
        new = self.unseen(docs, text_col, rules)
        none = F.array().cast(SPAN)
        found = [F.when(F.array_contains("todo", r.key), spans_of(F.col("text"), r)).otherwise(none) for r in rules]
        (new.select("blob", F.col("todo").alias("seen"), F.concat(*found).alias("spans"))
         .write.mode("append").parquet(self.path))

    def findings(self, docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES,
                 columns: list[str] | None = None) -> DataFrame:
        """Every input row with ``spans``: the findings of its blob by ``rules`` in these versions, by start, then kind as listed."""
        columns = docs.columns if columns is None else columns
        order = F.array(*[F.lit(r.key) for r in rules])

        def key(s):  # ledgers written before spans had a rule hold first versions only
            return F.coalesce(s["rule"], F.concat(s["kind"], F.lit("@1")))

        wanted = F.filter("spans", lambda s: F.array_contains(order, key(s)))
        by = F.array_sort(F.transform(wanted, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, key(s)).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
        per_blob = (self.table().groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
                    .select("blob", by.alias("spans")))
        rows = docs.select(packed(docs, columns).alias("r"), F.sha2(text_or_empty(text_col), 256).alias("blob"))
        out = rows.join(per_blob, "blob", "left")
        return out.select(*unpacked("r", columns, ["blob", "spans"]), "blob",
                          F.coalesce("spans", F.array().cast("array<struct<start:int,rank:bigint,`end`:int,kind:string>>")).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """Scan ``docs`` through a ledger and return the digest of every row.

    Null text counts as empty (no findings); null or repeated ids and repeated rows are ordinary rows
    of their blob; other columns are ignored; an empty table gives an empty table.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ledger.scan(docs)
    return secret_digest(ledger.findings(docs, columns=["doc_id"]))
