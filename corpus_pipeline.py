"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotide.llm import exact_dedup as dedup
from geotide.llm import language, mixing, ngram_join, packing
from geotide.session import checkpoint_dir

#: Documents whose language is less certain than this are rejected, and those without a letter.
LEAST_CERTAIN = 0.5
#: Words of a shingle and Jaccard similarity of near copies; op1 has values of its own.
NEAR_SIZE = 5
NEAR_THRESHOLD = (80, 100)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or without a clear language go."""
    columns = docs.columns
    found = language.identify_languages(docs)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).select(columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the smallest id stays."""
    return dedup.exact_dedup(docs).where("kept").select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: the document that names its component stays."""
    found = ngram_join.jaccard_components(docs, size=NEAR_SIZE, threshold=NEAR_THRESHOLD)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents are repeated by their draws and shuffled."""
    return mixing.mix_sources(docs).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of the repeated documents with their places in token windows."""
    return packing.pack(docs)


STAGES = [("language ID", identify), ("exact dedup", without_copies), ("n-gram Jaccard join", without_near_copies),
          ("mixing", mix), ("packing", pack)]

#: SQL cannot express naive Bayes or the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; intermediate tables go to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
