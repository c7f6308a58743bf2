"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every task and adds the counts up in Spark; the matrix of log
probabilities (languages x 2**bits) is small whatever the corpus and is broadcast.  Scoring is a
sparse product in numpy: a document's n-grams pick rows of the matrix, which are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geotide.llm.shared import in_arrow
from geotide.llm.words import chunks, large_batches

#: Buckets of the n-gram hash as a power of two, and the n-gram lengths.
BITS = 14
LENGTHS = (2, 3, 4)
UNKNOWN = "und"

_U = np.uint64
_SPACE = 32
_RADIX = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Per code point: its lower-case letter, or a space for all that is no letter."""
    if not _tables:
        out = np.full(0x110000, _SPACE, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _tables.append(out)
    return _tables[0]


def letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a chunk with spaces before each document, and the documents' offsets.

    There are as many spaces as the longest n-gram that starts at a document's last letter reads.
    """
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    gap = max(LENGTHS) - 1
    codes = np.insert(_folded()[points], np.repeat(lead[:-1], gap), _SPACE)
    return codes, lead + gap * np.arange(len(at))


def ngram_buckets(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each position (the last ones are padded with spaces)."""
    h = np.zeros(len(codes), dtype=_U)
    padded = np.concatenate([codes, np.full(size, _SPACE, dtype=np.uint32)]).astype(_U)
    for k in range(size):
        h = h * _U(_RADIX) + padded[k:k + len(codes)]
    h = (h ^ (h >> _U(31))) * _U(0xC4CEB9FE1A85EC53 + 2 * size)
    return (h >> _U(64 - BITS)).astype(np.int32)


def _weights(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions that count: an n-gram starts at a letter or at the space before one."""
    letter = codes != _SPACE
    out = letter.copy()
    out[:-1] |= letter[1:]
    out[at[1:-1] - 1] = letter[at[1:-1] - 1]  # a document's last position starts nothing in the next
    return out


def in_training(id_col: Column) -> Column:
    """Rows that may be learned from: CRC-32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 != 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for lo, hi, data, at in chunks(large_batches(batch, "text")):
            codes, start = letters(data, at)
            keep = _weights(codes, start)
            names = sorted(set(langs[lo:hi]))
            of = np.array([names.index(x) for x in langs[lo:hi]])
            lang = np.repeat(of, np.diff(start))[keep]
            seen = np.zeros(len(names) << BITS, dtype=np.int64)
            for size in LENGTHS:
                seen += np.bincount((lang << BITS) + ngram_buckets(codes, size)[keep], minlength=len(seen))
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + seen[k << BITS:(k + 1) << BITS]
                docs[name] = docs.get(name, 0) + int((of == k).sum())
    for name, counts in total.items():
        hit = np.flatnonzero(counts)
        n = len(hit) + 1
        yield pa.RecordBatch.from_arrays([
            pa.array([name] * n, pa.string()), pa.array(np.append(hit, -1).astype(np.int32)),
            pa.array(np.append(counts[hit], docs[name]).astype(np.int64))], names=["lang", "bucket", "n"])


@dataclass
class LanguageModel:
    """Languages in order, and the log probability of each bucket (rows: buckets) and of each language."""

    names: list[str]
    logs: np.ndarray
    prior: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", alpha: float = 0.1) -> LanguageModel:
    """Count over all given rows with text and language; ``alpha`` is the additive smoothing."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = (in_arrow(rows, _count, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # languages x 2**BITS rows at most
    names = sorted(counted["lang"].unique())
    logs = np.zeros((1 << BITS, max(1, len(names))), dtype=np.float32)
    prior = np.zeros(max(1, len(names)))
    for k, name in enumerate(names):
        own = counted[counted["lang"] == name]
        n = np.zeros(1 << BITS)
        hit = own[own["bucket"] >= 0]
        n[hit["bucket"].to_numpy()] = hit["n"].to_numpy()
        logs[:, k] = np.log((n + alpha) / (n.sum() + alpha * len(n)))
        prior[k] = np.log(float(own.loc[own["bucket"] < 0, "n"].sum()))
    return LanguageModel(names, logs, prior - (np.logaddexp.reduce(prior) if names else 0.0))


def score_chunk(model: LanguageModel, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each document of a chunk."""
    codes, start = letters(data, at)
    keep = _weights(codes, start)
    picked = np.zeros((len(codes), len(model.prior)), dtype=np.float32)
    for size in LENGTHS:
        picked += model.logs[ngram_buckets(codes, size)]
    picked[~keep] = 0
    total = np.add.reduceat(picked, start[:-1], axis=0, dtype=np.float64) + model.prior
    best = total.argmax(axis=1)
    top = total[np.arange(len(best)), best]
    share = 1 / np.exp(total - top[:, None]).sum(axis=1)
    some = np.add.reduceat(codes != _SPACE, start[:-1]) > 0
    if not model.names:
        some[:] = False
    return [model.names[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, share, 0.0)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Columns of the input (all by default) and lang_pred, score; they replace input columns of these names.

    Null texts and texts without a letter get `und` and score 0; so does every text when nothing was learned.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c.lower() not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for _, _, data, at in chunks(batch.column(batch.num_columns - 1)):
                names, share = score_chunk(shared.value, data, at)
                langs += names
                scores.append(share)
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], names=[*columns, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("text to score"))
    kept = rows.drop("text to score").schema
    schema = kept.add("lang_pred", "string").add("score", "double")
    return in_arrow(rows, run, schema)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       columns: list[str] | None = None) -> DataFrame:
    """Train on the rows outside the held-out quarter and predict all rows.  Repeated rows get equal results."""
    model = train(docs.where(in_training(F.col(id_col))), text_col, lang_col)
    return predict(docs, model, text_col, columns)
