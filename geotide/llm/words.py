"""Words of whole Arrow batches in numpy: no Python loop runs over words or characters.

A batch is cut into chunks of bounded text volume, each chunk is one byte array, and words are the
runs of bytes outside a separator class.  Word hashes are 64-bit polynomial sums over the bytes,
finalised by a mixer, so equal words of any two tasks have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one chunk holds (a longer document is a chunk of its own).
CHUNK_BYTES = 1 << 20

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)

#: Separators `[\x20\x09-\x0D]`: all other bytes belong to words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))


_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; those of usual chunks are made once per worker."""
    if base not in _made or len(_made[base]) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), base, dtype=_U)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > 2 * CHUNK_BYTES:  # of one very long text: not kept
            return out[:n]
        _made[base] = out
    return _made[base][:n]


@dataclass
class Words:
    """Words of the documents of a chunk, in order: byte spans, hashes, and each document's first word."""

    data: np.ndarray    # bytes of the chunk (lower-cased where asked)
    doc_at: np.ndarray  # byte offset of each document, and the end
    start: np.ndarray   # byte offset of each word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray   # index of each document's first word, and the number of words

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (row from, row to, bytes, offsets) for runs of rows of bounded size; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray, lower: bool = False, separators: np.ndarray = SPACE) -> Words:
    """Cut the bytes of a chunk into words; a document's end also ends a word."""
    data = LOWER[data] if lower else data
    n = len(data)
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = at[1:-1]
    cut = cut[cut < n]
    begins[cut] = inside[cut]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = cut[cut > 0] - 1
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, dtype=_U)
    weighted = _BYTE[data]
    weighted *= _powers(_RADIX, n)
    np.cumsum(weighted, out=total[1:])
    back = _powers(_INVERSE, n + 1)
    hashes = mix((total[end] - total[start]) * back[start] + (end - start).astype(_U))
    return Words(data, at, start, end, hashes, np.searchsorted(start, at))


def running(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of word hashes and the factors that make differences of them independent of place:
    ``mix((total[b] - total[a]) * back[a])`` is the hash of the words a to b."""
    power = _powers(_RADIX, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=_U)
    np.cumsum(hashes * power[:-1], out=total[1:])
    return total, _powers(_INVERSE, len(hashes) + 1)


def sequences(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in one document: (hash of the run at each word, validity)."""
    n = len(w.hash)
    out = np.zeros(n, dtype=_U)
    ok = np.zeros(n, bool)
    if n >= size:
        total, back = running(w.hash)
        out[:n - size + 1] = mix((total[size:] - total[:-size]) * back[:n - size + 1])
        left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(n)
        ok = left >= size
    return out, ok


def per_document(w: Words, values: np.ndarray) -> np.ndarray:
    """Sum ``values`` (one per word) over each document; empty documents give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[w.first[1:]] - total[w.first[:-1]]


def large_batches(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The text column of a batch as a plain string array."""
    return batch.column(batch.schema.get_field_index(column))
