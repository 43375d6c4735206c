"""Array kernels over batches of texts, used inside tasks.

Texts stay in Arrow's UTF-8 buffer; words and shingles are found and hashed
with whole-array operations, half a megabyte of text at a time, so memory
does not depend on the batch (a longer text is a piece of its own). A batch's
memory goes back to the system when the batch is done: executors hold the
JVM's heap and one Python worker per core.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19

# Multipliers of the hashes: any odd 64-bit numbers do.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _geometric(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n."""
    global _powers, _inverses
    if len(_powers) < n:
        m = max(n, PIECE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers, _inverses = (np.multiply.accumulate(
            np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (_BASE, inverse))
    return _powers, _inverses


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, one by one; memory that Arrow and the C library keep of
    a batch that is done goes back to the system before the next comes.
    Workers live on from task to task, so what they kept would add up."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _libc is not None:
            _libc.malloc_trim(0)


def _c_library():
    """glibc, or None where another C library has no ``malloc_trim``."""
    try:
        library = ctypes.CDLL(None)
        return library if hasattr(library, "malloc_trim") else None
    except OSError:
        return None


_libc = _c_library()


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), and where each row's begin and end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def utf8_pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, row offsets)`` of runs of rows of about PIECE_BYTES."""
    data, offsets = utf8_bytes(texts)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE
                ) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a piece, and each row's word bounds.
    ``separators`` tells for every byte whether it lies between words.

    A word's hash is its polynomial over bytes, summed from position-weighted
    bytes of the whole piece and brought back to the word's start.
    """
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[row_starts] = inside[row_starts]  # words end with their text
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    powers, inverses = _geometric(len(data))
    weighted = (data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)]
    weighted[~inside] = 0
    return mix64(np.add.reduceat(weighted, starts) * inverses[starts]), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside rows, and each row's bounds. A
    row of fewer than k words, but one at least, has one shingle of all."""
    counts = np.diff(bounds)
    n = len(words)
    at = np.arange(n)
    ends = np.repeat(bounds[1:], counts)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(n, np.uint64)
    for j in range(k):
        factor = np.uint64(pow(int(_STEP), j, 1 << 64))
        total += np.where(at + j < ends, padded[j:j + n] * factor, np.uint64(0))
    keep = (at + k <= ends) | (at == np.repeat(bounds[:-1], counts))
    per_row = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    return mix64(total[keep]), np.concatenate([np.zeros(1, np.int64), np.cumsum(per_row)])
