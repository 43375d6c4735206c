"""Simple-8b coding of token ids: whole 64-bit words, vectorised both ways.

A word holds a selector (its top four bits) and 60 bits of ids. The selector
tells how many ids the word holds and how many bits each has; the coder takes
the selector that packs the most of the ids that follow. An id of more than
60 bits is an escape: its word holds its place among the block's escaped ids,
which are stored whole.

Ids are coded in blocks of a fixed count, no word crosses a block, and a table
gives each block's first word and first escape, so a run of ids is decoded
from its own blocks alone. Layout of a payload, all little-endian: ``S8B1``,
ids per block (4 bytes), number of ids, words and escapes (8 bytes each); for
every block first word and first escape (8 bytes each); the words; the escapes.
"""

from __future__ import annotations

import struct

import numpy as np

# Ids in a word and bits of each, by selector.
CODES = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
         (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = len(CODES)
COUNTS = np.array([count for count, _ in CODES] + [1])
BLOCK_IDS = 1024

_MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQQQ")
_SELECTOR = np.uint64(60)


def _selectors(ids: np.ndarray, block_ids: int) -> np.ndarray:
    """For every position the selector of a word that begins there: the one
    of most ids, all narrow enough and of the position's block. Where a code
    of more ids fits, every code of fewer fits too, so the selector is the
    escape's less the number of codes that fit."""
    n = len(ids)
    blocks = np.zeros((-(-n // block_ids), block_ids), np.uint64)
    blocks.reshape(-1)[:n] = ids
    given = np.arange(blocks.size).reshape(blocks.shape) < n
    best = np.full(blocks.shape, ESCAPE, np.uint8)
    for count, width in reversed(CODES):
        # Whether the next ``count`` ids are narrow: windows of 1, 2, 4, ... that overlap.
        window, have = (blocks < np.uint64(1 << width)) & given, 1
        while have < count:
            step = min(have, count - have)
            window[:, :-step] &= window[:, step:]
            window[:, -step:] = False
            have += step
        if not window.any():
            break
        best -= window.view(np.uint8)
    return best.reshape(-1)[:n]


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """The payload of ids (unsigned, up to 64 bits)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    firsts = np.arange(0, n, block_ids)
    best = _selectors(ids, block_ids)
    step = COUNTS[best]
    # All blocks go forward together, a word a round.
    ends, at, live, begun = np.minimum(firsts + block_ids, n), firsts.copy(), np.arange(len(firsts)), []
    while len(live):
        here = at[live]
        begun.append(here)
        at[live] = here + step[here]
        live = live[at[live] < ends[live]]
    starts = np.sort(np.concatenate(begun)) if begun else np.zeros(0, np.int64)
    selectors = best[starts]
    words = selectors.astype(np.uint64) << _SELECTOR
    for selector, (count, width) in enumerate(CODES):
        own = np.flatnonzero(selectors == selector)
        if width and len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            words[own] |= np.bitwise_or.reduce(ids[starts[own][:, None] + np.arange(count)] << shifts, axis=1)
    escaped = np.flatnonzero(selectors == ESCAPE)
    escapes = ids[starts[escaped]]
    first_word = np.searchsorted(starts, firsts).astype(np.uint64)
    first_escape = np.searchsorted(starts[escaped], firsts).astype(np.uint64)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64) - first_escape[starts[escaped] // block_ids]
    table = np.stack([first_word, first_escape], axis=1) if len(firsts) else np.zeros((0, 2), np.uint64)
    return b"".join([_HEAD.pack(_MAGIC, block_ids, n, len(words), len(escapes)),
                     *(x.astype("<u8").tobytes() for x in (table, words, escapes))])


def count(payload: bytes) -> int:
    """Number of ids in a payload."""
    return _HEAD.unpack_from(payload)[2]


def decode(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids at positions ``start`` to ``stop`` (default: all), read from
    the blocks that hold them."""
    magic, block_ids, n, n_words, n_escapes = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a Simple-8b payload")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint64)
    n_blocks = -(-n // block_ids)
    rest = np.frombuffer(payload, "<u8", 2 * n_blocks + n_words + n_escapes, _HEAD.size)
    table = rest[:2 * n_blocks].reshape(n_blocks, 2).astype(np.int64)
    low, high = start // block_ids, (stop - 1) // block_ids + 1
    word_ends = np.append(table[1:, 0], n_words)
    words = rest[2 * n_blocks:][table[low, 0]:word_ends[high - 1]]
    selectors = (words >> _SELECTOR).astype(np.uint8)
    counts = COUNTS[selectors]
    places = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector, (count_, width) in enumerate(CODES):
        own = np.flatnonzero(selectors == selector)
        if width and len(own):
            shifts = np.arange(count_, dtype=np.uint64) * np.uint64(width)
            mask = np.uint64((1 << width) - 1)
            out[places[own][:, None] + np.arange(count_)] = (words[own][:, None] >> shifts) & mask
    escaped = np.flatnonzero(selectors == ESCAPE)
    if len(escaped):
        blocks = low + places[escaped] // block_ids
        inside = (words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64)
        out[places[escaped]] = rest[2 * n_blocks + n_words:][table[blocks, 1] + inside]
    return out[start - low * block_ids:stop - low * block_ids]
