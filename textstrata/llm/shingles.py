"""Word shingles of Arrow text batches as 64-bit hashes, computed over whole byte buffers at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: A random 64-bit value per byte (A-Z as a-z), and an odd multiplier.
BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What a set's two identities are mixed with.
IDENTITIES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and per row the number of its first word (one entry more than rows)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[raw]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    word = ~space
    begins = word.copy()
    begins[1:] &= space[:-1] | border[1:n]
    starts = np.flatnonzero(begins)
    finishes = word.copy()
    finishes[:-1] &= space[1:] | border[1:n]
    stops = np.flatnonzero(finishes) + 1
    # Byte and place in the word are mixed before they are added: sums of such values have no structure that a text could meet.
    begun = np.zeros(n, np.int64)
    begun[starts] = starts
    place = (np.arange(n) - np.maximum.accumulate(begun)).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(BYTE_VALUES[raw] + place * ODD), dtype=np.uint64)))
    hashes = mix(total[stops] - total[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per row: all hashes, rows one after the other and sorted within a row, and row offsets.

    A row of fewer words than ``size`` has its whole sequence as one shingle, a row without words none.
    """
    raw, offsets = text_buffers(column)
    words, first = word_hashes(raw, offsets)
    counts = np.diff(first)
    rows = len(counts)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(rows), shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[:-1][owner]
    have = np.minimum(counts, size)[owner]
    h = have.astype(np.uint64)
    padded = np.concatenate((words, np.zeros(size, np.uint64)))
    for k in range(size):
        h = np.where(k < have, mix(h * ODD + padded[at + k]), h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))).astype(np.int64)


def identities(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit identities of each row's set, whatever its order: 128 bits in all."""
    n = np.diff(offsets).astype(np.uint64)
    out = []
    for salt in IDENTITIES:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt), dtype=np.uint64)))
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + n).view(np.int64))
    return out[0], out[1]
