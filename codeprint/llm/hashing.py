"""Vectorised hashes of words and word n-grams over Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of independent hash functions.
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: What a byte counts: itself and one more, so that no byte counts nothing; blanks count nothing.
_BYTES = np.arange(1, 257, dtype=np.uint64)
_BYTES[_BLANK] = 0
#: Bytes hashed at once.
PIECE_BYTES = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_factors(n: int, seed: int) -> np.ndarray:
    """A pseudo-random factor for each place in a word; no factor follows from another."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + np.uint64(seed * 0xD1B54A32D192ED03 & (1 << 64) - 1))


def word_hashes(column: pa.Array, lower: bool = False, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes outside 0x20 and 0x09-0x0D) of all texts in order, and the
    number of the first word of each text (one entry more than texts).  Null is the empty text.

    A word's hash is the sum of its bytes, each times the factor of its place: a multilinear hash,
    which unlike powers of one base has no words that collide by their structure.  Another seed
    gives an independent hash."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    if lower:
        data = _LOWER[data]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = at[:-1][at[:-1] < len(data)]
    begins[inner] = ~blank[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    ends, hashes = np.append(starts[1:], len(data)), np.empty(len(starts), np.uint64)
    factors = place_factors(int((ends - starts).max()), seed)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), PIECE_BYTES)), len(starts)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # bounds the memory of long texts
        lo, hi = starts[a], ends[b - 1]
        place = np.arange(lo, hi) - np.repeat(starts[a:b], ends[a:b] - starts[a:b])
        hashes[a:b] = np.add.reduceat(_BYTES[data[lo:hi]] * factors[place], starts[a:b] - lo)
    return mix(hashes), np.searchsorted(starts, at)


def ngrams(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Unmixed hashes of the n-grams that start at each word: H(a+b) = H(a) * base^b + H(b)."""
    out, done, block, size = None, 0, words, 1
    while True:
        if n & 1:
            if out is None:
                out = block
            else:
                k = len(block) - done
                out = out[: max(k, 0)] * np.uint64(pow(int(base), size, 1 << 64)) + block[done:]
            done += size
        n >>= 1
        if not n:
            return out
        block = block[: max(len(block) - size, 0)] * np.uint64(pow(int(base), size, 1 << 64)) + block[size:]
        size *= 2


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
