"""Hashes of the words of whole Arrow columns, computed without an object for each word.

A word's hash is the sum of its bytes times random odd factors, one for each place, mixed with its length; a run
of words is the sum of their hashes times further factors. Both are universal families: different inputs
collide with a probability of about 2**-57 at most.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time.
BLOCK = 1 << 17

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=64)
def _factors(size: int, salt: int) -> np.ndarray:
    return np.random.default_rng(salt).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _block_hashes(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of some bytes; `rows` are the places where rows begin."""
    letters = ~_SPACE[data]
    first = letters.copy()
    first[1:] &= ~letters[:-1]
    first[rows] = letters[rows]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    kept = data[letters]
    at = np.cumsum(letters)[starts] - 1
    sizes = np.diff(at, append=len(kept))
    factors = _factors(1 << max(6, int(sizes.max() - 1).bit_length()), 3)
    places = np.arange(len(kept)) - np.repeat(at, sizes)
    sums = np.add.reduceat((kept.astype(np.uint64) + np.uint64(1)) * factors[places], at)
    return starts, mix(sums + sizes.astype(np.uint64) * _MIX[2])


def hash_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words `[^\\x20\\x09-\\x0D]+` of all rows one after another, and where each row's begin.

    With `lower`, A-Z count as a-z. Null has no words. `bounds` has one entry more than there are rows.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, hashes, low = [], [], 0
    while low < len(data):
        high = low + BLOCK
        while high < len(data):  # to the next white space, or the next row, whichever comes first
            gap = np.flatnonzero(_SPACE[data[high : high + BLOCK]])
            row = offsets[np.searchsorted(offsets, high)]
            stop = min(high + int(gap[0]) if len(gap) else high + BLOCK, int(row))
            if len(gap) or row <= high + BLOCK:
                high = stop
                break
            high = stop
        high = min(high, len(data))
        part = _LOWER[data[low:high]] if lower else data[low:high]
        inside = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        found = _block_hashes(part, inside)
        starts.append(found[0] + low)
        hashes.append(found[1])
        low = high
    every = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(every, offsets)


def sliding(hashes: np.ndarray, width: int, salt: int) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    factors = _factors(width, salt)
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * factors[i]
    return mix(total)
