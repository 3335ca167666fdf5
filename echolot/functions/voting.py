"""Numpy kernels over two sets of fingerprints: votes for offsets, bits that differ, spectral shapes.

Nothing that they hold grows with the number of pairs: votes are counted for some files at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Keys of single values: two halves of 16 bits.
KEYS = 1 << 17
#: Values of files whose votes are looked up at a time, votes that are sorted at a time, values and shapes compared at a time (about).
CHUNK_VALUES, CHUNK_VOTES, CHUNK_BITS, CHUNK_PAIRS = 200_000, 2_000_000, 2_000_000, 200_000


def has_kept(values: np.ndarray, bounds: np.ndarray, kept: np.ndarray, stride: int) -> np.ndarray:
    """Which prints (values between bounds) have a kept key at an indexed place."""
    place = np.arange(len(values)) - np.repeat(bounds[:-1], np.diff(bounds))
    hit = (place % stride == 0) & (kept[values & 0xFFFF] | kept[values >> 16 | 0x10000])
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[bounds[1:]] > total[bounds[:-1]]


class Prints:
    """Prints in order of their files; rows of one file count as one in votes."""

    def __init__(self, idx: np.ndarray, values: list[np.ndarray]):
        self.order = np.argsort(idx, kind="stable")  # of the given rows
        self.idx, self.sizes = idx[self.order], np.array([len(values[k]) for k in self.order], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.values = np.concatenate([values[k] for k in self.order]) if values else np.zeros(0, np.uint32)
        self.files, self.first, self.file = np.unique(self.idx, return_index=True, return_inverse=True)
        self.rows = np.diff(np.append(self.first, len(idx)))
        self.longest = np.maximum.reduceat(self.sizes, self.first) if len(idx) else self.sizes

    def entries(self, low: int, high: int, kept: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, file, place) of the kept entries of these rows, by file."""
        values, sizes = self.values[self.bounds[low] : self.bounds[high]], self.sizes[low:high]
        place = np.arange(len(values)) - np.repeat(self.bounds[low:high] - self.bounds[low], sizes)
        on = place % stride == 0
        values, place, file = values[on].astype(np.int64), place[on], np.repeat(self.file[low:high], sizes)[on]
        key = np.stack([values & 0xFFFF, values >> 16 | 0x10000], 1).ravel()
        hit = kept[key]
        return key[hit], np.repeat(file, 2)[hit], np.repeat(place, 2)[hit]

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Rows of whole files, of about CHUNK_VALUES values."""
        ends = np.append(self.first, len(self.idx))
        low = 0
        while low < len(self.files):
            high = max(low + 1, int(np.searchsorted(self.bounds[ends], self.bounds[ends[low]] + CHUNK_VALUES, side="right")) - 1)
            yield int(ends[low]), int(ends[high])
            low = high


def pair_votes(x: Prints, y: Prints | None, kept: np.ndarray, stride: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(file of x, file of y, step, votes, offsets, most) of the pairs with at least `least` votes for one offset.

    Without y, x is paired with itself, each pair once. `step` is the place in x less that in y of the offset with
    most votes; of several, the one with the least place in the lesser file less that in the other. Votes and
    offsets count those offsets that have `least` votes.

    Files of y lie on a line so far apart that a place there, less a place in x, tells file and offset.
    """
    own = y is None
    y = x if own else y
    if not len(x.idx) or not len(y.idx):
        return
    reach = int(x.longest.max())
    low = np.concatenate([[0], np.cumsum(y.longest + reach)])  # of what a file of y can give
    width = int(low[-1]) + 1
    index, size = np.empty(int((2 * -(-y.sizes // stride)).sum()), np.int64), 0
    for a, b in y.chunks():
        key, file, place = y.entries(a, b, kept, stride)
        index[size : size + len(key)] = key * width + low[file] + reach + place
        size += len(key)
    index = index[:size]
    index.sort()
    first = np.searchsorted(index, np.arange(KEYS + 1) * width)
    most_files = max(1, (1 << 62) // width)
    for a, b in x.chunks():
        key, file, place = x.entries(a, b, kept, stride)
        start = np.searchsorted(index, key * width + low[file] + reach + place, side="right") if own else first[key]
        n = first[key + 1] - start
        total = np.concatenate([[0], np.cumsum(n)])
        files = np.unique(file)
        ends = np.append(np.searchsorted(file, files), len(file))
        at = 0
        while at < len(files):
            to = max(at + 1, int(np.searchsorted(total[ends], total[ends[at]] + CHUNK_VOTES, side="right")) - 1)
            to = min(to, at + most_files)
            p, q = ends[at], ends[to]
            if total[q] > total[p]:
                given = np.repeat(start[p:q] - (total[p:q] - total[p]), n[p:q])
                given += np.arange(len(given))
                votes = index[given]
                del given
                votes += np.repeat((file[p:q] - files[at] - key[p:q]) * width - place[p:q], n[p:q])
                votes.sort()
                yield from _best(votes, x, y, int(files[at]), low, reach, width, least)
            at = to


def _best(votes: np.ndarray, x: Prints, y: Prints, base: int, low: np.ndarray, reach: int, width: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    if least > 1:
        votes = votes[:0] if len(votes) < least else votes
        code = np.unique(votes[: len(votes) - least + 1][votes[least - 1 :] == votes[: len(votes) - least + 1]]) if len(votes) else votes
        n = np.searchsorted(votes, code, side="right") - np.searchsorted(votes, code)
    else:
        cut = np.concatenate([[0], np.flatnonzero(votes[1:] != votes[:-1]) + 1, [len(votes)]])
        code, n = votes[cut[:-1]], np.diff(cut)
    if not len(code):
        return
    one, rest = np.divmod(code, width)
    other = np.searchsorted(low, rest, side="right") - 1
    one += base
    step = low[other] + reach - rest
    differ = x.files[one] != y.files[other]
    if not differ.all():
        one, other, step, n = one[differ], other[differ], step[differ], n[differ]
        if not len(one):
            return
    off = np.where(x.files[one] < y.files[other], step, -step)
    cut = np.concatenate([[0], np.flatnonzero((one[1:] != one[:-1]) | (other[1:] != other[:-1])) + 1])
    shift = int(np.abs(off).max()) + 1
    best = np.maximum.reduceat(n * (2 * shift) + shift - off, cut)
    most, left = np.divmod(best, 2 * shift)
    off = shift - left
    one, other = one[cut], other[cut]
    step = np.where(x.files[one] < y.files[other], off, -off)
    yield one, other, step, np.add.reduceat(n, cut), np.diff(np.append(cut, len(n))), most


def rows_of(x: Prints, y: Prints, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the pairs, row of x, row of y): a file of several rows pairs with each of them."""
    n = x.rows[one] * y.rows[other]
    pair = np.repeat(np.arange(len(one)), n)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return pair, x.first[one[pair]] + nth // y.rows[other[pair]], y.first[other[pair]] + nth % y.rows[other[pair]]


def bit_errors(x: Prints, y: Prints, one: np.ndarray, other: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(overlap, bits that differ there) of rows of x and y, y moved on by the step."""
    ahead, behind = np.maximum(step, 0), np.maximum(-step, 0)
    overlap = np.maximum(0, np.minimum(x.sizes[one] - ahead, y.sizes[other] - behind))
    p, q = x.bounds[one] + ahead, y.bounds[other] + behind
    errors, ends, low = np.zeros(len(one), np.int64), np.cumsum(overlap), 0
    while low < len(one):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_BITS, side="right")))
        n = overlap[low:high]
        begin = np.cumsum(n) - n
        along = np.arange(int(n.sum())) - np.repeat(begin, n)
        bits = np.bitwise_count(x.values[np.repeat(p[low:high], n) + along] ^ y.values[np.repeat(q[low:high], n) + along])
        total = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        errors[low:high] = total[begin + n] - total[begin]
        low = high
    return overlap, errors


def places(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where the pairs (p, q) are among the different pairs (a, b), which are sorted; -1 for others."""
    out, low, high = np.full(len(p), -1), np.searchsorted(a, p), np.searchsorted(a, p, side="right")
    some = np.flatnonzero(high > low)
    files, other = np.unique(np.concatenate([b, q[some]]), return_inverse=True)
    line = np.searchsorted(a, a) * (len(files) + 1) + other[: len(b)]  # sorted, as a and b are
    asked = low[some] * (len(files) + 1) + other[len(b) :]
    at = np.minimum(np.searchsorted(line, asked), len(line) - 1)
    hit = line[at] == asked
    out[some[hit]] = at[hit]
    return out


def shape_pairs(idx: np.ndarray, seconds: np.ndarray, shapes: np.ndarray, sizes: np.ndarray, side: np.ndarray, least: float, tolerance: float, most: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, distance) of files of about the same length (up to `least` seconds or a share apart) and with like shapes (padded to one size).

    Files of sides 0 and 1 pair with the other side only, those of side 2 with each other. Sums run in the order of the
    bands, so that the distance is that of the column function.
    """
    order = np.argsort(seconds, kind="stable")
    idx, seconds, sizes, side = idx[order], seconds[order], sizes[order], side[order]
    bands = np.ascontiguousarray(shapes[order].T.astype(np.int16))
    if not len(idx):
        return
    farthest = np.maximum(seconds + least, seconds / (1 - tolerance)) * (1 + 1e-9) + 1e-9 if tolerance < 1 else np.full(len(idx), np.inf)
    ends = np.searchsorted(seconds, farthest, side="right")
    n = np.maximum(0, ends - np.arange(1, len(idx) + 1))
    total, low = np.cumsum(n), 0
    while low < len(idx):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + CHUNK_PAIRS, side="right")))
        m = n[low:high]
        one = np.repeat(np.arange(low, high), m)
        other = np.arange(len(one)) - np.repeat(np.cumsum(m) - m, m) + one + 1
        near = np.abs(seconds[one] - seconds[other]) <= np.maximum(least, np.maximum(seconds[one], seconds[other]) * tolerance)
        near &= idx[one] != idx[other]
        near &= (side[one] == 2) | (side[one] != side[other])
        one, other = one[near], other[near]
        weight, apart = np.zeros(len(one)), np.zeros(len(one))
        for band in bands:
            p, q = band[one], band[other]
            w = np.maximum(p, q) / 255.0
            weight += w
            apart += w * np.abs(p - q)
        with np.errstate(invalid="ignore", divide="ignore"):
            distance = np.where(weight == 0, 0.0, apart / weight / 255)
        distance[(sizes[one] != sizes[other]) | (sizes[one] == 0)] = 1.0
        like = distance <= most
        one, other = one[like], other[like]
        yield np.minimum(idx[one], idx[other]), np.maximum(idx[one], idx[other]), distance[like]
        low = high
