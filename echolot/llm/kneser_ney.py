"""Interpolated Kneser-Ney character models over words, stored in sorted arrays of n-gram keys.

A word is read with order - 1 spaces before it and one after; each character and that last space is
predicted from the order - 1 characters before it. A key packs 16 bits per character, the last character
lowest, so a suffix is a mask and a context is a shift; characters beyond the basic plane share the codes of its
private area.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import xxhash

#: Characters of an n-gram (at most 4), discount, number of codes, over which unseen characters share their mass.
ORDER, DISCOUNT, ALPHABET = 4, 0.75, 1 << 16
_BITS = 16
#: First code of the private area and its size.
_PRIVATE, _PRIVATE_SIZE = 0xE000, 6400
#: Words that are scored at a time.
BLOCK = 20_000


def code_of(character: str) -> int:
    code = ord(character)
    return code if code < ALPHABET else _PRIVATE + code % _PRIVATE_SIZE


def suffix_mask(k: int) -> int:
    return (1 << _BITS * k) - 1


def word_keys(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys, starts): n-gram keys of all words one after another, and where each word's keys start."""
    pad = " " * (order - 1)
    codes = np.frombuffer((pad + (" " + pad[1:]).join(words) + " ").encode("utf-32-le"), np.uint32) if words else np.zeros(0, np.uint32)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.where(codes < ALPHABET, codes, _PRIVATE + codes % _PRIVATE_SIZE).astype(np.uint64)
    keys = np.zeros(len(codes) - order + 1, np.uint64)
    for i in range(order):
        keys = keys << np.uint64(_BITS) | codes[i : i + len(keys)]
    # word w gives len(w) + 1 keys, then come order - 2 keys that end in the padding of the next word
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    firsts = np.concatenate([[0], np.cumsum(sizes + order - 2)[:-1]])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return keys[np.repeat(firsts - starts, sizes) + np.arange(sizes.sum())], starts


def count_keys(words: list[str], weights: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram keys of weighted words with their counts."""
    keys, starts = word_keys(words, order)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    weight = np.repeat(weights, np.diff(np.concatenate([starts, [len(keys)]])))
    by = np.argsort(keys, kind="stable")
    keys, weight = keys[by], weight[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weight, first)


def merge_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted table of n-gram keys with summed counts."""
    keys, counts = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted table, -1 for those not there."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


@dataclass
class CharacterModels:
    """Several models over one set of sorted keys: for every known k-gram the log2 probability in each model,
    and for every known context the log2 of the mass that each model leaves to the shorter context."""

    names: list[str]
    order: int
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]

    @property
    def entries(self) -> int:
        return sum(map(len, self.keys)) + sum(map(len, self.contexts))

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """log2 probability of each n-gram's last character in each model."""
        total = np.zeros((len(keys), len(self.names)), np.float32)
        open_ = np.arange(len(keys))
        for k in range(self.order, 0, -1):
            own = keys[open_] & np.uint64(suffix_mask(k))
            at = _lookup(self.keys[k - 1], own)
            known = at >= 0
            total[open_[known]] += self.logs[k - 1][at[known]]
            open_, own = open_[~known], own[~known]
            if not len(open_):
                return total
            at = _lookup(self.contexts[k - 1], own >> np.uint64(_BITS))
            total[open_[at >= 0]] += self.back[k - 1][at[at >= 0]]
        total[open_] -= np.float32(np.log2(ALPHABET))
        return total

    def score_words(self, words: list[str]) -> np.ndarray:
        """log2 probability of each word in each model."""
        keys, starts = word_keys(words, self.order)
        if not len(keys):
            return np.zeros((0, len(self.names)), np.float32)
        return np.add.reduceat(self.log_probabilities(keys), starts, axis=0)


def _context_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of sorted keys with the sum of counts and the number of followers."""
    context = keys >> np.uint64(_BITS)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
    if not len(first):
        return context, np.zeros(0), np.zeros(0)
    return context[first], np.add.reduceat(counts, first).astype(float), np.diff(np.concatenate([first, [len(keys)]])).astype(float)


def lower_order(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of k-grams from that of (k + 1)-grams."""
    suffix = keys & np.uint64(suffix_mask(k))
    by = np.argsort(suffix, kind="stable")
    suffix, counts = suffix[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]])) if len(suffix) else np.zeros(0, np.int64)
    if not len(first):
        return suffix, np.zeros(0)
    own = suffix[first]
    begins = (own >> np.uint64(_BITS * (k - 1)) == ord(" ")) & (k > 1)  # a lone space is the end of a word
    return own, np.where(begins, np.add.reduceat(counts, first), np.diff(np.concatenate([first, [len(suffix)]])))


def train(tables: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, discount: float = DISCOUNT) -> CharacterModels:
    """Models from sorted n-gram tables of the highest order, {name: (keys, counts)}.

    Lower orders use continuation counts, the number of different characters that a k-gram follows; k-grams
    that begin a word follow nothing but padding and keep their raw counts.
    """
    names = sorted(tables)
    levels: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for name in names:
        keys, counts = tables[name]
        chain = [(keys, counts.astype(float))]
        for k in range(order - 1, 0, -1):
            chain.insert(0, lower_order(*chain[0], k))
        levels[name] = chain
    models = CharacterModels(names, order, [], [], [], [])
    for k in range(1, order + 1):
        union = np.unique(np.concatenate([levels[n][k - 1][0] for n in names])) if names else np.zeros(0, np.uint64)
        union_context = np.unique(union >> np.uint64(_BITS))
        probability, mass = np.zeros((len(union), len(names))), np.ones((len(union_context), len(names)))
        for j, name in enumerate(names):
            keys, counts = levels[name][k - 1]
            context, total, followers = _context_sums(keys, counts)
            at = _lookup(context, union_context)
            mass[at >= 0, j] = discount * followers[at[at >= 0]] / total[at[at >= 0]]
            own = _lookup(keys, union)
            there = own >= 0
            where = _lookup(context, union[there] >> np.uint64(_BITS))
            probability[there, j] = np.maximum(counts[own[there]] - discount, 0) / total[where]
        if k == 1:
            lower = np.full((len(union), len(names)), 1.0 / ALPHABET)
        else:  # every suffix of a known k-gram is known in the union, as the tables are nested
            lower = np.exp2(models.logs[k - 2][_lookup(models.keys[k - 2], union & np.uint64(suffix_mask(k - 1)))].astype(float))
        left = mass[_lookup(union_context, union >> np.uint64(_BITS))] if len(union) else np.zeros((0, len(names)))
        models.keys.append(union)
        models.logs.append(np.log2(np.maximum(probability + left * lower, 1e-30)).astype(np.float32))
        models.contexts.append(union_context)
        models.back.append(np.log2(np.maximum(mass, 1e-30)).astype(np.float32))
    return models


class WordScores:
    """Scores of words in all models, remembered for a bounded number of words."""

    def __init__(self, models: CharacterModels, entries: int = 250_000) -> None:
        self.models, self.entries = models, min(entries, 3_000_000 // max(1, len(models.names)))
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, len(models.names)), np.float32)

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """log2 probability of each text's words in each model."""
        words = list(chain.from_iterable(texts))
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        new = self._unknown(words, at)
        if len(self.places) + len(new) > self.entries and self.places:
            self.places, self.table = {}, self.table[:0]
            at[:] = -1
            new = self._unknown(words, at)
        if new:
            missing = np.flatnonzero(at < 0)
            base = len(self.table)
            self.places.update(zip(new, range(base, base + len(new)), strict=True))
            scored = [self.models.score_words(new[low : low + BLOCK]) for low in range(0, len(new), BLOCK)]
            self.table = np.concatenate([self.table, *scored])
            at[missing] = np.fromiter(map(self.places.__getitem__, map(words.__getitem__, missing.tolist())), np.int64, len(missing))
        sums = np.concatenate([np.zeros((1, self.table.shape[1])), np.cumsum(self.table[at], axis=0, dtype=np.float64)])
        ends = np.cumsum([0, *map(len, texts)])
        return sums[ends[1:]] - sums[ends[:-1]]

    @staticmethod
    def _unknown(words: list[str], at: np.ndarray) -> list[str]:
        """The different words without a place, in order of appearance."""
        return list(dict.fromkeys([words[k] for k in np.flatnonzero(at < 0).tolist()]))


@dataclass
class HashedModel:
    """One model whose tables have at most `BUCKETS` entries for each order, whatever the size of the corpus.

    K-grams and contexts are hashed to buckets; those that share one share their counts. For each order: sorted
    buckets of k-grams with counts, sorted buckets of contexts with their sums of counts and numbers of followers.
    """

    order: int
    discount: float
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    #: Entries of a table.
    BUCKETS = 1 << 21

    @staticmethod
    def bucket(key: int) -> int:
        """As Spark computes it: XXH64 of eight bytes with seed 42."""
        value = xxhash.xxh64_intdigest(key.to_bytes(8, "little"), 42)
        return (value - (1 << 64) if value >> 63 else value) % HashedModel.BUCKETS

    def __post_init__(self) -> None:
        self._seek()

    def _seek(self) -> None:
        """Sorted buckets as plain arrays, in which a single look-up is cheapest."""
        self.places = [(array("q", g[0].astype(np.int64).tobytes()), array("q", c[0].astype(np.int64).tobytes())) for g, c in zip(self.grams, self.contexts, strict=True)]

    def _sums(self, k: int, context: int) -> tuple[float, float] | None:
        """Sum of counts after a context of k - 1 characters and the mass that it leaves to the shorter one."""
        slot, around = self.bucket(context), self.places[k - 1][1]
        at = bisect_left(around, slot)
        if at == len(around) or around[at] != slot:
            return None
        _, totals, followers = self.contexts[k - 1]
        return float(totals[at]), self.discount * float(followers[at])

    def _count(self, k: int, gram: int) -> float:
        slot, own = self.bucket(gram), self.places[k - 1][0]
        at = bisect_left(own, slot)
        return float(self.grams[k - 1][1][at]) if at < len(own) and own[at] == slot else 0.0

    def reader(self, entries: int = 100_000) -> Callable[[int], float]:
        """Probability of the last character of an n-gram of the highest order, with a bounded number of contexts and of
        shorter n-grams remembered."""
        sums = lru_cache(maxsize=entries)(self._sums)

        def interpolated(k: int, gram: int) -> float:
            p = shorter(k - 1, gram & suffix_mask(k - 1)) if k > 1 else 1.0 / ALPHABET
            found = sums(k, gram >> _BITS)
            if found is None:
                return p
            total, mass = found
            return (max(self._count(k, gram) - self.discount, 0.0) + mass * p) / total

        shorter = lru_cache(maxsize=entries)(interpolated)
        return lambda key: max(interpolated(self.order, key & suffix_mask(self.order)), 1e-30)

    def probability(self, key: int) -> float:
        """Probability of the last character of an n-gram of the highest order."""
        return self.reader()(key)
