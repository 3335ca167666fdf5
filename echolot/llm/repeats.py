"""Repeated passages: seeds by winnowing, extension both ways to maximal repeats, removal of later copies.

A window of `length` words picks one seed: the shingle of `seed` words with the least hash, the leftmost
on ties. The choice depends on the window's content alone, so equal windows have equal seeds at equal
places. Consecutive windows with the same seed occurrence form one stretch: the seed extended to the left
and right as far as it stays the seed. Occurrences are joined on the seed and compared by the whole stretch
(seed and content are told apart by 64-bit hashes each, 128 bits together); where whole stretches are equal the
first stays and the others are repeats as they are, and only where stretches of one seed differ (at the ends of
repeats) are single windows compared. Overlapping repeats then merge into maximal ones.

Identical stretches inside one chunk of input meet before the shuffle: all but the first are repeats for
certain and travel by their document, so a passage that many documents share sends one row for each chunk
to the task that compares it, and not one for each document. A seed that stands in many contexts (a common
phrase) is dealt by its contents, so its occurrences don't meet in one task either.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolot.llm.arrow import keyed_texts, map_arrow, utf8
from echolot.llm.joins import narrow_side
from echolot.llm.words import hash_words, mix, sliding
from echolot.runtime import materialize

#: Words of a window, words of a seed.
LENGTH, SEED_WORDS = 20, 8
#: Bytes of text whose stretches are merged before the shuffle.
CHUNK_BYTES = 32 << 20
#: Rows up to which differing stretches are sent to all executors (about 64 MB); beyond that they are shuffled.
BROADCAST_ROWS = 1_000_000

_NULL_KEY = -(1 << 63)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def stretches(hashes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(seed hash, content hash, first window, windows) of every stretch of a document."""
    seeds, windows = sliding(hashes, seed, 1), sliding(hashes, length, 2)
    n = len(windows)
    at = np.lib.stride_tricks.sliding_window_view(seeds, length - seed + 1).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    inside = (np.arange(n) - np.repeat(first, count)).astype(np.uint64)
    content = mix(np.add.reduceat(mix(windows + inside * _STEP), first) + count.astype(np.uint64))
    return seeds[at[first]], content, first, count


def _merge_equal(seed: np.ndarray, content: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, out: pa.Schema) -> pa.RecordBatch:
    """The first occurrence of each (seed, content) as it is, the others without a seed.

    Rows that repeat a document give the same occurrence several times; it stays once.
    """
    order = np.lexsort((start, row, doc, content, seed))
    seed, content, doc, row, start, count = (x[order] for x in (seed, content, doc, row, start, count))
    later = np.zeros(len(seed), bool)
    later[1:] = (seed[1:] == seed[:-1]) & (content[1:] == content[:-1])
    again = np.zeros(len(seed), bool)
    again[1:] = later[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1])
    later, seed, content, doc, row, start, count = (x[~again] for x in (later, seed, content, doc, row, start, count))
    columns = [pa.array(seed.view(np.int64), mask=later), pa.array(content.view(np.int64), mask=later), *map(pa.array, (doc, row, start, count))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)


_ROWS = "seed bigint, content bigint, doc bigint, row bigint, start int, n int"


def _occurrences(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """Stretches of all documents (doc, row, text), equal ones merged within chunks."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            doc, row = (batch.column(k).to_numpy() for k in (0, 1))
            hashes, bounds = hash_words(batch.column(2))
            for at in np.flatnonzero(np.diff(bounds) >= length).tolist():
                found = stretches(hashes[bounds[at] : bounds[at + 1]], length, seed)
                parts.append((found[0], found[1], np.full(len(found[0]), doc[at]), np.full(len(found[0]), row[at]), found[2], found[3]))
            size += batch.column(2).nbytes
            if size >= CHUNK_BYTES and parts:
                yield _merge_equal(*(np.concatenate(x) for x in zip(*parts, strict=True)), out)
                parts, size = [], 0
        if parts:
            yield _merge_equal(*(np.concatenate(x) for x in zip(*parts, strict=True)), out)

    return map_arrow(docs.select("doc", "row", "text"), run, _ROWS)


def _single_windows(located: DataFrame, length: int) -> DataFrame:
    """The windows of the stretches in `found` (seed, start, n) of each document, as stretches of one window."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            lists = batch.column(3)
            stretch, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            seeds, starts, counts = (stretch.field(k).to_numpy() for k in range(3))
            doc, row = (batch.column(k).to_numpy() for k in (0, 1))
            hashes, bounds = hash_words(batch.column(2))
            for at in range(batch.num_rows):
                windows = sliding(hashes[bounds[at] : bounds[at + 1]], length, 2)
                own = slice(ends[at], ends[at + 1])
                n = counts[own].astype(np.int64)
                where = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                parts.append((windows[where], np.repeat(seeds[own], n).view(np.uint64), np.full(len(where), doc[at]), np.full(len(where), row[at]), where, np.ones(len(where), np.int64)))
            if parts:
                yield _merge_equal(*(np.concatenate(x) for x in zip(*parts, strict=True)), out)

    return map_arrow(located, run, _ROWS)


def _later_copies(occurrences: DataFrame) -> DataFrame:
    """Ranges (seed, doc, row, start, n): all occurrences but the first of each (seed, content), with seed null,
    and these first ones with their seed.

    Rows come sorted, so a task keeps only the occurrence at hand. The same occurrence from several chunks
    (rows that repeat a document) counts once.
    """

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            certain = batch.column(0).is_null().to_numpy(zero_copy_only=False)  # repeats for certain; they come first
            columns = [c.fill_null(0).to_numpy() for c in batch.columns[:5]]
            before = [np.concatenate([[x[0] if last is None else v], x[:-1]]) for x, v in zip(columns, last or [0] * 5, strict=True)]
            same = [x == y for x, y in zip(columns, before, strict=True)]
            known = same[0] & same[1] & ~np.concatenate([[last is None or last_certain], certain[:-1]])
            again = known & same[2] & same[3] & same[4] & ~certain
            if last is None:
                again[0] = False
            last, last_certain = [x[-1] for x in columns], bool(certain[-1])
            seed = pa.array(columns[0], mask=known | certain)
            stays = pa.array(~again)
            yield pa.RecordBatch.from_arrays([c.filter(stays) for c in (seed, *batch.columns[2:])], schema=out)

    dealt = occurrences.repartition(F.coalesce("seed", "doc"), F.coalesce("content", "start")).sortWithinPartitions("seed", "content", "doc", "row", "start")
    return map_arrow(dealt, run, "seed bigint, doc bigint, row bigint, start int, n int")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """(doc, row, start, n): n consecutive windows from word `start` that also start earlier; input is (doc, row, text)."""
    coarse = materialize(_later_copies(_occurrences(docs, length, seed)), "repeats")
    firsts = coarse.where("seed IS NOT NULL")
    several = firsts.groupBy("seed").agg(F.count("*").alias("contents")).where("contents > 1").select("seed")
    mixed = materialize(firsts.join(narrow_side(several, "several"), "seed", "left_semi"), "mixed")
    by_doc = mixed.groupBy("doc", "row").agg(F.collect_list(F.struct("seed", "start", "n")).alias("found"))  # stretches of one text
    small = mixed.count() <= BROADCAST_ROWS
    located = docs.join(F.broadcast(by_doc) if small else by_doc, ["doc", "row"]).select("doc", "row", "text", "found")
    fine = _later_copies(_single_windows(located, length))
    ranges = ["doc", "row", "start", "n"]
    return coarse.where("seed IS NULL").select(*ranges).union(fine.where("seed IS NULL").select(*ranges))


def _told_apart(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, row, text): row is 0, or a hash of the text where rows of one key have different texts."""
    hashed = keyed_texts(docs, key, text).select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_KEY)).alias("doc"), "text", F.xxhash64("text").alias("h"))
    repeated = hashed.groupBy("doc").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("doc", F.lit(True).alias("several"))
    marked = hashed.join(narrow_side(repeated, "repeated-keys"), "doc", "left")
    return marked.select("doc", F.when(F.col("several"), F.col("h")).otherwise(F.lit(0).cast("bigint")).alias("row"), "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop every word covered by a window of `length` words that also starts earlier.

    Earlier means a smaller key, or the same document and an earlier start; windows are judged on the input.
    Words are `[^\\x20\\x09-\\x0D]+`. Null text has no words; texts under `length` words lose none; long texts are
    read whole. The key must be an integer; null keys come before all others. Equal rows are one document. Rows of
    one key with different texts are documents of their own, in order of a hash of their texts, so what is found
    in one of them isn't removed from another. Other columns are ignored; an empty table gives an empty result.

    Returns doc_id, n_words, n_removed, kept (the words left, joined by one space).
    """
    source = _told_apart(docs, key, text)
    ranges = repeated_ranges(source.where("text IS NOT NULL"), length, seed)
    by_doc = ranges.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))  # ranges of one text
    joined = source.join(by_doc, ["doc", "row"], "left").select("doc", "text", "ranges")

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            lists = batch.column(2)
            flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            start, n = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
            for at, content in enumerate(utf8(batch.column(1))):
                words = (content or b"").split()
                own = slice(bounds[at], bounds[at + 1])
                if sizes[at]:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, np.minimum(start[own], len(words)), 1)
                    np.add.at(change, np.minimum(start[own] + n[own] + length - 1, len(words)), -1)
                    stays = np.cumsum(change)[:-1] == 0
                    left = list(compress(words, stays))
                else:
                    left = words
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            key_column = batch.column(0)
            yield pa.RecordBatch.from_arrays([key_column, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=out)

    done = map_arrow(joined, run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(_NULL_KEY)))
