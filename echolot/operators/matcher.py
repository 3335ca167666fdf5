"""The similar pass: inverted index, votes for offsets, verification, shape pass and groups.

Fingerprint tables have idx (file order), values (32-bit numbers as bigint), shape (bytes), flux and
duration (content seconds, null where unknown).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolot.functions import arrays, voting
from echolot.operators.graph import connected_components
from echolot.options import MatchOptions
from echolot.runtime import materialize

#: Entries of the index, or files with shapes, in a block (about), and blocks from an eighth of that on. A task compares two blocks.
BLOCK_ENTRIES, BLOCK_SHAPES, BLOCKS = 9_000_000, 100_000, 3
#: Rows of an Arrow batch, as prints may be long.
BATCH_ROWS = 500


def usable(fps: DataFrame, options: MatchOptions) -> DataFrame:
    return fps.where(F.size("values") >= options.min_frames)


def stationary(fps: DataFrame, options: MatchOptions) -> DataFrame:
    return usable(fps, options).where(F.col("flux") < options.stationary_flux)


def file_lengths(fps: DataFrame, options: MatchOptions) -> DataFrame:
    """Content seconds, or those that the fingerprint spans."""
    return fps.withColumn("seconds", F.coalesce("duration", F.size("values") * options.seconds_per_frame))


def postings(fps: DataFrame, options: MatchOptions) -> DataFrame:
    """(key, idx, pos): two halves of every indexed value, or of it and the next indexed one with `joint_keys`."""
    if options.joint_keys:
        following = F.transform("values", lambda v, i: F.struct(v.alias("v"), F.get("values", i + options.index_stride).alias("w")))
        placed = fps.select("idx", F.posexplode(following).alias("pos", "p")).where((F.col("pos") % options.index_stride == 0) & F.col("p.w").isNotNull())
        return placed.select("idx", "pos", F.explode(arrays.joint_halves(F.col("p.v"), F.col("p.w"))).alias("key"))
    placed = fps.select("idx", F.posexplode("values").alias("pos", "value")).where(F.col("pos") % options.index_stride == 0)
    return placed.select("idx", "pos", F.explode(arrays.key_halves(F.col("value"))).alias("key"))


def index_entries(entries: DataFrame, options: MatchOptions) -> DataFrame:
    """Entries of keys that occur often enough to pair and seldom enough to mean something.

    The bound on a key's entries is part of the matching rule. It also bounds the pairs of a key.
    """
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, options.max_entries_per_key))
    return entries.join(sizes.select("key"), "key", "left_semi")


def votes(entries: DataFrame) -> DataFrame:
    """(a, b, off, n): pairs of files by offset."""
    left = entries.select("key", F.col("idx").alias("a"), F.col("pos").alias("pa"))
    right = entries.select("key", F.col("idx").alias("b"), F.col("pos").alias("pb"))
    return left.join(right, "key").where("a < b").groupBy("a", "b", (F.col("pa") - F.col("pb")).cast("bigint").alias("off")).agg(F.count("*").alias("n"))


def voted(fps: DataFrame, options: MatchOptions) -> DataFrame:
    """Votes of fingerprints by a join, for joint keys. The entries are stored once, as both sides of the join read them."""
    return votes(materialize(index_entries(postings(fps, options), options), "entries"))


def best_offsets(voted: DataFrame, options: MatchOptions) -> DataFrame:
    """The offset with most votes for each pair, the smallest on ties."""
    top = voted.groupBy("a", "b").agg(F.max(F.struct("n", (-F.col("off")).alias("neg"))).alias("m"))
    return top.select("a", "b", (-F.col("m.neg")).alias("off"), F.col("m.n").alias("n")).where(F.col("n") >= options.min_votes)


def aligned(pairs: DataFrame, fps: DataFrame, options: MatchOptions) -> DataFrame:
    """Pairs with overlap, bit_errors, ber and what the gates need."""
    side = file_lengths(fps, options).select("idx", "values", "flux", "seconds")
    left = side.select(*(F.col(c).alias(f"{c}_a") for c in side.columns)).withColumnRenamed("idx_a", "a")
    right = side.select(*(F.col(c).alias(f"{c}_b") for c in side.columns)).withColumnRenamed("idx_b", "b")
    both = pairs.join(left, "a").join(right, "b")
    laid = both.withColumn("overlap", arrays.overlap(F.col("values_a"), F.col("values_b"), F.col("off")))
    counted = laid.withColumn("errors", arrays.bit_errors(F.col("values_a"), F.col("values_b"), F.col("off"), F.col("overlap")))
    return counted.withColumn("ber", arrays.bit_error_rate(F.col("errors"), F.col("overlap"))).withColumn("frames_a", F.size("values_a").cast("bigint")).withColumn("frames_b", F.size("values_b").cast("bigint"))


def _blocks(size: int, most: int) -> int:
    return 1 if size < most // 8 else max(BLOCKS, -(-size // most))


def _cells(blocks: int) -> int:
    return blocks * (blocks + 1) // 2


def _block(idx: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(idx), F.lit(blocks)).cast("int")


def _cell(low: Column, high: Column, blocks: int) -> Column:
    """Number of the cell in which two blocks meet."""
    return F.floor(low * blocks - low * (low - 1) / 2 + high - low).cast("int")


def _met(rows: DataFrame, blocks: int) -> DataFrame:
    """`rows` once for each cell that their block takes part in; `side` is 0 and 1 for two blocks, 2 where one is alone."""
    placed = rows.where("idx IS NOT NULL").withColumn("block", _block("idx", blocks))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.select(*rows.columns, F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"), _cell(F.least("block", "other"), F.greatest("block", "other"), blocks).alias("cell"))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """`rows` with `side`, a partition for every two blocks and for each block alone."""
    return _met(rows, blocks).repartitionById(_cells(blocks), "cell").drop("cell")


def _kept_keys(fps: DataFrame, options: MatchOptions) -> tuple[np.ndarray, int]:
    """Which keys have entries that count, and the number of these."""
    sizes = postings(fps, options).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, options.max_entries_per_key))
    found = sizes.toArrow()  # at most voting.KEYS rows
    kept = np.zeros(voting.KEYS, bool)
    kept[found["key"].to_numpy()] = True
    return kept, int(found["n"].to_numpy().sum())


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _prints(batches: list[pa.RecordBatch]) -> voting.Prints:
    values: list[np.ndarray] = []
    for column in (b.column(1) for b in batches):
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] // 4
        data = np.frombuffer(data, np.uint32, bounds[-1])
        values += [data[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
    return voting.Prints(np.concatenate([b.column(0).to_numpy() for b in batches]), values)


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS at most; workers give their free memory back at the end of a task."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "0")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return df.mapInArrow(run, schema)


def _compared(fps: DataFrame, options: MatchOptions, least: int, compare, schema: str) -> DataFrame:
    """`compare(x, y, found, scalars)` over every two blocks of prints; y is x for one block, `found` are voting.pair_votes,
    `scalars` flux and seconds of the rows of both.

    The index isn't joined with itself: prints with a kept key are packed and dealt by blocks, and a task counts the
    votes of its pairs, which never leave it.
    """
    kept, size = _kept_keys(fps, options)
    bits, stride = np.packbits(kept), options.index_stride

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(bits).astype(bool)
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            columns = [batch.column(0), _binary(values, bounds), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["idx", "values", "flux", "seconds"]).filter(pa.array(voting.has_kept(values, bounds, kept, stride)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.unpackbits(bits).astype(bool)
        held: list[list[pa.RecordBatch]] = [[], []]
        for batch in batches:
            for side, mask in enumerate((pc.not_equal(batch.column(4), 1), pc.equal(batch.column(4), 1))):
                if (part := batch.filter(mask)).num_rows:
                    held[side].append(part)
        if not held[0] or not held[1] and held[0][0].column(4)[0].as_py() != 2:  # a block without prints
            return
        x = _prints(held[0])
        y = _prints(held[1]) if held[1] else None
        scalars = [[pa.chunked_array([b.column(k) for b in side]).combine_chunks() if side else None for k in (2, 3)] for side in held]
        scalars = [[c.take(pa.array(p.order)) for c in columns] if p else None for columns, p in zip(scalars, (x, y), strict=True)]
        held.clear()
        for found in voting.pair_votes(x, y, kept, stride, least):
            yield from compare(x, y or x, found, (scalars[0], scalars[1] or scalars[0]))

    side = file_lengths(fps, options).select("idx", "values", F.col("flux").cast("double").alias("flux"), F.col("seconds").cast("double").alias("seconds"))
    packed = _mapped(side.where("idx IS NOT NULL"), pack, "idx bigint, values binary, flux double, seconds double")
    return _mapped(_dealt(packed, _blocks(size, BLOCK_ENTRIES)), run, schema)


def pair_votes(fps: DataFrame, options: MatchOptions, least: int = 1) -> DataFrame:
    """(a, b, off, n, votes, offsets): pairs of files with `least` votes for one offset; the offset with most votes, the smallest on
    ties, and its votes; all the votes and offsets, of those that have `least` votes."""
    if options.joint_keys:
        counted = voted(fps, options).where(F.col("n") >= least).groupBy("a", "b")
        top = counted.agg(F.max(F.struct("n", (-F.col("off")).alias("neg"))).alias("m"), F.sum("n").alias("votes"), F.count("*").alias("offsets"))
        return top.select("a", "b", (-F.col("m.neg")).alias("off"), F.col("m.n").alias("n"), "votes", "offsets")

    def compare(x: voting.Prints, y: voting.Prints, found: tuple, _) -> Iterator[pa.RecordBatch]:
        one, other, step, votes, offsets, most = found
        a, b = x.files[one], y.files[other]
        columns = [np.minimum(a, b), np.maximum(a, b), np.where(a < b, step, -step), most, votes, offsets]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in columns], names=["a", "b", "off", "n", "votes", "offsets"])

    return _compared(fps, options, least, compare, "a bigint, b bigint, off bigint, n bigint, votes bigint, offsets bigint")


def matched(fps: DataFrame, options: MatchOptions) -> DataFrame:
    """Pairs (a, b, off, n) with enough votes, and what `aligned` adds but the values."""
    if options.joint_keys:
        return aligned(best_offsets(voted(fps, options), options), fps, options).drop("values_a", "values_b")
    names = ["a", "b", "off", "n", "overlap", "errors", "frames_a", "frames_b", "flux_a", "flux_b", "seconds_a", "seconds_b"]

    def compare(x: voting.Prints, y: voting.Prints, found: tuple, scalars: tuple) -> Iterator[pa.RecordBatch]:
        pair, one, other = voting.rows_of(x, y, found[0], found[1])
        step = found[2][pair]
        overlap, errors = voting.bit_errors(x, y, one, other, step)
        turned = x.idx[one] > y.idx[other]
        turn = lambda p, q: (np.where(turned, q, p), np.where(turned, p, q))
        columns = [*turn(x.idx[one], y.idx[other]), np.where(turned, -step, step), found[5][pair], overlap, errors, *turn(x.sizes[one], y.sizes[other])]
        columns = [pa.array(c.astype(np.int64, copy=False)) for c in columns]
        for p, q in zip(*scalars, strict=True):
            p, q = p.take(pa.array(one)), q.take(pa.array(other))
            columns += [pc.if_else(pa.array(turned), q, p), pc.if_else(pa.array(turned), p, q)]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{c} {'double' if c[:4] in ('flux', 'seco') else 'bigint'}" for c in names)
    return _compared(fps, options, options.min_votes, compare, schema).withColumn("ber", arrays.bit_error_rate(F.col("errors"), F.col("overlap")))


def lengths_allow(options: MatchOptions):
    """Two stationary recordings must be of about the same length."""
    both = (F.col("flux_a") < options.stationary_flux) & (F.col("flux_b") < options.stationary_flux)
    longer = F.greatest("seconds_a", "seconds_b")
    near = F.abs(F.col("seconds_a") - F.col("seconds_b")) <= F.greatest(F.lit(options.min_length_difference), longer * options.stationary_tolerance)
    return ~both | near


def temporal_edges(checked: DataFrame, options: MatchOptions) -> DataFrame:
    """(a, b, score) of pairs that pass the gates."""
    if options.whole_file:
        share = F.col("overlap") >= F.greatest("frames_a", "frames_b") * options.whole_fraction
    else:
        share = F.col("overlap") >= F.least("frames_a", "frames_b") * options.part_fraction
    long_enough = F.col("overlap") * options.seconds_per_frame >= options.min_overlap_seconds
    kept = checked.where(lengths_allow(options) & share & long_enough & (F.col("ber") <= options.max_bit_error))
    return kept.select("a", "b", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("ber") / 0.5)).alias("score"))


def shape_edges(fps: DataFrame, options: MatchOptions) -> DataFrame:
    """Pairs of stationary recordings with like spectral shapes."""
    none = fps.sparkSession.createDataFrame([], "a bigint, b bigint, score double")
    return _with_shape_edges(none, fps, options)


def _scores(distance: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.minimum(1.0, 1 - distance / 0.6))


def _with_shape_edges(temporal: DataFrame, fps: DataFrame, options: MatchOptions) -> DataFrame:
    """(a, b, score) of these links and of like spectral shapes, with the better of two scores.

    Blocks of stationary recordings meet in tasks, which compare those whose lengths the gate allows. Links that are known
    go to the task that compares their blocks, so that only links leave tasks and none of them is shuffled.
    """
    side = file_lengths(stationary(fps, options), options).select("idx", F.col("seconds").cast("double").alias("seconds"), F.col("shape").cast("array<smallint>").alias("shape")).where("shape IS NOT NULL")
    limits = options.min_length_difference, options.stationary_tolerance, options.max_shape_distance

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], []
        for batch in batches:
            link = pc.is_valid(batch.column("b"))
            if (part := batch.filter(link)).num_rows:
                known.append([part.column(c).to_numpy() for c in ("idx", "b", "score")])
            if (part := batch.filter(pc.invert(link))).num_rows:
                held.append(part)
        a, b, score = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        a, b, score = _best_links(a, b, score)
        left = np.ones(len(a), bool)
        found = _like_shapes(held, limits)
        if held and len(ids := np.concatenate([x.column("idx").to_numpy() for x in held])) > len(np.unique(ids)):  # rows of one file
            found = [_best_links(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        del held
        for p, q, own in found:
            if len(a):
                at = voting.places(a, b, p, q)
                hit = at >= 0
                own[hit] = np.maximum(own[hit], score[at[hit]])
                left[at[hit]] = False
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, q, own)], names=["a", "b", "score"])
        yield pa.RecordBatch.from_arrays([pa.array(c[left]) for c in (a, b, score)], names=["a", "b", "score"])

    blocks = _blocks(side.count(), BLOCK_SHAPES)
    none = {"seconds": "double", "shape": "array<smallint>", "b": "bigint", "score": "double"}
    columns = ["idx", "seconds", "shape", "b", "score"]
    shapes = _met(side, blocks).select(*columns[:3], *(F.lit(None).cast(none[c]).alias(c) for c in columns[3:]), "side", "cell")
    one, other = (_block(c, blocks) for c in ("a", "b"))
    links = temporal.select(F.col("a").alias("idx"), *(F.lit(None).cast(none[c]).alias(c) for c in columns[1:3]), "b", "score", F.lit(2).alias("side"), _cell(F.least(one, other), F.greatest(one, other), blocks).alias("cell"))
    return _mapped(shapes.unionByName(links).repartitionById(_cells(blocks), "cell").drop("cell"), run, "a bigint, b bigint, score double")


def _like_shapes(held: list[pa.RecordBatch], limits: tuple[float, float, float]) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, score) of batches (idx, seconds, shape, side)."""
    if not held:
        return
    idx, seconds, side = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("idx", "seconds", "side"))
    sizes = np.concatenate([x.column("shape").value_lengths().to_numpy(zero_copy_only=False) for x in held]).astype(np.int64)
    shapes = np.zeros((len(idx), sizes.max()), np.int16)
    shapes[np.arange(sizes.max()) < sizes[:, None]] = np.concatenate([x.column("shape").flatten().to_numpy(zero_copy_only=False) for x in held])
    for a, b, distance in voting.shape_pairs(idx, seconds, shapes, sizes, side, *limits):
        yield a, b, _scores(distance)


def _best_links(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with its best score, in order."""
    by = np.lexsort((-score, b, a))
    a, b, score = a[by], b[by], score[by]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], score[first]


def match_edges(fps: DataFrame, options: MatchOptions) -> DataFrame:
    """All links with the better of their two scores."""
    return _with_shape_edges(temporal_edges(matched(usable(fps, options), options), options), fps, options)


def groups_of(edges: DataFrame) -> DataFrame:
    """(rep, idx, confidence): connected files; the confidence is the weakest direct link of the group."""
    labels = connected_components(edges.select("a", "b"))
    weakest = edges.join(labels, edges.a == labels.vertex).groupBy("component").agg(F.min("score").alias("confidence"))
    return labels.join(weakest, "component").select(F.col("component").alias("rep"), F.col("vertex").alias("idx"), "confidence")


def match_groups(fps: DataFrame, options: MatchOptions) -> DataFrame:
    return groups_of(match_edges(fps, options))
