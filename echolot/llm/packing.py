"""Packing of token pieces into fixed-size sequences by patterns fitted with non-negative least squares.

Only the histogram of lengths (at most `capacity` numbers, whatever the size of the corpus) is used to
plan. The plan is a list of patterns with repeat counts; pieces find their places by their rank among
the pieces of the same length, so no piece meets another in any task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolot.llm.arrow import keyed_texts, map_arrow
from echolot.llm.tokens import CACHE_ENTRIES, WordEncoder
from echolot.runtime import materialize

#: Tokens of a sequence.
CAPACITY = 2048
#: Most pieces in an enumerated pattern.
PATTERN_PIECES = 3
#: Steps of the projected gradient.
FIT_STEPS = 300


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", entries: int = CACHE_ENTRIES) -> DataFrame:
    """Ids of every text with `end_id` appended, cut into pieces of at most `capacity` tokens.

    Null text is an empty document (one piece, the end id alone). Rows are independent, so repeated
    keys, null keys and other columns are fine. A task remembers the ids of `entries` chunks of text. Returns doc_id, piece, start, length, ids (little-endian u32).
    """

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(tokenizer_path, entries), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows, piece, start, length, ids = [], [], [], [], []
            for at in range(len(texts)):
                data = encoder.encode(texts[at].as_py()) + end
                for k, low in enumerate(range(0, len(data), step)):
                    part = data[low : low + step]
                    rows.append(at)
                    piece.append(k)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], schema=out
            )

    pairs = keyed_texts(docs, key, text)
    kind = pairs.schema["doc_id"].dataType.simpleString()
    return map_arrow(pairs, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def enumerate_patterns(present: np.ndarray, capacity: int, most: int = PATTERN_PIECES) -> np.ndarray:
    """All multisets of up to `most` (1 to 3) present lengths that fill a sequence exactly; zero stands for none."""
    here = np.zeros(capacity + 1, bool)
    here[present] = True
    rows = [np.array([[capacity, 0, 0]])] if here[capacity] else []
    if most >= 2:
        a = present[(present * 2 >= capacity) & (present < capacity)]
        a = a[here[capacity - a]]
        rows.append(np.stack([a, capacity - a, np.zeros_like(a)], 1))
    if most >= 3:
        for a in present[(present * 3 >= capacity) & (present <= capacity - 2)]:
            b = present[(present <= a) & (2 * present >= capacity - a) & (present < capacity - a)]
            b = b[here[capacity - a - b]]
            rows.append(np.stack([np.full_like(b, a), b, capacity - a - b], 1))
    rows = [x for x in rows if len(x)]
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by accelerated projected gradient.

    Errors are weighted by length, as a token left over costs the same wherever it is.
    """
    if not len(patterns):
        return np.zeros(0)
    size = len(histogram)
    weight = np.sqrt(np.arange(size) / size)
    weight[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        return weight * reduce(np.add, (np.bincount(patterns[:, j], x, size) for j in range(patterns.shape[1])))

    def backward(r: np.ndarray) -> np.ndarray:
        wr = weight * r
        return wr[patterns].sum(1)

    target = weight * histogram
    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue for the step size
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm or 1.0
    rate = 1.0 / max(norm, 1e-9)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - rate * backward(forward(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def best_fit_residual(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length on a histogram: equal bins are kept together with a count.

    Each step places as many equal pieces into equal bins as there are of the scarcer, so the number of
    steps follows the number of different lengths and bins and not the number of pieces.
    """
    room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(space: int, pieces: tuple[int, ...], n: int) -> None:
        shelf = room.setdefault(space, {})
        shelf[pieces] = shelf.get(pieces, 0) + n
        rooms[space] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                space = length + int(fits[0])
                shelf = room[space]
                pieces, bins = shelf.popitem()
                used = min(n, bins)
                if used < bins:
                    shelf[pieces] = bins - used
                if not shelf:
                    rooms[space] = False
                put(space - length, (*pieces, length), used)
                n -= used
            else:
                each = capacity // length
                bins, rest = divmod(n, each)
                if bins:
                    put(capacity - each * length, (length,) * each, bins)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                n = 0
    return [(pieces, bins) for shelf in room.values() for pieces, bins in shelf.items()]


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that use every piece of the histogram exactly once."""
    left = histogram.astype(np.int64).copy()
    chosen: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        chosen.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    patterns = enumerate_patterns(np.flatnonzero(left), capacity)
    repeats = fit_repeats(patterns, left)
    for k in np.argsort(-repeats, kind="stable"):
        n = int(repeats[k])  # rounded down; what is over goes to the residual
        if n < 1:
            break
        pieces = tuple(int(x) for x in patterns[k] if x)
        need = {x: pieces.count(x) for x in pieces}
        n = min(n, *(int(left[x]) // c for x, c in need.items()))
        if n:
            chosen.append((pieces, n))
            for x, c in need.items():
                left[x] -= c * n
    return chosen + best_fit_residual(left, capacity)


def _places(chosen: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Slots as a table sorted by length and first rank: ranks first.. go to sequences base.. at one offset."""
    rows, base = [], 0
    taken = np.zeros(capacity + 1, np.int64)
    for pieces, n in chosen:
        at = 0
        for length in pieces:
            rows.append((length, taken[length], base, at))
            taken[length] += n
            at += length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    starts = np.searchsorted(table[:, 0], np.arange(capacity + 2))
    return {"first": table[:, 1].copy(), "base": table[:, 2].copy(), "offset": table[:, 3].copy(), "starts": starts}


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces so that each sequence holds at most `capacity` tokens.

    Lengths must lie in 1..capacity (an error otherwise; null lengths too). The input is written once, and again with
    its partition number, so ranks inside a length are offsets of partitions plus places inside them: a
    length that a third of all pieces share stays spread over all tasks. The driver sees the histogram only.
    Columns of the input stay as they are, whatever their names, but those named sequence_id or offset, which are
    replaced; equal pieces are all packed; an empty table gives an empty result.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    wrapped = materialize(pieces.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{length}`").alias("size")), "lengths")  # so that no task runs two Python workers

    def number(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            column = batch.column(1)
            sizes = column.to_numpy(zero_copy_only=False)
            if column.null_count or len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
                raise ValueError(f"lengths must lie in 1..{capacity}")
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            first = np.searchsorted(ordered, ordered)
            ranks = np.empty(len(sizes), np.int64)
            ranks[order] = np.arange(len(sizes)) - first
            ranks += seen[sizes]
            seen += np.bincount(sizes, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(ranks)], schema=out)

    own = wrapped.schema.fields
    numbered = T.StructType([*own, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])
    stored = materialize(map_arrow(wrapped, number, numbered), "pieces")
    counts = stored.groupBy("part", "size").agg(F.count("*").alias("n"))
    total = counts.groupBy("size").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for row in total:
        histogram[row[0]] = row[1]
    places = _places(plan(histogram, capacity), capacity)
    before = counts.select("part", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))
    ranked = stored.join(before, ["part", "size"]).select("row", "size", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        first, base, offset, starts = (places[k] for k in ("first", "base", "offset", "starts"))
        span = int(histogram.max()) + 1
        low = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        joint = low * span + first  # ascending, as slots are sorted by length and rank
        for batch in batches:
            sizes = batch.column(1).to_numpy().astype(np.int64)
            ranks = batch.column(2).to_numpy()
            slot = np.searchsorted(joint, sizes * span + ranks, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base[slot] + ranks - first[slot]), pa.array(offset[slot])], schema=out)

    placed = map_arrow(ranked, place, T.StructType([own[0], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return placed.select(*(F.col("row").getField(c).alias(c) for c in kept), "sequence_id", "offset")
