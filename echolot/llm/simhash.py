"""SimHash fingerprints, their neighbours by sharded BK-trees, and near-duplicate groups.

Two fingerprints at distance 3 or less agree on at least two of five blocks of 12 or 13 bits, so a shard is one
value of one pair of blocks: 25 bits, which keeps shards small up to some 10**11 different fingerprints. A shard's
fingerprints form a BK-tree: children hang on edges that carry their integer distance to the parent, and a search
follows only edges whose number lies within the radius of the distance at hand. Trees meet their queries by a
shuffle and not by a broadcast, as no bound on the number of different fingerprints is known; shards beyond a fixed
size are cut, and each tree part meets every part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolot.llm.arrow import keyed_texts, map_arrow, utf8
from echolot.operators.graph import connected_components
from echolot.runtime import materialize

#: Words of a shingle, seed of its hash, greatest distance of a link.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Blocks that two linked fingerprints have in common.
COMMON = 2
#: Fingerprints that one tree holds; larger shards are cut into parts of about this size.
TREE_SIZE = 4096
#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; zero without words."""
    words = text.lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: max(0, len(words) - shingle)]]
    stops = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, stops, strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes; zero without any."""
    total, n = np.zeros(64, np.int64), len(hashes)
    for low in range(0, n, _BLOCK):
        bits = np.unpackbits(hashes[low : low + _BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number; null text has no words."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x or b"", shingle, seed) for x in utf8(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], schema=out)

    pairs = keyed_texts(docs, key, text)
    return map_arrow(pairs, run, f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, fp bigint")


class BKTree:
    """A metric tree over different 64-bit numbers under Hamming distance."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        plain = values.tolist()
        for k in range(1, len(plain)):
            node = 0
            while True:
                distance = (plain[k] ^ plain[node]).bit_count()
                below = self.children[node].get(distance)
                if below is None:
                    self.children[node][distance] = k
                    break
                node = below

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each node that some queries reach within the radius, with the indices of those queries.

        All queries go down together; at an edge only those within the radius of its number follow it.
        """
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, alive = stack.pop()
            distances = np.bitwise_count(queries[alive] ^ self.values[node]).astype(np.int16)
            hits = alive[distances <= radius]
            if len(hits):
                yield node, hits
            for edge, child in self.children[node].items():
                follow = alive[np.abs(distances - edge) <= radius]
                if len(follow):
                    stack.append((child, follow))


def spanning_links(tree_values: np.ndarray, query_values: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect what is connected, at most one fewer than there are values.

    Without `query_values` the tree is searched for its own values.
    """
    own = query_values is None
    tree = BKTree(tree_values)
    queries = tree_values if own else query_values
    shift = 0 if own else len(tree_values)
    labels = np.arange(len(tree_values) + (0 if own else len(queries)))
    links = []
    for node, hits in tree.search(queries, radius):
        found, first = np.unique(labels[hits + shift], return_index=True)
        for label, at in zip(found.tolist(), first.tolist(), strict=True):
            if label != labels[node]:
                links.append((int(tree_values[node]), int(queries[hits[at]])))
                labels[labels == label] = labels[node]
    return links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def neighbour_links(distinct: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) among different fingerprints that keep every connection at distance <= radius."""
    blocks = radius + COMMON
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    widths = [high - low for low, high in zip(bounds, bounds[1:])]
    parts_of = [F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1) for low, width in zip(bounds, widths)]

    def joint(chosen: tuple[int, ...]) -> Column:
        value = parts_of[chosen[0]]
        for i in chosen[1:]:
            value = F.shiftleft(value, widths[i]).bitwiseOR(parts_of[i])
        return value

    keys = F.array(*(F.struct(F.lit(k).alias("block"), joint(c).alias("value")) for k, c in enumerate(combinations(range(blocks), COMMON))))
    sharded = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.value")
    sizes = sharded.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tree_size).cast("int")
    cut = sharded.join(sizes, ["block", "value"]).select("fp", "block", "value", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("own"))
    cells = cut.select("fp", "block", "value", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("block", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        def links_of(rows: np.ndarray) -> list[tuple[int, int]]:
            same = rows[0, 2] == rows[0, 3]
            values = rows[:, 5].copy().view(np.uint64)
            mine = rows[:, 4] == rows[0, 2]
            return spanning_links(values if same else values[mine], None if same else values[~mine], radius)

        kept = np.zeros((0, 6), np.int64)
        for batch in batches:
            rows = np.concatenate([kept, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            links = [x for low, high in zip([0, *cuts[:-1]], cuts, strict=True) if high - low > 1 for x in links_of(rows[low:high])] if len(cuts) else []
            kept = rows[cuts[-1] :] if len(cuts) else rows
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([_signed(x[k]) for x in links], pa.int64()) for k in (0, 1)], schema=out)
        links = links_of(kept) if len(kept) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([_signed(x[k]) for x in links], pa.int64()) for k in (0, 1)], schema=out)

    dealt = cells.repartition("block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j")
    return map_arrow(dealt, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose fingerprints are linked, directly or over others, at distance <= radius.

    Every row is fingerprinted over its whole text; equal fingerprints are merged before any search, so a
    group of exact copies costs one entry. Texts without words (null, empty, white space) have fingerprint
    zero and are linked like any other. Rows that repeat a key stay as they are; null keys take part and
    count as larger than any other; other columns are ignored; an empty table gives an empty result.

    Returns doc_id, fp (signed) and component_id, the least key reachable.
    """
    marked = materialize(fingerprints(docs, shingle, seed, key, text), "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    component = connected_components(neighbour_links(distinct, radius))
    joined = distinct.join(component, distinct.fp == component.vertex, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    joined = materialize(joined, "simhash-groups")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    labels = joined.join(least, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")
