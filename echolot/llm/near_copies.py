"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a given share.

SimHash proposes most links: fingerprints over the same shingles meet in BK-trees, and every pair within the
radius is checked by whole sets. Since fingerprints of texts at the least similarity differ in about ten bits, too
many for trees over blocks, the rest is found by prefix filtering: two sets that similar share one of their
first shingles under any common order, so texts that share such a shingle are candidates. The order puts
shingles that are frequent in a sample last; it decides how many candidates there are and never the result. A
group of texts with one shingle is first compared with a single member; only pairs that are still apart are then
compared with each other, behind lengths and parity bits, which exclude pairs for certain.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolot.llm import simhash
from echolot.llm.arrow import keyed_texts, map_arrow
from echolot.llm.joins import narrow_side
from echolot.llm.words import hash_words, sliding
from echolot.operators.graph import connected_components
from echolot.runtime import materialize, release

#: Words of a shingle, least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Texts (about) whose shingles are counted for the order, count from which one is frequent, frequent ones at most.
ORDER_ROWS, FREQUENT, FREQUENT_ROWS = 5_000, 5, 200_000
#: Parity bits of a set; texts that a task remembers, so as to describe equal ones once.
BITS, SEEN_TEXTS = 512, 300_000
#: Parity bits of the sets of candidates, compared before whole sets; rows of them sent to all executors (about 20 MB).
WIDE_BITS, WIDE_ROWS = 8192, 20_000
#: Rows that are hashed at a time.
SLICE = 100
#: Entries of prefixes that a task sends at a time, and that one merges at a time (about, 21 bytes each).
PACK_KEYS, SLICE_KEYS = 400_000, 400_000
#: Binary logarithm of the most bits of the filter by which tasks recognise shared shingles (8 MB).
FILTER_BITS = 26

_ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("n", "<i4"), ("many", "?")])


def _shingles(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of each row's word shingles, repeats included; a shorter text is one shingle."""
    hashes, bounds = hash_words(column, lower=True)
    wide = sliding(hashes, shingle, 100 + shingle)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        width = min(shingle, high - low)
        yield wide[low : high - shingle + 1] if width == shingle else sliding(hashes[low:high], width, 100 + width) if width else hashes[:0]


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted different hashes of each text's word shingles."""
    return [np.unique(x) for x in _shingles(pa.array(texts, pa.string()), shingle)]


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            yield batch.slice(low, SLICE)


def _frequent(source: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample (by hash, so the same in any layout), sorted, with their counts."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            keys, n = np.unique(np.concatenate([np.unique(x) for x in _shingles(part.column(0), shingle)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], schema=out)

    share = min(1.0, ORDER_ROWS / max(1, source.count()))
    sample = source.where(F.pmod(F.xxhash64("doc_id", "id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    counted = map_arrow(sample, run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "key").limit(FREQUENT_ROWS).toArrow()
    keys, n = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    by = np.argsort(keys)
    return keys[by], n[by]


def _parity(own: np.ndarray, size: int) -> bytes:
    """For each of `size` classes of shingles whether their number is odd."""
    return np.packbits(np.bincount((own % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def _described(source: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, id, n, fp, bits, prefix): size of the set, fingerprint, parity bits and the first shingles of each
    row's set, as many as its size and the similarity ask for. A task describes a text only once; the copies' columns are null."""
    shared = source.sparkSession.sparkContext.broadcast(_frequent(source, shingle))  # at most FREQUENT_ROWS pairs

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        seen: set[int] = set()
        for part in _slices(batches):
            ids = part.column(1).to_pylist()
            fresh = []
            for x in ids:
                fresh.append(x not in seen)
                seen.add(x)
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            rows: list[tuple] = [(None, None, None, None)] * len(ids)
            new = [at for at, f in enumerate(fresh) if f]
            for at, found in zip(new, _shingles(part.column(2).filter(pa.array(fresh)), shingle), strict=True):
                own = np.unique(found)
                first = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
                order = own
                if len(frequent) and len(own):
                    there = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    order = own[np.argsort(np.where(frequent[there] == own, counts[there], 0), kind="stable")]
                rows[at] = (len(own), simhash._signed(simhash.majority(found)), _parity(own, BITS), order[:first].tobytes())
            columns = [pa.array([r[k] for r in rows], out.field(k + 2).type) for k in range(4)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema=out)

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source.select("doc_id", "id", "text"), run, f"doc_id {kind}, id bigint, n int, fp bigint, bits binary, prefix binary")


def _spread(batch: pa.RecordBatch) -> np.ndarray:
    """Entries (key, id, n) for each shingle of the prefixes of a batch (id, n, prefix)."""
    prefixes = batch.column(2).to_pylist()
    sizes = [len(x) // 8 for x in prefixes]
    out = np.zeros(sum(sizes), _ENTRY)
    out["key"] = np.frombuffer(b"".join(prefixes), np.uint64)
    for name, k in (("id", 0), ("n", 1)):
        out[name] = np.repeat(batch.column(k).to_numpy(), sizes)
    return out


def _first_by_key(entries: np.ndarray) -> np.ndarray:
    """One entry for each key, the one with the least id; `many` says whether it stands for several ids."""
    entries = entries[np.lexsort((entries["id"], entries["key"]))]
    first = np.flatnonzero(np.concatenate([[True], entries["key"][1:] != entries["key"][:-1]])) if len(entries) else np.zeros(0, np.int64)
    if not len(first):
        return entries
    out = entries[first]
    last = np.append(first[1:], len(entries)) - 1
    out["many"] = np.logical_or.reduceat(entries["many"], first) | (entries["id"][last] != out["id"])
    return out


def _shared_keys(described: DataFrame) -> DataFrame:
    """(key, hub, m): shingles in the prefixes of several texts, with the least of their ids and the size of its set.

    Tasks reduce their entries to one for each key, so a shingle of many texts costs an entry a task, and send them in
    packs by slices of the keys; the number of slices grows with the table.
    """
    total = described.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    slices = max(1, int(np.ceil(total / SLICE_KEYS)))

    def pack(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            entries = _first_by_key(np.concatenate(held))
            own = entries["key"] % np.uint64(slices)
            entries = entries[np.argsort(own, kind="stable")]
            found, starts = np.unique(np.sort(own), return_index=True)
            packs = [entries[x:y].tobytes() for x, y in zip(starts, np.append(starts[1:], len(entries)))]
            for low in range(0, len(packs), 16):
                yield pa.RecordBatch.from_arrays([pa.array(found[low : low + 16].astype(np.int64)), pa.array(packs[low : low + 16], pa.binary())], schema=out)

        for batch in batches:
            held.append(_spread(batch))
            if sum(map(len, held)) > PACK_KEYS:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    def merge(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            entries = _first_by_key(np.concatenate(held)) if held else np.zeros(0, _ENTRY)
            entries = entries[entries["many"]]
            yield pa.RecordBatch.from_arrays([pa.array(entries["key"].astype(np.uint64).view(np.int64)), pa.array(entries["id"].copy()), pa.array(entries["n"].copy())], schema=out)

        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != at:
                    yield from close()
                    at, held = own, []
                held.append(np.frombuffer(packed.as_py(), _ENTRY))
                if sum(map(len, held)) > 4 * SLICE_KEYS:
                    held = [_first_by_key(np.concatenate(held))]
        yield from close()

    packs = map_arrow(described.where("n > 0").select("id", "n", "prefix"), pack, "slice bigint, pack binary")
    return map_arrow(packs.repartition("slice").sortWithinPartitions("slice"), merge, "key bigint, hub bigint, m int")


def _key_filter(hubs: DataFrame) -> np.ndarray:
    """A bitmap of keys by their lowest bits; its size follows the number of keys up to a fixed bound, beyond which it only lets more of the other keys pass."""
    size = min(FILTER_BITS, max(16, (8 * hubs.count()).bit_length()))
    slot = F.col("key").bitwiseAND(F.lit((1 << size) - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    words = hubs.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2 ** FILTER_BITS / 64 rows
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _shared_entries(described: DataFrame, hubs: DataFrame) -> DataFrame:
    """(key, id, n, hub, m): the entries of prefixes whose key is shared. Most others don't leave their task."""
    prefixes = described.where("n > 0").select("id", "n", "prefix")
    shared = prefixes.sparkSession.sparkContext.broadcast(_key_filter(hubs))

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            entries = _spread(batch)
            slot = entries["key"] & np.uint64(64 * len(words) - 1)
            entries = entries[words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) == 1]
            columns = [np.ascontiguousarray(entries[c]) for c in ("key", "id", "n")]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], schema=out)

    return map_arrow(prefixes, run, "key bigint, id bigint, n int").join(hubs, "key").select("key", "id", "n", "hub", "m")


def _sets(source: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) of the texts (id) in these documents (first); rows that repeat a document repeat its set."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = [np.unique(x).tobytes() for x in _shingles(part.column(1), shingle)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], schema=out)

    wanted = source.alias("s").join(firsts.alias("f"), F.expr("s.id = f.id AND s.doc_id <=> f.first"), "left_semi").select("id", "text")
    return map_arrow(wanted, run, "id bigint, hashes binary")


def _sizes_allow(similarity: float) -> F.Column:
    return F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9


def _may_be_similar(pairs: DataFrame, parity: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, n, m) that sizes and parity bits (id, bits) don't exclude."""
    share = (1 - similarity) / (1 + similarity)
    near = pairs.where(_sizes_allow(similarity)).distinct()
    both = near.join(parity.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").join(parity.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (4, 5))
            size = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            hit = pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= share * size + 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(hit) for c in batch.columns[:4]], schema=out)

    return map_arrow(both.select("a", "b", "n", "m", "x", "y"), run, "a bigint, b bigint, n int, m int")


def _similar(pairs: DataFrame, source: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of (a, b, n, m) whose whole sets reach the similarity; `texts` has the first document of each id."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(_sets(source, narrow_side(texts.join(ids, "id", "left_semi").select("id", "first"), "candidates"), shingle), "sets")

    def widened(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_parity(np.frombuffer(x, np.uint64), WIDE_BITS) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], schema=out)

    wide = narrow_side(map_arrow(sets, widened, "id bigint, bits binary").dropDuplicates(["id"]), "wide", WIDE_ROWS)
    left = materialize(_may_be_similar(pairs, wide, similarity).select("a", "b"), "candidates")
    asked = narrow_side(left.select("a", "b", F.explode(F.array("a", "b")).alias("id")), "asked")
    side = lambda name: F.max(F.when(F.col("id") == F.col(name), F.col("hashes")))
    both = sets.join(asked, "id").groupBy("a", "b").agg(side("a").alias("x"), side("b").alias("y"))

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                hits.append(common >= similarity * ((len(x) + len(y)) // 8 - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hits, pa.bool_())) for c in batch.columns[:2]], schema=out)

    return map_arrow(both.select("a", "b", "x", "y"), run, "a bigint, b bigint")


def _apart(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, n, m) of rows (key, n, id, component, bits) with one key and different components that may be similar."""
    share = (1 - similarity) / (1 + similarity)  # of both sizes, that similar sets may differ in

    def pairs_of(n: np.ndarray, ids: np.ndarray, component: np.ndarray, bits: np.ndarray) -> Iterator[list[np.ndarray]]:
        ends = np.searchsorted(n, n / similarity + 1e-9, side="right")
        for i in range(len(n) - 1):
            others = slice(i + 1, ends[i])
            differ = np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64)
            hit = (differ <= share * (n[others] + n[i]) + 1e-9) & (component[others] != component[i])
            if hit.any():
                other, size = ids[others][hit], n[others][hit]
                less = ids[i] < other
                yield [np.where(less, ids[i], other), np.where(less, other, ids[i]), np.where(less, n[i], size), np.where(less, size, n[i])]

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            key, n, ids, component, bits = (np.concatenate(x) for x in zip(*held, strict=True))
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for low, high in zip(cuts, cuts[1:]):
                for columns in pairs_of(*(x[low:high] for x in (n, ids, component, bits))):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            rows = (*(batch.column(k).to_numpy() for k in range(4)), bits)
            start = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key may go on
            if start or held and held[-1][0][-1] != rows[0][-1]:
                held.append(tuple(x[:start] for x in rows))
                yield from emit()
                held = []
            held.append(tuple(x[start:] for x in rows))
        if held:
            yield from emit()

    dealt = rows.select("key", "n", "id", "component", "bits").repartition("key").sortWithinPartitions("key", "n")
    return map_arrow(dealt, run, "a bigint, b bigint, n int, m int").distinct()


def _proposed(sketches: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b, n, m) of texts whose fingerprints are within the radius, over one text for each fingerprint."""
    hubs = materialize(sketches.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("hub")), "fingerprints")
    links = simhash.neighbour_links(hubs.select("fp"), radius)
    side = lambda name: hubs.select(F.col("fp").alias(name), F.col("hub").alias(f"{name}_hub"))
    far = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_hub").alias("p"), F.col("b_hub").alias("q"))
    same = sketches.join(hubs, "fp").where("id <> hub.id").select(F.col("hub").alias("p"), F.struct("id", "n").alias("q"))
    both = far.union(same)
    return both.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.n").alias("n"), F.col("q.n").alias("m"))


def text_id(text: str) -> F.Column:
    return F.xxhash64(F.col(text))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = simhash.RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents that are linked, directly or over others, by sets of Jaccard similarity >= `similarity`.

    Words are lower-cased in ASCII; texts and shingles are told apart by 64-bit hashes. Texts without words (null,
    empty, white space) have the empty set and form one group; long texts are read whole. Rows that repeat a key stay
    as they are; null keys take part and count as larger than any other; other columns are ignored; an empty table
    gives an empty result.

    Returns doc_id, text_id (of the row's text), component_id (the least key reachable) and keeper: true for the rows
    with the least key of their group and, among these, the least text_id.
    """
    source = keyed_texts(docs, key, text).withColumn("id", text_id("text"))
    described = materialize(_described(source, shingle, similarity), "described")
    sketches = materialize(described.where("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits")), "sketches")
    texts = materialize(described.groupBy("id").agg(F.min("doc_id").alias("first"), F.max("n").alias("n")), "texts")
    hubs = materialize(_shared_keys(described), "hubs")
    release(docs.sparkSession)
    shared = materialize(_shared_entries(described, hubs), "shared")
    release(docs.sparkSession)
    parity = sketches.select("id", "bits")
    over_hubs = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), F.col("m").alias("n"), F.col("n").alias("m"))
    tried = materialize(_may_be_similar(over_hubs, parity, similarity), "tried")
    release(docs.sparkSession)
    proposed = _proposed(sketches.select("id", "n", "fp"), radius).where(_sizes_allow(similarity))
    first = materialize(tried.union(proposed).distinct(), "first")
    release(docs.sparkSession)
    links = materialize(_similar(first, source, texts, shingle, similarity), "similar")
    release(docs.sparkSession)
    component = connected_components(links)

    labelled = shared.select("key", "id", "n").join(component.withColumnRenamed("vertex", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = materialize(labelled, "labelled")
    release(docs.sparkSession)
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    mixed = labelled.join(narrow_side(several, "several"), "key", "left_semi")
    apart = _apart(mixed.select("key", "n", "id", "component").join(parity, "id"), similarity)
    rest = materialize(apart.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "apart")
    release(docs.sparkSession)
    if not rest.isEmpty():
        more = materialize(_similar(rest, source, texts, shingle, similarity), "similar")
        if not more.isEmpty():
            component = connected_components(links.union(more))

    joined = texts.join(component, texts.id == component.vertex, "left").select("id", "first", F.when(F.col("n") == 0, F.lit(0).cast("bigint")).otherwise(F.coalesce("component", "id")).alias("component"))
    joined = materialize(joined, "copies")
    least = joined.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("unknown"), "first", "id")).alias("least"))
    labels = joined.join(least, "component").select("id", F.col("least.first").alias("component_id"), F.col("least.id").alias("kept"))
    keeper = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("id") == F.col("kept"))
    return described.select("doc_id", "id").join(labels, "id").select("doc_id", F.col("id").alias("text_id"), "component_id", keeper.alias("keeper"))
