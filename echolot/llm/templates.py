"""Line deduplication by log templates: a tree of fixed depth over token counts and tokens.

A line is masked first: tokens that hold a digit become a wildcard. A masked line that recurs as it is is a
template. The others go down a tree: the root deals them by number of tokens, the next DEPTH levels by their
leading tokens, and the SPLITS levels below by votes. A node where enough positions hold the same token in
most lines makes a template of the lines that agree with all of these positions, and hands the rest down; any
other node deals its lines by the position that varies least. Hot lines are templates before any vote, so they
don't outvote the others of their node. Unlike parsers that grow templates line by line, the outcome doesn't
depend on the order of lines.

What counts as recurring is the number of different texts: a group of copies is one text, so its lines don't
recur for being copied, and all of its documents lose the same lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolot.llm.arrow import map_arrow
from echolot.runtime import materialize

#: Levels of leading tokens, levels below them that deal lines by votes.
DEPTH, SPLITS = 3, 4
#: Different texts that make a masked line recurring, and that a template with further variable fields needs.
MIN_DOCS, PATTERN_DOCS = 3, 10
#: Share of a node's lines that make a position constant; share of constant positions that make a template.
CONSTANT, SOLID = 0.8, 0.6
#: Rows of (line, first text), 16 bytes each, that are handed to every task; larger tables are joined.
BROADCAST_ROWS = 2_000_000
#: Patterns, and characters of them together, that are broadcast; larger tables are shuffled.
PATTERN_ROWS, PATTERN_CHARACTERS = 100_000, 32 << 20

_WILD = "<*>"
_DIGIT = re.compile(r"\d")
_LAST = (1 << 63) - 1


def mask(line: str) -> list[str]:
    """Tokens with variable fields as wildcards; a line of nothing else keeps its tokens."""
    tokens = line.split()
    if _DIGIT.search(line):
        masked = [_WILD if _DIGIT.search(t) else t for t in tokens]
        return tokens if masked.count(_WILD) == len(masked) else masked
    return tokens


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode())
    return value - (1 << 64) if value >> 63 else value


def leaf_of(tokens: list[str], depth: int = DEPTH) -> int:
    return _hash(f"{len(tokens)} {' '.join(tokens[:depth])}")


def _pairs(texts: DataFrame, depth: int) -> DataFrame:
    """(own, leaf, text, doc): masked lines of each different text, with its least document."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[str, int] = {}
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first[content] = min(doc, first.get(content, doc))
            rows: list[tuple[int, int, int, int]] = []
            for content, doc in first.items():
                text, seen = _hash(content), set()
                for line in content.split("\n"):
                    tokens = mask(line)
                    if tokens:
                        own = _hash(" ".join(tokens))
                        if own not in seen:
                            seen.add(own)
                            rows.append((own, leaf_of(tokens, depth), text, doc))
            table = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(4)], schema=out)

    return map_arrow(texts, run, "own bigint, leaf bigint, text bigint, doc bigint").groupBy("own", "leaf", "text").agg(F.min("doc").alias("doc"))


def _masked_lines(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(own, masked): the wanted lines (own) with their tokens, each once for a batch before the shuffle."""
    few = wanted.count() <= BROADCAST_ROWS
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow()["own"].to_numpy())) if few else None

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines: dict[int, str] = {}
            for content in batch.column(0).to_pylist():
                for line in content.split("\n"):
                    if tokens := mask(line):
                        masked = " ".join(tokens)
                        lines[_hash(masked)] = masked
            own = np.fromiter(lines, np.int64, len(lines))
            texts_of = pa.array(lines.values(), pa.string())
            if shared is not None:
                hit = _places(shared.value, own) >= 0
                own, texts_of = own[hit], texts_of.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([pa.array(own), texts_of], schema=out)

    found = map_arrow(texts.select("text"), run, "own bigint, masked string")
    return (found if few else found.join(wanted, "own", "left_semi")).groupBy("own").agg(F.first("masked").alias("masked"))


def _places(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, -1 for those not there."""
    if not len(ordered):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return np.where(ordered[at] == keys, at, -1)


def _votes(lines: DataFrame, constant: float, least: int) -> DataFrame:
    """(node, pattern, share, split): constant tokens by position, the share of those that aren't wildcards,
    and the varying position with the fewest tokens, of nodes (node, n, tokens) that could hold a template."""
    counted = lines.select("node", "n", F.posexplode("tokens").alias("pos", "token")).groupBy("node", "pos", "token").agg(F.sum("n").alias("n"))
    by_pos = counted.groupBy("node", "pos").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= least)
    fixed = F.col("top.n") >= constant * F.col("total")
    solid = F.when(fixed & (F.col("top.token") != _WILD), 1.0).otherwise(0.0)
    nodes = by_pos.groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.when(fixed, F.col("top.token")).alias("token")))).alias("ps"),  # one entry for each token of a line
        F.avg(solid).alias("share"),
        F.min(F.when(~fixed, F.struct("kinds", "pos"))).alias("split"),
    )
    return nodes.select("node", F.col("ps.token").alias("pattern"), "share", F.col("split.pos").alias("split"))


def _small(patterns: DataFrame) -> bool:
    size = patterns.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("pattern", " ", ""))).alias("c")).first()
    return size["n"] <= PATTERN_ROWS and (size["c"] or 0) <= PATTERN_CHARACTERS


def _grow(lines: DataFrame, splits: int, constant: float, solid: float, least: int) -> DataFrame | None:
    """(own, template) of the lines (own, node, n, tokens) that the levels below the leading tokens put together."""
    found = []
    for level in range(splits + 1):
        patterns = materialize(_votes(lines, constant, least), f"votes{level}")
        dealt = lines.join(F.broadcast(patterns) if _small(patterns) else patterns, "node")
        makes = F.col("share") >= solid
        agrees = makes & F.forall(F.arrays_zip(F.col("tokens").alias("t"), F.col("pattern").alias("p")), lambda x: x["p"].isNull() | (x["p"] == x["t"]))
        below = F.when(makes, F.xxhash64("node", F.lit(level))).otherwise(F.xxhash64("node", "split", F.expr("get(tokens, split)")))
        state = materialize(dealt.select("own", "n", "tokens", F.when(agrees, F.col("node")).alias("template"), below.alias("node")), f"tree{level}")
        found.append(state.where("template IS NOT NULL").select("own", "template"))
        lines = state.where("template IS NULL").select("own", "node", "n", "tokens")
        if lines.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def recurring_lines(pairs: DataFrame, texts: DataFrame, splits: int, min_docs: int, pattern_docs: int, constant: float, solid: float) -> DataFrame:
    """(own, first): masked lines of recurring templates, with the text that keeps them (that of the least document)."""
    holder = F.min(F.struct("doc", "text")).alias("holder")
    lines = materialize(pairs.groupBy("own", "leaf").agg(F.count("*").alias("n"), holder), "lines")
    exact = lines.where(F.col("n") >= min_docs).select("own", F.col("holder.text").alias("first"))
    rest = lines.where(F.col("n") < min_docs).select("own", "leaf", "n")
    leaves = rest.groupBy("leaf").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where((F.col("total") >= pattern_docs) & (F.col("kinds") > 1)).select("leaf")
    leaves = materialize(leaves, "leaves")
    if leaves.isEmpty():
        return materialize(exact, "recurring")
    few = leaves.count() <= BROADCAST_ROWS
    asked = materialize(rest.join(F.broadcast(leaves) if few else leaves, "leaf"), "asked")
    tokens = _masked_lines(texts, asked.select("own"))
    spelled = materialize(asked.join(tokens, "own").select("own", F.col("leaf").alias("node"), "n", F.split("masked", " ").alias("tokens")), "spelled")
    grown = materialize(_grow(spelled, splits, constant, solid, pattern_docs), "grown")
    seen = pairs.join(grown, "own").groupBy("template", "text").agg(F.min("doc").alias("doc"))
    templates = seen.groupBy("template").agg(F.count("*").alias("texts"), holder).where(F.col("texts") >= pattern_docs)
    return materialize(exact.unionByName(grown.join(templates, "template").select("own", F.col("holder.text").alias("first"))), "recurring")


def _without(content: str, gone: np.ndarray, places: list[int]) -> str:
    dropped = {at for at, g in zip(places, gone.tolist(), strict=True) if g}
    return "\n".join(x for at, x in enumerate(content.split("\n")) if at not in dropped)


def drop_recurring_lines(docs: DataFrame, depth: int = DEPTH, splits: int = SPLITS, min_docs: int = MIN_DOCS, pattern_docs: int = PATTERN_DOCS, constant: float = CONSTANT, solid: float = SOLID, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Drop lines whose template occurs in at least `min_docs` different texts (`pattern_docs` for templates with
    variable fields besides those with digits), except in the first of these texts.

    Lines end at newlines; lines without tokens are never dropped. The first text is that of the least key (on
    ties the one with the least hash) and keeps its lines, in all of its copies; every other document loses them,
    be they a part of it or all. Lines and texts are told apart by 64-bit hashes. Null and empty texts stay as
    they are; long texts are read whole. The key must be an integer; null keys count as the largest. Rows are
    judged by their text alone, so repeated rows and keys are fine. Other columns are ignored, but those named in
    `carry` come back as the struct column `carried`, whatever their names. An empty table gives an empty result.

    Returns doc_id, n_lines, n_removed, kept (the text without the dropped lines, null for null).
    """
    extra = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *extra)
    texts = source.where("text IS NOT NULL").select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc_id"), "text")
    width = len(source.columns)
    pairs = materialize(_pairs(texts, depth), "line-texts")
    recurring = recurring_lines(pairs, texts, splits, min_docs, pattern_docs, constant, solid)
    if recurring.count() <= BROADCAST_ROWS:
        rows = recurring.toArrow()  # size checked above
        own = rows["own"].to_numpy()
        by = np.argsort(own)
        shared = docs.sparkSession.sparkContext.broadcast((own[by], rows["first"].to_numpy()[by]))
        drops = source
    else:
        shared = None
        later = pairs.join(recurring, "own").where("first <> text").groupBy("text").agg(F.collect_set("own").alias("drops"))  # lines of one text
        drops = _hashed(source).alias("d").join(later.withColumnRenamed("text", "content"), "content", "left").select("doc_id", "text", *source.columns[2:], "drops")

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, places, owns, sizes = batch.column(1).to_pylist(), [], [], []
            for content in contents:
                lines = [] if content is None else content.split("\n")
                masked = [(at, " ".join(tokens)) for at, line in enumerate(lines) if (tokens := mask(line))]
                places.append([at for at, _ in masked])
                owns += [_hash(m) for _, m in masked]
                sizes.append(len(lines))
            own = np.array(owns, np.int64)
            ends = np.cumsum([0, *map(len, places)])
            if shared is not None:
                known, first = shared.value
                at = _places(known, own)
                judged = np.repeat(np.array([0 if c is None else _hash(c) for c in contents], np.int64), np.diff(ends))
                gone = (at >= 0) & (first[at] != judged) if len(known) else np.zeros(len(own), bool)
            else:
                lists = batch.column(batch.num_columns - 1).to_pylist()
                gone = np.concatenate([np.isin(own[ends[i] : ends[i + 1]], np.array(x or [], np.int64)) for i, x in enumerate(lists)]) if lists else np.zeros(0, bool)
            removed = [int(gone[a:b].sum()) for a, b in zip(ends, ends[1:])]
            kept = [_without(c, gone[ends[i] : ends[i + 1]], places[i]) if removed[i] else c for i, c in enumerate(contents)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *batch.columns[2:width]], schema=out)

    out = T.StructType.fromDDL("doc_id bigint, n_lines bigint, n_removed bigint, kept string")
    return map_arrow(drops, run, T.StructType([*out.fields, *source.schema.fields[2:]]))


def _hashed(source: DataFrame) -> DataFrame:
    """The documents with the hash of their text, null for null."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if x is None else _hash(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], schema=out)

    return map_arrow(source, run, T.StructType([*source.schema.fields, T.StructField("content", T.LongType())]))
