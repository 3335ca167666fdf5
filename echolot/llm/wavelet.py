"""Token ids as wavelet matrices: one compressed, self-contained file per shard.

File format. A fixed head, big-endian: magic `WVM2`, u32 part, u32 shard, u64 tokens, u32 length of the index. The index
in JSON: tokens `n`, bit levels, documents, byte lengths of the tables, number of zeros of each level, and for each
level its chunks as [offset from the end of the index, byte length, ones before the chunk]. Then zstandard frames: the
tables (the shard's different token ids in ascending order as u32, document ids as i64, a bitmap of those that aren't
null, document lengths in tokens as u64, little-endian) and the chunks of CHUNK bits of each level's bit-plane, over
the ranks of the tokens among the different ids, most significant bit first. Bit i of a plane is bit 7 - i % 8 of
byte i // 8. What follows the last frame is no part of the file.

Level by level, tokens are dealt stably into those with bit 0 (front) and bit 1 (back). The index is the planes'
rank directory: access, counting and occurrence look-up find their chunk by it and unpack only the chunks that
they touch, and nothing is computed when a file is opened.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolot.llm.arrow import keyed_texts, map_arrow, utf8
from echolot.llm.tokens import byte_level_reader, load_tokenizer
from echolot.runtime import materialize, new_path

MAGIC, HEAD = b"WVM2", struct.Struct(">4sIIQI")
#: Tokens after which a shard is closed; a document is never cut.
SHARD_TOKENS = 1_000_000
#: Shards up to which their starts are sent to all executors (about 50 MB); beyond that files are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bits of a chunk of a plane; a multiple of 8.
CHUNK = 1 << 18


def build_planes(values: np.ndarray, levels: int) -> tuple[list[bytes], list[int]]:
    planes, zeros = [], []
    for level in range(levels - 1, -1, -1):
        bit = (values & values.dtype.type(1 << level)) != 0
        planes.append(np.packbits(bit).tobytes())
        front = len(bit) - int(np.count_nonzero(bit))
        zeros.append(front)
        dealt = np.empty_like(values)
        np.compress(~bit, values, out=dealt[:front])
        np.compress(bit, values, out=dealt[front:])
        values = dealt
    return planes, zeros


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], level: int = 1, part: int = 0, shard: int = 0) -> bytes:
    """The file of one shard. Ids are unsigned integers of any width."""
    alphabet = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    levels = max(1, (len(alphabet) - 1).bit_length())
    ranks = np.zeros(int(alphabet[-1]) + 1 if len(ids) else 1, np.uint16 if levels <= 16 else np.uint32)
    ranks[alphabet] = np.arange(len(alphabet))
    planes, zeros = build_planes(ranks[ids], levels)
    known = np.array([x is not None for x in doc_ids], bool)
    tables = [alphabet.astype("<u4").tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), np.array(lengths, "<u8").tobytes()]
    squeeze = zstandard.ZstdCompressor(level=level).compress
    frames = [squeeze(x) for x in tables]
    sizes, at, chunks = [len(x) for x in frames], sum(map(len, frames)), []
    for plane in planes:
        directory, ones = [], 0
        for low in range(0, len(plane), CHUNK // 8):
            bits = plane[low : low + CHUNK // 8]
            frames.append(squeeze(bits))
            directory.append([at, len(frames[-1]), ones])
            at += len(frames[-1])
            ones += int.from_bytes(bits, "little").bit_count()
        chunks.append(directory)
    index = json.dumps({"n": len(ids), "levels": levels, "docs": len(doc_ids), "tables": sizes, "zeros": zeros, "chunks": chunks}, separators=(",", ":")).encode()
    return b"".join([HEAD.pack(MAGIC, part, shard, len(ids), len(index)), index, *frames])


class WaveletShard:
    """Reader of one file, given as bytes or as a function (offset, length) that reads from it."""

    def __init__(self, file: bytes | Callable[[int, int], bytes]) -> None:
        self._read = file if callable(file) else lambda at, n: file[at : at + n]
        magic, self.part, self.shard, self.n, size = HEAD.unpack(self._read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.index = json.loads(self._read(HEAD.size, size))
        self.levels, self.zeros, self._base = self.index["levels"], self.index["zeros"], HEAD.size + size
        self._expand = zstandard.ZstdDecompressor().decompress
        self.chunk = lru_cache(maxsize=256)(self._chunk)

    def _table(self, k: int, kind: str) -> np.ndarray:
        sizes = self.index["tables"]
        return np.frombuffer(self._expand(self._read(self._base + sum(sizes[:k]), sizes[k])), kind)

    @cached_property
    def alphabet(self) -> np.ndarray:
        return self._table(0, "<u4")

    @cached_property
    def doc_ids(self) -> list[int | None]:
        docs = self.index["docs"]
        known = np.unpackbits(self._table(2, "u1"), count=docs).astype(bool) if docs else np.zeros(0, bool)
        return [x if k else None for x, k in zip(self._table(1, "<i8").tolist(), known, strict=True)]

    @cached_property
    def lengths(self) -> np.ndarray:
        return self._table(3, "<u8").astype(np.int64)

    def _chunk(self, level: int, k: int) -> np.ndarray:
        at, size, _ = self.index["chunks"][level][k]
        return np.frombuffer(self._expand(self._read(self._base + at, size)), np.uint8)

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        directory = self.index["chunks"][level]
        k = i // CHUNK
        if k == len(directory):  # just behind the last chunk
            return self.n - self.zeros[level]
        i -= k * CHUNK
        if not i:
            return directory[k][2]
        plane = self.chunk(level, k)
        count = directory[k][2] + int(np.bitwise_count(plane[: i // 8]).sum())
        return count + (int(plane[i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else count

    def select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value on a level."""
        marks = [c[2] if bit else at * CHUNK - c[2] for at, c in enumerate(self.index["chunks"][level])]
        chunk = bisect_right(marks, k) - 1
        bits = np.unpackbits(self.chunk(level, chunk), count=min(CHUNK, self.n - chunk * CHUNK))
        return chunk * CHUNK + int(np.flatnonzero(bits == bit)[k - marks[chunk]])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = int(self.chunk(level, i // CHUNK)[i % CHUNK // 8]) >> (7 - i % 8) & 1
            ones = self.rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _rank_of(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def _range(self, value: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self.rank1(level, low), self.rank1(level, high)
            if value >> (self.levels - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token among positions low..high-1, as far as these exist."""
        value = self._rank_of(token)
        if value is None:
            return 0
        high = self.n if high is None else max(0, min(high, self.n))
        low, high = self._range(value, max(0, min(low, high)), high)
        return high - low

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        value = self._rank_of(token)
        at = self._range(value, 0, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence, by undoing the levels from the last to the first."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        bits = [np.unpackbits(np.concatenate([self._chunk(level, k) for k in range(len(d))]), count=self.n) for level, d in enumerate(self.index["chunks"])] if self.n else []
        values = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit, zero = (bits[level], self.zeros[level]) if self.n else (np.zeros(0, np.uint8), 0)
            before = np.empty_like(values)
            values[zero:] |= kind(1 << (self.levels - 1 - level))
            ones = bit.view(bool)
            before[np.flatnonzero(~ones)] = values[:zero]
            before[np.flatnonzero(ones)] = values[zero:]
            values = before
        return self.alphabet[values]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, shard_tokens: int = SHARD_TOKENS, key: str = "doc_id", text: str = "text") -> str:
    """Encode all texts and store them as one file for each shard, in ascending order of the key.

    Documents are range-partitioned by key, sorted within partitions and appended to the open shard,
    which is closed after `shard_tokens` tokens; so a task holds one shard and one batch of texts. Null
    texts are empty documents, null keys come first, rows that repeat a key are kept side by side (ordered
    by text), long texts are never cut, other columns are ignored; an empty table gives no shard.

    Spark commits the files to a new folder of the shared folder, so that they can lie in any store (it writes each
    file's bytes as one line of text; the line end comes after the last frame). Returns the folder.
    """

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        width = 2 if max(load_tokenizer(tokenizer_path).get_vocab_size(), end_id or 0) <= 1 << 16 else 4
        reader = byte_level_reader(tokenizer_path, width)
        end = b"" if end_id is None else end_id.to_bytes(width, "little")
        shard, size, keys, lengths, pieces = 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), f"<u{width}")
            return pa.RecordBatch.from_arrays([pa.array([encode_shard(ids, keys, lengths, part=part, shard=shard)], pa.binary())], schema=out)

        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = reader.joined(content or b"") + end
                keys.append(doc)
                lengths.append(len(ids) // width)
                pieces.append(ids)
                size += lengths[-1]
                if size >= shard_tokens:
                    yield close()
                    shard, size, keys, lengths, pieces = shard + 1, 0, [], [], []
        if keys:
            yield close()

    spark = docs.sparkSession
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed_texts(docs, key, text).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    folder = new_path(spark, "wavelet")
    files = map_arrow(ordered, run, "file binary", release=False).select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each file of a folder: part, shard, n_tokens (from its head) and its content."""
    read = spark.read.format("binaryFile").load(folder).where("length > 0")
    number = lambda at, size: F.conv(F.hex(F.substring("content", at, size)), 16, 10).cast("bigint")
    return read.select(number(5, 4).alias("part"), number(9, 4).alias("shard"), number(13, 8).alias("n_tokens"), "content")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the stored files: doc_id, start (tokens of all documents before), n_tokens, ids (little-endian u32)."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = WaveletShard(content.as_py())
                ids = shard.ids()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.concatenate([[0], ends]) * 4).astype("<i4").tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(shard.lengths, pa.int64()), values], schema=out)

    # running totals: over the parts, of which there are as many as partitions, then inside each part
    files = shard_files(spark, folder)
    heads = files.select("part", "shard", "n_tokens")
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = parts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    inside = heads.select("part", "shard", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).alias("inside"))
    bases = inside.join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("base"))
    bases = materialize(bases, "bases")
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    based = files.join(bases, ["part", "shard"]).select("base", "content")
    return map_arrow(based, run, "doc_id bigint, start bigint, n_tokens bigint, ids binary", release=False)
