import zlib
from functools import reduce
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from echolot.llm import mpeg, packing, tokens, wavelet

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids string, piece int"  # with clashing names
TEXTS = [None, "", " ", "Hello, world.", "a\nb.\nC d,, e", "  two  spaces \n\n x\t", "it's don't  I'll", "<|endoftext|> x<|endoftext|>.", "naïve Éclair ß İ 日本語 नमस्ते", "x" * 5000, "end \u00a0 nbsp \x1c\x1d x", "word " * 3000, "1234 5,6.7. a.b,c"]
ODD = st.text(st.sampled_from("aZé .,\n\t'\u00a0s1!<|>日"), max_size=40)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y", 2), (None, "null key", "z", 3)]
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_counts(spark, docs):
    got = tokens.token_counts(docs, BYTE, limit=3).collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(ids_of(BYTE, r.text))) for r in docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got)
    assert tokens.token_counts(docs.limit(0), BYTE).count() == 0


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_segments_equal_the_library(text):
    library = Tokenizer.from_file(BYTE) if not hasattr(test_segments_equal_the_library, "t") else test_segments_equal_the_library.t
    test_segments_equal_the_library.t = library
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(tokens.byte_level_reader(BYTE, 2).joined(text.encode()), np.uint16).tolist() == want
    assert tokens._counter(BYTE, 1000).count(text.encode()) == len(want)
    assert np.frombuffer(tokens.WordEncoder(WORD).encode(text.encode()), np.uint32).tolist() == tokens.load_tokenizer(WORD).encode(text, add_special_tokens=False).ids


def test_packing(spark, docs):
    pieces = packing.token_pieces(docs, WORD, capacity=64, end_id=0)
    packed = packing.pack_best_fit(pieces, capacity=64).collect()
    by_doc = {}
    for r in packed:
        by_doc.setdefault((r.doc_id, r.piece, r.start, r.ids), 0)
        by_doc[r.doc_id, r.piece, r.start, r.ids] += 1
        assert r.length == len(r.ids) // 4 <= 64
    for d in docs.collect():
        whole = np.array([*ids_of(WORD, d.text), 0], "<u4").tobytes()
        for k, low in enumerate(range(0, len(whole), 256)):
            assert by_doc[d.doc_id, k, low // 4, whole[low : low + 256]] >= 1
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in packed)
    assert len(places) <= -(-total // 64) + 1
    assert packing.pack_best_fit(pieces.limit(0), capacity=64).count() == 0
    odd = spark.createDataFrame([(5, 1, 2, 3, 4, 5), (60, 1, 2, 3, 4, 5)], "length int, offset int, sequence_id string, row int, size int, `a.b` int")
    got = packing.pack_best_fit(odd, capacity=64)
    assert got.columns == ["length", "row", "size", "a.b", "sequence_id", "offset"] and sorted((r.length, r.row, r.offset) for r in got.collect()) == [(5, 3, 0), (60, 3, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 32), st.integers(1, 500)), max_size=20))
def test_plan_uses_every_piece_once(pairs):
    histogram = np.zeros(33, np.int64)
    for length, n in pairs:
        histogram[length] += n
    used = np.zeros(33, np.int64)
    for pieces, n in packing.plan(histogram, 32):
        assert sum(pieces) <= 32 and n > 0
        for x in pieces:
            used[x] += n
    assert (used == histogram).all()


def test_plan_reaches_the_bound_on_matching_lengths():
    histogram = np.zeros(101, np.int64)
    histogram[[70, 30, 45, 55, 20, 35]] = [1000, 1000, 700, 700, 500, 500]
    histogram[45] += 500
    sequences = sum(n for _, n in packing.plan(histogram, 100))
    assert sequences <= np.ceil((histogram * np.arange(101)).sum() / 100) + 2


@pytest.mark.parametrize("chunk", [1 << 18, 64])
@settings(max_examples=40, deadline=None)
@given(values=st.lists(st.integers(0, 70_000), max_size=300))
def test_wavelet_round_trip(chunk, values):
    a, kept = np.array(values, np.uint32), wavelet.CHUNK
    wavelet.CHUNK = chunk
    try:
        shard = wavelet.WaveletShard(wavelet.encode_shard(a, [5, None], [len(a), 0], part=3, shard=9) + b"\n")
        assert (shard.part, shard.shard, shard.n) == (3, 9, len(values))
        assert shard.ids().tolist() == values and shard.doc_ids == [5, None] and shard.lengths.tolist() == [len(a), 0]
        for i in range(0, len(values), 7):
            assert shard.access(i) == values[i]
        for token in {*values[:5], 70_001}:
            where = [i for i, v in enumerate(values) if v == token]
            assert shard.count(token) == len(where)
            assert [shard.locate(token, k) for k in range(len(where))] == where
            assert shard.count(token, 3, 9) == sum(3 <= i < 9 for i in where)
    finally:
        wavelet.CHUNK = kept


def test_access_reads_few_bytes(monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", 1 << 12)
    ids = np.random.default_rng(1).integers(0, 30_000, 200_000).astype(np.uint32)
    image, asked = wavelet.encode_shard(ids, [1], [len(ids)]), []

    def read(at, n):
        asked.append(n)
        return image[at : at + n]

    shard = wavelet.WaveletShard(read)
    opened = sum(asked)
    assert shard.access(123_456) == ids[123_456]
    assert shard.levels == 15 and sum(asked) - opened < 15 * 700 + len(np.unique(ids)) * 4 < len(image) / 3


def test_shards(spark, docs, tmp_path):
    folder = wavelet.write_shards(docs, BYTE, end_id=2, shard_tokens=1000)
    files = sorted(Path(folder.removeprefix("file:")).glob("part-*"))
    assert len(files) == wavelet.shard_files(spark, folder).count() > 2
    opened = [wavelet.WaveletShard(f.read_bytes()) for f in files]  # each is a file of its own
    assert sum(s.n for s in opened) == sum(r.n_tokens for r in wavelet.shard_files(spark, folder).collect())
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids) for r in wavelet.read_shards(spark, folder).collect()), key=lambda r: r[0])
    want, at = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array([*ids_of(BYTE, r.text), 2], "<u4")
        want.append((at, r.doc_id, len(ids), ids.tobytes()))
        at += len(ids)
    assert got == want
    assert wavelet.read_shards(spark, wavelet.write_shards(docs.limit(0), BYTE)).count() == 0


def test_crc16_is_bitwise():
    def slow(data):
        value = 0xFFFF
        for bit in "".join(f"{b:08b}" for b in data):
            top = value >> 15 ^ int(bit)
            value = value << 1 & 0xFFFF ^ (0x8005 if top else 0)
        return value

    for data in (b"", b"\0", b"123456789", bytes(range(40))):
        assert mpeg.crc16(data) == slow(data)
    assert mpeg.crc16(b"123456789") == 0xAEE7


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=9000))
def test_media_round_trip(payload):
    media = mpeg.store_payload(payload)
    stream = mpeg.parse_stream(media)
    assert mpeg.load_payload(media, stream) == payload
    assert stream.crc_bad == 0 and stream.skipped == 0 and stream.table["frames"] == len(stream.headers)
    assert stream.seconds == len(stream.headers) * 1152 / 32000
    assert all(media[at] == 0xFF for at in stream.offsets)


def test_resync_checksums_and_tags():
    media = mpeg.store_payload(bytes(5000))
    stream = mpeg.parse_stream(media)
    dirty = media[: stream.offsets[1]] + b"\xff\xfb junk \xff" + media[stream.offsets[1] :] + b"TAG" + bytes(125)
    again = mpeg.parse_stream(dirty)
    assert len(again.headers) == len(stream.headers) and again.skipped == 9 and "ID3v1" in again.tags
    broken = bytearray(media)
    broken[stream.offsets[0] + 8] ^= 1
    assert mpeg.parse_stream(bytes(broken)).crc_bad == 1
    for garbage in (b"", b"\xff", b"ID3", b"\xff\xfb\x90\x00", bytes(100), b"\xff" * 1000):
        assert mpeg.parse_stream(garbage).seconds == 0
    vbri = b"\xff\xfb\x90\x04" + bytes(32) + b"VBRI" + bytes.fromhex("0001 0240 0000") + (5000).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes.fromhex("0003 0002 0002 0005") + bytes.fromhex("0001 0002 0003")
    frame = b"\xff\xfb\x90\x04" + bytes(413)
    found = mpeg.parse_stream(vbri + bytes(417 - len(vbri)) + frame * 2)
    assert found.table == {"kind": "VBRI", "bytes": 5000, "frames": 9, "toc": [2, 4, 6], "frames_per_entry": 5, "delay": 0x240} and len(found.headers) == 2
    apart = mpeg.parse_header(b"\xff\xfd\x90\x00"), mpeg.parse_header(b"\xff\xf3\x40\xc0"), mpeg.parse_header(b"\xff\xff\x10\x00")
    assert [(h.version, h.layer, h.bitrate, h.samples, h.size) for h in apart] == [(1, 2, 160000, 1152, 522), (2, 3, 32000, 576, 104), (1, 1, 32000, 384, 32)]
    assert mpeg.parse_header(b"\xff\xfb\xf0\x00") is None and mpeg.parse_header(b"\xff\xe9\x90\x00") is None


def test_checksums_of_other_layers():
    """Frames of Layers I and II whose covered bits are counted out by hand."""
    rng = np.random.default_rng(3)
    slow = lambda bits: reduce(lambda v, b: (v << 1 & 0xFFFF) ^ (0x8005 if v >> 15 ^ int(b) else 0), bits, 0xFFFF)
    cases = [("fffe90c4", [4] * 32, 32, 1), ("fffe9004", [4] * 32, 32, 2), ("fffe9054", [4] * 32, 8, 2), ("fffc9004", [4] * 11 + [3] * 12 + [2] * 4, 32, 2), ("fffc9044", [4] * 11 + [3] * 12 + [2] * 4, 4, 2),
             ("fffce004", [4] * 11 + [3] * 12 + [2] * 7, 32, 2), ("fffc10c4", [4] * 2 + [3] * 6, 32, 1), ("fffc18c4", [4] * 2 + [3] * 10, 32, 1), ("fff490c4", [4] * 4 + [3] * 7 + [2] * 19, 32, 1)]
    for text, widths, bound, channels in cases:
        head = mpeg.parse_header(bytes.fromhex(text))
        assert head.protected and head.layer in (1, 2), text
        allocation, selections = "", 0
        for band, width in enumerate(widths):
            for _ in range(channels if band < bound else 1):
                value = int(rng.integers(0, 1 << width)) * int(rng.random() < 0.5)
                allocation += f"{value:0{width}b}"
                selections += bool(value) * (channels if band >= bound else 1)
        covered = allocation + "".join(rng.choice(["0", "1"], 2 * selections)) if head.layer == 2 else allocation
        rest = covered + "10" * 4 * (head.size - 6)
        body = int(rest[: 8 * (head.size - 6)], 2).to_bytes(head.size - 6, "big")
        check = slow(f"{int(text[4:], 16):016b}" + covered)
        for off, bad in ((0, 0), (1, 2)):
            frame = bytes.fromhex(text) + (check ^ off).to_bytes(2, "big") + body
            stream = mpeg.parse_stream(frame * 2)
            assert (len(stream.headers), stream.crc_checked, stream.crc_bad) == (2, 2, bad), text


def test_audio_columns(spark, docs):
    got = mpeg.audio_columns(docs).collect()
    assert len(got) == docs.count()
    want = {(r.doc_id, mpeg.padded((r.text or "").encode())) for r in docs.collect()}
    assert {(r.doc_id, bytes(r.payload)) for r in got} == want
    assert all(len(r.payload) % 64 == 0 and len(r.payload) and r.crc_bad == 0 and len(r.seek_offsets) == r.frames for r in got)
    assert mpeg.audio_columns(docs.limit(0)).count() == 0
    parsed = mpeg.parse_media(spark.createDataFrame([(1, None), (2, bytearray(mpeg.store_payload(b"x" * 3000)))], "k int, b binary"), "k", "b")
    assert {r.k: (r.frames, r.table) for r in parsed.collect()} == {1: (0, None), 2: (3, "Info")}
    assert zlib.crc32(b"") == 0
