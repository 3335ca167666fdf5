"""MPEG audio columns: frame headers with resynchronisation, tags, variable-bitrate tables, checksums, seek offsets.

`store_payload` writes bytes as an MPEG-1 Layer III stream whose frames are silent (side information all
zero) and carry the bytes as ancillary data, which decoders skip; so any payload survives losslessly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from echolot.llm.arrow import keyed_texts, map_arrow, utf8

# Fixed values of ISO 11172-3 and 13818-3: kbit/s by index 1..14, Hz by index 0..2.
_BITRATES = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_RATES = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}
#: Bits of an allocation by subband in Layer II: high rates, 44.1 and 32 kHz from 96 kbit/s a channel, low rates, low rates at 32 kHz, low sampling rates.
_ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}
_ID3V1, _PAYLOAD_OWNER = 128, b"echolot.payload\0"


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mode: int
    extension: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def bound(self) -> int:
        """Subband from which both channels share their allocation (Layers I and II)."""
        return 4 * (self.extension + 1) if self.mode == 1 else 32

    @property
    def allocation(self) -> list[int]:
        """Bits of an allocation by subband (Layer II)."""
        each = self.bitrate // (1000 if self.mono else 2000)
        if self.version != 1:
            return _ALLOCATION["low"]
        if each >= 56 and (self.rate == 48000 or each <= 80):
            return _ALLOCATION["a"]
        return _ALLOCATION["b" if each >= 96 else "d" if self.rate == 32000 else "c"]

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 1 else 1152

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.bitrate // self.rate + self.padding) * 4
        return self.samples // 8 * self.bitrate // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def parse_header(four: bytes) -> Header | None:
    """A frame header, or None for reserved or free-format values."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    rates = _BITRATES[(1, layer) if version == 1 else (2, min(layer, 2))]
    return Header(version, layer, not four[1] & 1, rates[index - 1] * 1000, _RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6, four[3] >> 4 & 3)


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of frames over the first bits of some bytes, or all: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    value = 0xFFFF
    bits = 8 * len(data) if bits is None else bits
    for byte in data[: bits // 8]:
        value ^= byte << 8
        for _ in range(8):
            value = value << 1 ^ 0x8005 if value & 0x8000 else value << 1
        value &= 0xFFFF
    for k in range(bits % 8):
        top = value >> 15 ^ data[bits // 8] >> (7 - k) & 1
        value = (value << 1 ^ (0x8005 if top else 0)) & 0xFFFF
    return value


def protected_bits(body: bytes, head: Header) -> int:
    """Bits behind the checksum that it covers besides the header's last two bytes: side information in Layer III,
    allocations in Layer I, allocations and scale factor selections (two bits for each that isn't zero) in Layer II."""
    if head.layer == 3:
        return 8 * head.side
    channels = 1 if head.mono else 2
    if head.layer == 1:
        return 4 * (head.bound * channels + 32 - head.bound)
    number, size, at, chosen = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for band, width in enumerate(head.allocation):
        for _ in range(channels if band < head.bound else 1):
            at += width
            if at <= size and number >> (size - at) & ((1 << width) - 1):
                chosen += channels if band >= head.bound else 1
    return min(size, at + 2 * chosen)


def _syncsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _unsyncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


@dataclass
class Stream:
    """What one stream holds; offsets are byte positions of audio frames, for seeking."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)

    @property
    def duration(self) -> int:
        """Exact duration in samples: the coded ones without encoder delay and padding, if a table states them."""
        return max(0, self.samples - int(self.table.get("delay", 0)) - int(self.table.get("padding", 0)))

    @property
    def seconds(self) -> float:
        return self.duration / self.rate if self.rate else 0.0


def _id3v2(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Parse a leading tag; the position behind it."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return at
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + _unsyncsafe(data[at + 6 : at + 10])
    pos = at + 10
    wide = 10 if major >= 3 else 6
    if major >= 3 and flags & 0x40 and pos + 4 <= end:
        pos += _unsyncsafe(data[pos : pos + 4]) if major == 4 else int.from_bytes(data[pos : pos + 4], "big") + 4
    while pos + wide <= min(end, len(data)) and data[pos]:
        if major >= 3:
            name, raw = data[pos : pos + 4], data[pos + 4 : pos + 8]
            size = _unsyncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        else:
            name, size = data[pos : pos + 3], int.from_bytes(data[pos + 3 : pos + 6], "big")
        tags[name.decode("latin-1")] = data[pos + wide : pos + wide + size]
        pos += wide + size
    return end + (10 if major == 4 and flags & 0x10 else 0)


def _vbr_table(data: bytes, at: int, head: Header) -> dict[str, object] | None:
    """A Xing, Info or VBRI table in the frame at `at`."""
    pos = at + 4 + 2 * head.protected + head.side
    kind = data[pos : pos + 4]
    if kind in (b"Xing", b"Info"):
        flags, pos = int.from_bytes(data[pos + 4 : pos + 8], "big"), pos + 8
        table: dict[str, object] = {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[name] = int.from_bytes(data[pos : pos + 4], "big")
                pos += 4
        if flags & 4:
            table["toc"] = list(data[pos : pos + 100])
            pos += 100
        if flags & 8:
            pos += 4
        if data[pos : pos + 4] in (b"LAME", b"Lavc", b"Lavf"):
            gap = data[pos + 21 : pos + 24]
            if len(gap) == 3:
                table["delay"], table["padding"] = gap[0] << 4 | gap[1] >> 4, (gap[1] & 15) << 8 | gap[2]
        return table
    pos = at + 36
    if data[pos : pos + 4] == b"VBRI" and len(data) >= pos + 26:
        size, frames, entries, scale, width, per = struct.unpack_from(">IIHHHH", data, pos + 10)
        raw = data[pos + 26 : pos + 26 + entries * width]
        toc = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), max(width, 1))]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "toc": toc, "frames_per_entry": per, "delay": int.from_bytes(data[pos + 6 : pos + 8], "big")}
    return None


def parse_stream(data: bytes) -> Stream:
    """Walk the frames of a stream, skipping whatever isn't a frame.

    A sync is believed where a valid header is followed by another with the same version, layer and rate,
    by a trailing tag or by the end; otherwise the search goes on at the next 0xFF.
    """
    found = Stream()
    end = len(data)
    if data[-_ID3V1:][:3] == b"TAG" and end >= _ID3V1:
        end -= _ID3V1
        found.tags["ID3v1"] = data[end : end + _ID3V1]
    if data[end - 32 : end][:8] == b"APETAGEX" and end >= 32:
        size = int.from_bytes(data[end - 20 : end - 16], "little") + 32 * (data[end - 9] >> 7)
        if 32 <= size <= end:
            found.tags["APE"] = data[end - size : end]
            end -= size
    at = _id3v2(data, 0, found.tags)
    synced = False
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        if head and found.headers and (head.version, head.layer, head.rate) != (found.headers[0].version, found.headers[0].layer, found.headers[0].rate):
            head = None
        if head and at + head.size <= end:
            after = at + head.size
            following = parse_header(data[after : after + 4]) if after + 4 <= end else None
            if synced or after == end or following and (following.version, following.layer, following.rate) == (head.version, head.layer, head.rate):
                if head.protected:
                    found.crc_checked += 1
                    body = data[at + 6 : min(after, at + 6 + 64)]  # no layer covers more
                    bits = protected_bits(body, head)
                    found.crc_bad += crc16(data[at + 2 : at + 4] + body[: -(-bits // 8)], 16 + bits) != int.from_bytes(data[at + 4 : at + 6], "big")
                table = _vbr_table(data, at, head) if not found.headers and not found.table and head.layer == 3 else None
                if table:
                    found.table = table
                else:
                    found.offsets.append(at)
                    found.headers.append(head)
                    found.samples += head.samples
                found.rate = head.rate
                at, synced = after, True
                continue
        synced = False
        step = data.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        found.skipped += step - at
        at = step
    return found


_SIDE = bytes(32)


@lru_cache(maxsize=64)
def _frame_head(index: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a protected 32 kHz stereo frame, and its body's size."""
    four = bytes([0xFF, 0xFA, index << 4 | 2 << 2, 0x04])
    head = four + crc16(four[2:] + _SIDE).to_bytes(2, "big") + _SIDE
    return head, parse_header(four).size - len(head)


def store_payload(payload: bytes, level: int = 14) -> bytes:
    """Bytes as an MPEG stream: ID3v2 tag with the payload's length, Info table with seek points, frames."""
    head, room = _frame_head(level)
    bodies = [payload[i : i + room] for i in range(0, len(payload), room)]
    frames = []
    for body in bodies[:-1]:
        frames += (head, body)
    if bodies:  # the last frame takes the least bitrate that holds it
        last = next(i for i in range(1, 15) if _frame_head(i)[1] >= len(bodies[-1]))
        frames += (_frame_head(last)[0], bodies[-1], bytes(_frame_head(last)[1] - len(bodies[-1])))
    audio = b"".join(frames)
    info_head, info_room = _frame_head(9)
    whole = len(audio) + len(info_head) + info_room
    count = len(bodies)
    frame = len(head) + room
    toc = bytes(min(255, (len(info_head) + info_room + k * count // 100 * frame) * 256 // whole) for k in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + count.to_bytes(4, "big") + whole.to_bytes(4, "big") + toc
    private = _PAYLOAD_OWNER + len(payload).to_bytes(8, "big")
    tag = b"PRIV" + len(private).to_bytes(4, "big") + b"\0\0" + private
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + info_head + info + bytes(info_room - len(info)) + audio


def load_payload(media: bytes, stream: Stream | None = None) -> bytes:
    """The payload of a stored stream, from its frames' bodies."""
    stream = stream or parse_stream(media)
    private = stream.tags.get("PRIV", b"")
    if not private.startswith(_PAYLOAD_OWNER):
        raise ValueError("the stream holds no payload")
    size = int.from_bytes(private[len(_PAYLOAD_OWNER) :], "big")
    bodies = [media[at + 6 + head.side : at + head.size] for at, head in zip(stream.offsets, stream.headers, strict=True)]
    return b"".join(bodies)[:size]


def padded(data: bytes, block: int = 64) -> bytes:
    """Zeros up to a positive multiple of the block."""
    return data + bytes(max(block, -(-len(data) // block) * block) - len(data))


def audio_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as an MPEG stream, read the stored bytes back and describe them.

    Null text counts as empty (its payload is one block of zeros); rows are independent, so repeated rows,
    null keys, long texts and further columns are fine; equal texts give equal values. Returns doc_id, n_bytes,
    payload (read back), media, samples and rate (the exact duration as a fraction), seconds, frames, crc_checked,
    crc_bad, skipped, table_frames and seek_offsets (byte position of each frame).
    """

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for low in range(0, len(keys), 256):
                sizes, payloads, medias, streams = [], [], [], []
                for content in utf8(batch.column(1).slice(low, 256)):
                    media = store_payload(padded(content or b""))
                    stream = parse_stream(media)
                    sizes.append(len(content or b""))
                    payloads.append(load_payload(media, stream))
                    medias.append(media)
                    streams.append(stream)
                columns = [
                    keys.slice(low, 256), pa.array(sizes, pa.int64()), pa.array(payloads, pa.binary()), pa.array(medias, pa.binary()),
                    pa.array([s.duration for s in streams], pa.int64()), pa.array([s.rate for s in streams], pa.int64()), pa.array([s.seconds for s in streams]),
                    pa.array([len(s.headers) for s in streams], pa.int64()), pa.array([s.crc_checked for s in streams], pa.int64()), pa.array([s.crc_bad for s in streams], pa.int64()),
                    pa.array([s.skipped for s in streams], pa.int64()), pa.array([int(s.table.get("frames", -1)) for s in streams], pa.int64()), pa.array([s.offsets for s in streams], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    pairs = keyed_texts(docs, key, text)
    kind = pairs.schema["doc_id"].dataType.simpleString()
    return map_arrow(pairs, run, f"doc_id {kind}, n_bytes bigint, payload binary, media binary, samples bigint, rate bigint, seconds double, frames bigint, crc_checked bigint, crc_bad bigint, skipped bigint, table_frames bigint, seek_offsets array<bigint>")


def parse_media(media: DataFrame, key: str, content: str) -> DataFrame:
    """Describe streams of a binary column: key, samples, rate, seconds, frames, crc_checked, crc_bad, skipped, table kind, seek_offsets.

    A null or empty value has no frames and a duration of 0.
    """

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [parse_stream(x or b"") for x in batch.column(1).to_pylist()]
            columns = [
                batch.column(0), pa.array([s.duration for s in streams], pa.int64()), pa.array([s.rate for s in streams], pa.int64()), pa.array([s.seconds for s in streams]), pa.array([len(s.headers) for s in streams]), pa.array([s.crc_checked for s in streams]),
                pa.array([s.crc_bad for s in streams]), pa.array([s.skipped for s in streams]), pa.array([s.table.get("kind") for s in streams], pa.string()), pa.array([s.offsets for s in streams], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    picked = media.select(key, content)
    kind = picked.schema[key].dataType.simpleString()
    return map_arrow(picked, run, f"`{key}` {kind}, samples bigint, rate bigint, seconds double, frames bigint, crc_checked bigint, crc_bad bigint, skipped bigint, table string, seek_offsets array<bigint>")
