"""Decoding of recordings inside Arrow batches: PCM containers and FLAC here, other codecs by registered decoders."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from echolot.functions import signal
from echolot.sources import flac
from echolot.sources.folder import map_listed


class DecodeError(Exception):
    """The message becomes the skip reason."""


@dataclass
class Decoded:
    """Mono samples at the fingerprint's rate, and what the file says about itself."""

    samples: np.ndarray
    source_rate: float
    channels: int
    bit_depth: int | None
    codec: str
    duration: float
    truncated: bool


@dataclass
class Pcm:
    """Interleaved frames as floats."""

    frames: np.ndarray
    rate: float
    bit_depth: int | None
    codec: str


def _companded(data: bytes, law: str) -> np.ndarray:
    """A-law and mu-law bytes as floats (G.711)."""
    raw = np.frombuffer(data, np.uint8).astype(np.int32)
    if law == "pcm_mulaw":
        raw = ~raw & 0xFF
        magnitude = (((raw & 15) << 3) + 132 << (raw >> 4 & 7)) - 132
        return np.where(raw & 128, -magnitude, magnitude) / 32768.0
    raw = raw ^ 0x55
    exponent = raw >> 4 & 7
    base = (raw & 15) << 4
    magnitude = np.where(exponent == 0, base + 8, (base + 264) << np.maximum(exponent - 1, 0))
    return np.where(raw & 128, magnitude, -magnitude) / 32768.0


def _integers(data: bytes, bits: int, big: bool, unsigned: bool = False) -> np.ndarray:
    size = (bits + 7) // 8
    data = data[: len(data) // size * size]
    if size == 3:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        raw = raw[:, ::-1] if big else raw
        value = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
        return (value - ((value >> 23) << 24)) / float(1 << 23)
    if unsigned:
        return (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    return np.frombuffer(data, f"{'>' if big else '<'}i{size}") / float(1 << (8 * size - 1))


def _pcm(data: bytes, channels: int, rate: float, bits: int, kind: str, big: bool) -> Pcm:
    order = "be" if big else "le"
    if kind == "float":
        values, codec = np.frombuffer(data[: len(data) // (bits // 8) * (bits // 8)], f"{'>' if big else '<'}f{bits // 8}"), f"pcm_f{bits}{order}"
    elif kind in ("pcm_alaw", "pcm_mulaw"):
        values, codec = _companded(data, kind), kind
    else:
        values = _integers(data, bits, big, kind == "unsigned")
        codec = ("pcm_u8" if kind == "unsigned" else "pcm_s8") if bits <= 8 else f"pcm_s{(bits + 7) // 8 * 8}{order}"
    whole = len(values) // channels * channels
    return Pcm(np.asarray(values[:whole], np.float32).reshape(-1, channels), rate, bits if not codec.endswith("law") else 8, codec)


def read_wav(data: bytes) -> Pcm:
    """RIFF or RF64 with integer, float, A-law or mu-law samples; an overlong data size reads to the end."""
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise DecodeError("not a WAV file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
            tag = struct.unpack_from("<H", data, at + 32)[0] if fmt[0] == 0xFFFE else fmt[0]
        elif name == b"data":
            if fmt is None:
                break
            kinds = {1: "unsigned" if fmt[5] <= 8 else "integer", 3: "float", 6: "pcm_alaw", 7: "pcm_mulaw"}
            if tag not in kinds or not fmt[1]:
                raise DecodeError(f"unsupported WAV encoding {tag}")
            return _pcm(data[at + 8 : min(len(data), at + 8 + size)], fmt[1], float(fmt[2]), fmt[5], kinds[tag], False)
        at += 8 + size + size % 2
    raise DecodeError("no audio data in the WAV file")


def _extended(raw: bytes) -> float:
    exponent, mantissa = struct.unpack(">HQ", raw)
    return mantissa * 2.0 ** ((exponent & 0x7FFF) - 16383 - 63)


def read_aiff(data: bytes) -> Pcm:
    """AIFF, and AIFC with uncompressed, little-endian, float or companded samples."""
    if data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise DecodeError("not an AIFF file")
    at, common = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "big")
        if name == b"COMM":
            channels, _, bits = struct.unpack_from(">HIH", data, at + 8)
            kind = data[at + 26 : at + 30] if data[8:12] == b"AIFC" else b"NONE"
            common = (channels, bits, _extended(data[at + 16 : at + 26]), kind)
        elif name == b"SSND" and common:
            channels, bits, rate, kind = common
            start = at + 16 + int.from_bytes(data[at + 8 : at + 12], "big")
            kinds = {b"NONE": ("integer", True), b"twos": ("integer", True), b"sowt": ("integer", False), b"fl32": ("float", True), b"FL32": ("float", True), b"fl64": ("float", True), b"alaw": ("pcm_alaw", True), b"ulaw": ("pcm_mulaw", True)}
            if kind not in kinds or not channels:
                raise DecodeError(f"unsupported AIFF encoding {kind.decode('latin-1')}")
            return _pcm(data[start : at + 8 + size], channels, rate, bits, *kinds[kind])
        at += 8 + size + size % 2
    raise DecodeError("no audio data in the AIFF file")


def read_caf(data: bytes) -> Pcm:
    """Core Audio files with linear PCM."""
    if data[:4] != b"caff":
        raise DecodeError("not a CAF file")
    at, desc = 8, None
    while at + 12 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 12], "big", signed=True)
        if name == b"desc":
            desc = struct.unpack_from(">d4sIIIII", data, at + 12)
        elif name == b"data" and desc:
            rate, form, flags, _, _, channels, bits = desc
            if form != b"lpcm" or not channels:
                raise DecodeError(f"unsupported CAF encoding {form.decode('latin-1')}")
            stop = len(data) if size < 0 else at + 12 + size
            return _pcm(data[at + 16 : stop], channels, rate, bits, "float" if flags & 1 else "integer", not flags & 2)
        at += 12 + max(size, 0)
    raise DecodeError("no audio data in the CAF file")


def read_flac(data: bytes) -> Pcm:
    """Native FLAC streams."""
    try:
        samples, rate, depth = flac.decode(data)
    except flac.FlacError as e:
        raise DecodeError(str(e)) from e
    return Pcm((samples / float(1 << (depth - 1))).astype(np.float32), float(rate), depth, "flac")


def without_priming(pcm: Pcm, frames: int) -> Pcm:
    """A decoder's output without the frames that its encoder put before the sound.

    AAC encoders put 1024 there; a decoder that is registered for AAC and doesn't drop them itself should.
    """
    return Pcm(pcm.frames[frames:], pcm.rate, pcm.bit_depth, pcm.codec)


#: Decoders by extension. Codecs without a library here (MP3, AAC, Vorbis ...) can be registered.
DECODERS: dict[str, Callable[[bytes], Pcm]] = {"flac": read_flac, "wav": read_wav, "wave": read_wav, "aif": read_aiff, "aiff": read_aiff, "aifc": read_aiff, "caf": read_caf}


#: Frames before the sound that AAC encoders make (fixed value).
AAC_PRIMING = 1024


def register_decoder(extension: str, decoder: Callable[[bytes], Pcm], priming: int = 0) -> None:
    """Decode files of an extension with a function from bytes to Pcm; it travels to the executors with each job.

    The first `priming` frames are dropped (AAC_PRIMING for AAC decoders that leave them in).
    """
    DECODERS[extension.lower()] = (lambda data: without_priming(decoder(data), priming)) if priming else decoder


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""


def decode_mono(path: str, data: bytes, rate: float = signal.RATE, maximum_seconds: float | None = None, decoders: dict[str, Callable[[bytes], Pcm]] | None = None) -> Decoded:
    """Mean of the channels at the given rate, of at most so many seconds."""
    decoder = (DECODERS if decoders is None else decoders).get(extension_of(path))
    if decoder is None:
        raise DecodeError(f"no {extension_of(path).upper() or 'such'} decoder registered")
    pcm = decoder(data)
    if not len(pcm.frames) or not pcm.rate:
        raise DecodeError("the file holds no audio")
    whole = len(pcm.frames) / pcm.rate
    used = pcm.frames if maximum_seconds is None else pcm.frames[: int(maximum_seconds * pcm.rate)]
    samples = signal.resample(signal.downmix(used), pcm.rate, rate)
    return Decoded(samples, pcm.rate, pcm.frames.shape[1], pcm.bit_depth, pcm.codec, whole, len(used) / pcm.rate < whole - 0.05)


ANALYSIS = (
    "idx bigint, duration double, content_duration double, sample_rate double, bit_depth int, channel_count int, codec string, codec_is_lossless boolean,"
    " leading double, trailing double, truncated boolean, values array<bigint>, shape array<smallint>, flux double, error string"
)


def analyze_content(files: DataFrame, minimum_duration: float = 2.0, maximum_seconds: float = 120.0) -> DataFrame:
    """Decode and fingerprint files (idx, path, content). What can't be used has an error and nulls."""
    from echolot.functions.formats import LOSSLESS_CODECS

    decoders = dict(DECODERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for idx, path, content in zip(batch["idx"], batch["path"], batch["content"], strict=True):
                row = dict.fromkeys((c.split()[0] for c in ANALYSIS.split(", ")), None) | {"idx": idx}
                try:
                    got = decode_mono(path, bytes(content), signal.RATE, maximum_seconds, decoders)
                    if got.duration < minimum_duration:
                        raise DecodeError(f"shorter than {minimum_duration:g}s")
                    print_, lead, trail = signal.analyze(got.samples)
                    depth = None if got.codec in ("flac", "alac") or not got.bit_depth else got.bit_depth
                    row |= {"duration": got.duration, "sample_rate": got.source_rate, "bit_depth": depth, "channel_count": got.channels, "codec": got.codec, "codec_is_lossless": got.codec in LOSSLESS_CODECS}
                    row |= {"leading": lead, "trailing": trail, "truncated": got.truncated, "content_duration": max(0.0, got.duration - lead - (0.0 if got.truncated else trail))}
                    row |= {"values": print_.values, "shape": print_.shape, "flux": print_.flux}
                except DecodeError as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANALYSIS.split(", ")])

    return files.select("idx", "path", "content").mapInPandas(run, ANALYSIS)


def analyze_files(spark: SparkSession, files: DataFrame, minimum_duration: float = 2.0, maximum_seconds: float = 120.0) -> DataFrame:
    """Decode and fingerprint the files that a table (idx, path) lists."""
    return map_listed(spark, files, lambda content: analyze_content(content, minimum_duration, maximum_seconds), "analysed")


def decode(files: DataFrame, rate: float = signal.RATE, maximum_seconds: float | None = None) -> DataFrame:
    """Samples of files (idx, path, content) as arrays of floats, for a PCM dump; undecodable files have an error."""
    decoders = dict(DECODERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for idx, path, content in zip(batch["idx"], batch["path"], batch["content"], strict=True):
                try:
                    rows.append((idx, decode_mono(path, bytes(content), rate, maximum_seconds, decoders).samples, None))
                except DecodeError as e:
                    rows.append((idx, None, str(e)))
            yield pd.DataFrame(rows, columns=["idx", "samples", "error"])

    return files.select("idx", "path", "content").mapInPandas(run, "idx bigint, samples array<float>, error string")


def probe(files: DataFrame) -> DataFrame:
    """What decoders say about files (idx, path, content): codec, rate, channels, depth, frames, error."""
    decoders = dict(DECODERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for idx, path, content in zip(batch["idx"], batch["path"], batch["content"], strict=True):
                try:
                    decoder = decoders.get(extension_of(path))
                    if decoder is None:
                        raise DecodeError("no decoder registered")
                    pcm = decoder(bytes(content))
                    rows.append((idx, pcm.codec, pcm.rate, pcm.frames.shape[1], pcm.bit_depth, len(pcm.frames), None))
                except DecodeError as e:
                    rows.append((idx, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["idx", "codec", "rate", "channels", "bit_depth", "frames", "error"])

    return files.select("idx", "path", "content").mapInPandas(run, "idx bigint, codec string, rate double, channels int, bit_depth int, frames bigint, error string")


def best_alignment(a: DataFrame, b: DataFrame, reach: int = 600, least: int = 64) -> DataFrame:
    """Two fingerprints (one row with values each) at the offset of least bit error, over all offsets."""
    for side in (a, b):
        if side.limit(2).count() != 1:
            raise ValueError("one fingerprint on each side")
    left = a.select("values").withColumnRenamed("values", "va")
    pairs = left.crossJoin(b.select("values").withColumnRenamed("values", "vb"))  # one row each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [signal.best_alignment(np.asarray(x), np.asarray(y), reach, least) for x, y in zip(batch["va"], batch["vb"], strict=True)]
            yield pd.DataFrame([f or (None, None, None) for f in found], columns=["ber", "off", "overlap"])

    return pairs.mapInPandas(run, "ber double, off bigint, overlap bigint")
