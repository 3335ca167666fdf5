"""The FLAC decoder against a plain encoder of every kind of subframe."""

import numpy as np
import pytest

from echolot.sources import audio, flac


class Bits:
    def __init__(self):
        self.text = []

    def put(self, value, width):
        if width:
            self.text.append(f"{value & ((1 << width) - 1):0{width}b}")

    def bytes(self):
        text = "".join(self.text)
        text += "0" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big")


def residual(bits, values, order, partition_order, k, escape=False):
    bits.put(0, 2)
    bits.put(partition_order, 4)
    size, at = (len(values) + order) >> partition_order, 0
    for p in range(1 << partition_order):
        part = values[at : at + size - (0 if p else order)]
        at += len(part)
        if escape and p == 0:
            bits.put(15, 4)
            bits.put(18, 5)
            for v in part:
                bits.put(int(v), 18)
            continue
        bits.put(k, 4)
        for v in part:
            folded = 2 * int(v) if v >= 0 else -2 * int(v) - 1
            bits.text.append("0" * (folded >> k) + "1")
            bits.put(folded, k)


def subframe(bits, x, kind, depth, wasted=0):
    bits.put(0, 1)
    x = [int(v) >> wasted for v in x]
    code = {"constant": 0, "verbatim": 1}.get(kind)
    if code is None:
        code = 8 + kind if isinstance(kind, int) else 31 + len(kind[0])
    bits.put(code, 6)
    bits.put(1 if wasted else 0, 1)
    if wasted:
        bits.text.append("0" * (wasted - 1) + "1")
    depth -= wasted
    if kind == "constant":
        bits.put(x[0], depth)
    elif kind == "verbatim":
        for v in x:
            bits.put(v, depth)
    else:
        coefficients, shift = (flac._FIXED[kind], 0) if isinstance(kind, int) else kind
        order = len(coefficients)
        for v in x[:order]:
            bits.put(v, depth)
        if not isinstance(kind, int):
            bits.put(11, 4)
            bits.put(shift, 5)
            for c in coefficients:
                bits.put(c, 12)
        errors = [x[t] - (sum(c * x[t - 1 - i] for i, c in enumerate(coefficients)) >> shift) for t in range(order, len(x))]
        residual(bits, errors, order, 0 if len(x) % 4 else 2, 7, escape=order == 2)


def frame(number, channels, kinds, assignment, depth=16, wasted=0):
    block = len(channels[0])
    head = bytes([0xFF, 0xF8, 7 << 4 | 9, assignment << 4 | {16: 4, 24: 6}[depth] << 1, number]) + (block - 1).to_bytes(2, "big")
    head += bytes([flac.crc(head, 8, 0x07)])
    bits = Bits()
    for c, (x, kind) in enumerate(zip(channels, kinds)):
        subframe(bits, x, kind, depth + (assignment in (8, 10) and c == 1 or assignment == 9 and c == 0), wasted)
    body = head + bits.bytes()
    return body + flac.crc(body, 16, 0x8005).to_bytes(2, "big")


def stream(frames, channels=2, depth=16):
    info = bytes(10) + (44100 << 44 | (channels - 1) << 41 | (depth - 1) << 36).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + (4).to_bytes(3, "big") + bytes(4) + b"".join(frames)


def test_all_kinds():
    rng = np.random.default_rng(2)
    t = np.arange(400)
    left = (9000 * np.sin(t / 9) + 500 * rng.standard_normal(400)).astype(int)
    right = (left * 0.8 + 300 * rng.standard_normal(400)).astype(int)
    lpc = ((1900, -900, 40, 7, -3), 10)
    frames, want = [], []
    for n, (kinds, assignment) in enumerate([(("verbatim", 0), 1), ((1, 2), 1), ((3, 4), 1), ((lpc, "verbatim"), 1), ((lpc, 1), 8), ((2, lpc), 9), ((lpc, lpc), 10)]):
        a, b = {8: (left, left - right), 9: (left - right, right), 10: ((left + right) >> 1, left - right)}.get(assignment, (left, right))
        frames.append(frame(n, (a, b), kinds, assignment))
        want.append(np.stack([left, right], 1))
    frames.append(frame(9, (left[:37], np.full(37, -5)), (1, "constant"), 1))
    want.append(np.stack([left[:37], np.full(37, -5)], 1))
    samples, rate, depth = flac.decode(stream(frames))
    assert (rate, depth) == (44100, 16) and np.array_equal(samples, np.concatenate(want))
    pcm = audio.read_flac(stream(frames))
    assert pcm.codec == "flac" and pcm.frames.dtype == np.float32 and pcm.frames[5, 0] == np.float32(left[5] / 32768)


def test_wasted_bits_depth_and_damage():
    x = (np.arange(64) * 4096 - 100_000).astype(int) & ~7
    good = frame(0, (x,), (2,), 0, depth=24, wasted=3)
    samples, _, depth = flac.decode(stream([good, b"\xff\xf8junk", good[:-1] + b"\0", good], 1, 24))
    assert depth == 24 and np.array_equal(samples[:, 0], np.concatenate([x, x]))
    for broken in (b"", b"fLaC", stream([]), stream([good[:20]], 1, 24), b"RIFF"):
        with pytest.raises(audio.DecodeError):
            audio.read_flac(broken)
    tagged = b"ID3\x04\0\0\0\0\0\x05hello" + stream([good], 1, 24)
    assert len(flac.decode(tagged)[0]) == 64


def test_checksums():
    assert flac.crc(b"123456789", 8, 0x07) == 0xF4 and flac.crc(b"123456789", 16, 0x8005) == 0xFEE8


def test_priming_is_dropped(monkeypatch):
    monkeypatch.setattr(audio, "DECODERS", dict(audio.DECODERS))
    audio.register_decoder("aac", lambda data: audio.Pcm(np.arange(3000, dtype=np.float32).reshape(-1, 1), 11025.0, None, "aac"), audio.AAC_PRIMING)
    assert audio.decode_mono("/x/a.aac", b"").samples[0] == 1024
