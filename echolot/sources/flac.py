"""FLAC streams (RFC 9639) in numpy: residuals frame by frame, prediction for many subframes at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Subframes whose prediction is undone together, and the most coefficients of one.
_TOGETHER, _ORDER = 512, 32
# fixed values of the format: samples of a block, Hz and bits of a sample by code; fixed predictors by order
_BLOCKS = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


class FlacError(ValueError):
    """The stream breaks the format."""


def crc(data: bytes, bits: int, polynomial: int) -> int:
    """The checksums of the format: start 0, most significant bit first."""
    table = _table(bits, polynomial)
    value, mask = 0, (1 << bits) - 1
    for byte in data:
        value = (value << 8 ^ table[value >> (bits - 8) ^ byte]) & mask
    return value


_tables: dict[tuple[int, int], list[int]] = {}


def _table(bits: int, polynomial: int) -> list[int]:
    if (bits, polynomial) not in _tables:
        rows = []
        for byte in range(256):
            value = byte << (bits - 8)
            for _ in range(8):
                value = value << 1 ^ (polynomial if value >> (bits - 1) & 1 else 0)
            rows.append(value & ((1 << bits) - 1))
        _tables[bits, polynomial] = rows
    return _tables[bits, polynomial]


class _Bits:
    """Reader of the bits of one stretch of bytes."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        ones = np.where(self.bits, np.arange(len(self.bits)), len(self.bits))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1].tolist()
        self.number, self.size, self.at = int.from_bytes(data, "big"), len(self.bits), 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > self.size:
            raise FlacError("the stream ends inside a frame")
        return self.number >> (self.size - self.at) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        if self.at >= self.size or self.next_one[self.at] >= self.size:
            raise FlacError("the stream ends inside a frame")
        n = self.next_one[self.at] - self.at
        self.at += n + 1
        return n

    def fields(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Unsigned fields of one width at given places."""
        if len(starts) and starts[-1] + width > self.size:
            raise FlacError("the stream ends inside a frame")
        out = np.zeros(len(starts), np.int64)
        for i in range(width):
            out = out << 1 | self.bits[starts + i]
        return out

    def rice(self, n: int, k: int) -> np.ndarray:
        """Rice codes with k low bits."""
        at, ones, size, ends = self.at, self.next_one, self.size, []
        for _ in range(n):
            if at >= size:
                raise FlacError("the stream ends inside a frame")
            end = ones[at]
            ends.append(end)
            at = end + 1 + k
        found = np.array(ends, np.int64)
        starts = np.concatenate([[self.at], found[:-1] + 1 + k]) if n else found
        self.at = at
        if at > size:
            raise FlacError("the stream ends inside a frame")
        folded = (found - starts) << k | self.fields(found + 1, k)
        return folded >> 1 ^ -(folded & 1)


@dataclass
class _Subframe:
    """What is left of a channel's block to undo: values (warm-up, then residuals), coefficients, shifts."""

    values: np.ndarray
    coefficients: list[int]
    shift: int
    wasted: int


def _subframe(bits: _Bits, block: int, depth: int) -> _Subframe:
    if bits.take(1):
        raise FlacError("broken subframe")
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        return _Subframe(np.full(block, bits.signed(depth), np.int64), [], 0, wasted)
    if kind == 1:
        raw = bits.fields(bits.at + depth * np.arange(block), depth)
        bits.at += depth * block
        return _Subframe(raw - ((raw >> (depth - 1)) << depth), [], 0, wasted)
    if 8 <= kind <= 12:
        order, coefficients, shift = kind - 8, _FIXED[kind - 8], 0
        warm = [bits.signed(depth) for _ in range(order)]
    elif kind >= 32:
        order = kind - 31
        warm = [bits.signed(depth) for _ in range(order)]
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        if precision == 16 or shift < 0:
            raise FlacError("broken predictor")
        coefficients = [bits.signed(precision) for _ in range(order)]
    else:
        raise FlacError("reserved subframe type")
    method = bits.take(2)
    if method > 1:
        raise FlacError("reserved residual coding")
    width, partitions = 4 + method, 1 << bits.take(4)
    parts = [np.array(warm, np.int64)]
    for p in range(partitions):
        n = block // partitions - (0 if p else order)
        if n < 0 or block % partitions:
            raise FlacError("broken partitions")
        k = bits.take(width)
        if k == (1 << width) - 1:
            raw_width = bits.take(5)
            raw = bits.fields(bits.at + raw_width * np.arange(n), raw_width)
            bits.at += raw_width * n
            parts.append(raw - ((raw >> (raw_width - 1)) << raw_width) if raw_width else raw)
        else:
            parts.append(bits.rice(n, k))
    return _Subframe(np.concatenate(parts), coefficients, shift, wasted)


def _undo(subframes: list[_Subframe]) -> list[np.ndarray]:
    """Samples of subframes: each sample's prediction is computed for all of them at once."""
    longest = max(len(s.values) for s in subframes)
    rows = len(subframes)
    order = np.array([len(s.coefficients) for s in subframes])
    weights = np.zeros((rows, _ORDER), np.int64)
    residual = np.zeros((rows, longest), np.int64)
    for row, s in enumerate(subframes):
        weights[row, _ORDER - len(s.coefficients) :] = s.coefficients[::-1]
        residual[row, : len(s.values)] = s.values
    shift = np.array([s.shift for s in subframes])
    out = np.zeros((rows, _ORDER + longest), np.int64)
    used = int(order.max())
    if used:
        narrow = weights[:, _ORDER - used :]
        for t in range(longest):
            guess = np.einsum("ij,ij->i", out[:, _ORDER + t - used : _ORDER + t], narrow) >> shift
            out[:, _ORDER + t] = residual[:, t] + np.where(t >= order, guess, 0)
    else:
        out[:, _ORDER:] = residual
    return [out[row, _ORDER : _ORDER + len(s.values)] << s.wasted for row, s in enumerate(subframes)]


def _frame_header(data: bytes, at: int, rate: int, depth: int) -> tuple[int, int, int, int, int] | None:
    """(bytes, block, rate, channel code, depth) of the frame header at a place, None if there is none."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    block_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    channel_code, depth_code = data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if not block_code or rate_code == 15 or channel_code > 10 or depth_code == 3 or data[at + 3] & 1:
        return None
    lead = data[at + 4]
    extra = 0 if lead < 0x80 else f"{lead:08b}".index("0") - 1 if lead < 0xFF else 6
    pos = at + 5 + extra
    if block_code in (6, 7):
        block = int.from_bytes(data[pos : pos + block_code - 5], "big") + 1
        pos += block_code - 5
    else:
        block = _BLOCKS[block_code]
    if rate_code >= 12:
        size = 1 if rate_code == 12 else 2
        rate = int.from_bytes(data[pos : pos + size], "big") * {12: 1000, 13: 1, 14: 10}[rate_code]
        pos += size
    elif rate_code:
        rate = _RATES[rate_code]
    if pos >= len(data) or crc(data[at:pos], 8, 0x07) != data[pos]:
        return None
    return pos + 1 - at, block, rate, channel_code, _DEPTHS.get(depth_code, depth)


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples as frames x channels, rate, bits of a sample) of a whole stream.

    Leading ID3 tags are skipped. Frames with a wrong checksum and whatever isn't a frame are skipped too; a stream
    without a single whole frame is an error.
    """
    at = 0
    if data[:3] == b"ID3" and len(data) >= 10:
        at = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9])
    if data[at : at + 4] != b"fLaC":
        raise FlacError("not a FLAC file")
    at, rate, depth, last = at + 4, 0, 0, False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = int.from_bytes(data[at + 14 : at + 22], "big")
            rate, depth = info >> 44, (info >> 36 & 31) + 1
        at += 4 + size
    frames: list[tuple[int, list[int]]] = []  # channel code, places of its subframes
    subframes: list[_Subframe] = []
    while at < len(data):
        head = _frame_header(data, at, rate, depth)
        found = head and _frame(data, at, head)
        if not found:
            following = data.find(b"\xff", at + 1)
            at = len(data) if following < 0 else following
            continue
        size, own = found
        rate, depth = head[2], head[4]
        frames.append((head[3], list(range(len(subframes), len(subframes) + len(own)))))
        subframes += own
        at += size
    if not frames:
        raise FlacError("no audio in the FLAC file")
    samples: list[np.ndarray] = []
    for low in range(0, len(subframes), _TOGETHER):
        samples += _undo(subframes[low : low + _TOGETHER])
    blocks = [_joined(code, [samples[k] for k in places]) for code, places in frames]
    width = blocks[0].shape[1]
    return np.concatenate([b for b in blocks if b.shape[1] == width]), rate, depth


def _frame(data: bytes, at: int, head: tuple[int, int, int, int, int]) -> tuple[int, list[_Subframe]] | None:
    """(bytes, subframes) of the frame at a place, None if it is broken."""
    skip, block, _, code, depth = head
    channels = code + 1 if code < 8 else 2
    most = skip + channels * (block * (depth + 1) // 8 + 64) + 2  # coded frames aren't much longer than plain ones
    stretch = min(len(data), at + most)
    while True:
        bits = _Bits(data[at + skip : stretch])
        try:
            own = [_subframe(bits, block, depth + (code in (8, 10) and c == 1 or code == 9 and c == 0)) for c in range(channels)]
            end = at + skip + -(-bits.at // 8)
            if end + 2 <= stretch and crc(data[at:end], 16, 0x8005) == int.from_bytes(data[end : end + 2], "big"):
                return end + 2 - at, own
            return None
        except FlacError:
            if stretch == len(data) or stretch - at > 4 * most:
                return None
            stretch = min(len(data), at + 4 * most)


def _joined(code: int, channels: list[np.ndarray]) -> np.ndarray:
    """Channels side by side, with stereo differences undone."""
    if code == 8:
        channels = [channels[0], channels[0] - channels[1]]
    elif code == 9:
        channels = [channels[0] + channels[1], channels[1]]
    elif code == 10:
        middle, side = channels
        middle = middle << 1 | side & 1
        channels = [middle + side >> 1, middle - side >> 1]
    return np.stack(channels, 1)
