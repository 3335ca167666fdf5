"""Numpy kernels of the signal front end; they run inside Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# fixed values of the fingerprint
RATE, FRAME, HOP, BANDS = 11025, 4096, 512, 33
LOW_HZ, HIGH_HZ = 300.0, 3000.0
SILENT_PEAK, SILENCE = 1e-5, 0.005
SHAPE_RANGE = 8.0
#: Most values of a matrix that resamples (16 MB); other rates get a kernel for each sample.
RESAMPLER_VALUES = 1 << 21


@dataclass
class Fingerprint:
    values: np.ndarray
    shape: np.ndarray
    flux: float


def content_range(x: np.ndarray) -> tuple[int, int]:
    """Half-open range between leading and trailing silence; everything if all is silent."""
    loud = np.abs(x)
    peak = float(loud.max()) if len(x) else 0.0
    if peak <= SILENT_PEAK:
        return 0, len(x)
    above = np.flatnonzero(loud >= np.float32(SILENCE * peak) if x.dtype == np.float32 else loud >= SILENCE * peak)
    start, end = int(above[0]), int(above[-1]) + 1
    return (start, end) if end > start else (0, len(x))


@lru_cache(maxsize=4)
def window(size: int = FRAME) -> np.ndarray:
    """Periodic Hann window with unit mean square."""
    return (np.sqrt(2 / 3) * 2 * np.sin(np.pi * np.arange(size) / size) ** 2).astype(np.float32)


@lru_cache(maxsize=4)
def band_edges(size: int = FRAME, rate: float = RATE, bands: int = BANDS) -> np.ndarray:
    """Strictly increasing, logarithmically spaced FFT bins."""
    hz = LOW_HZ * (HIGH_HZ / LOW_HZ) ** (np.arange(bands + 1) / bands)
    edges = np.floor(hz * size / rate + 0.5).astype(np.int64)
    for i in range(1, len(edges)):
        edges[i] = max(edges[i], edges[i - 1] + 1)
    return edges


def frame_count(n: int, size: int = FRAME, hop: int = HOP) -> int:
    """Whole frames of a signal; a signal that gives fewer than two has none."""
    return (n - size) // hop + 1 if n >= size + hop else 0


def band_energies(x: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(log10 band energies per frame, linear totals per band over all frames)."""
    count, edges = frame_count(len(x)), band_edges()
    logs, totals = np.zeros((count, BANDS), np.float32), np.zeros(BANDS)
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float32, copy=False), FRAME)[::HOP][:count] if count else np.zeros((0, FRAME), np.float32)
    for low in range(0, count, block):
        power = np.abs(np.fft.rfft(frames[low : low + block] * window(), axis=1)) ** 2
        sums = np.add.reduceat(power[:, : edges[-1]].astype(np.float32), edges[:-1], axis=1)
        logs[low : low + block] = np.log10(sums + np.float32(1e-9))
    totals = logs.sum(0, dtype=np.float64)
    return logs, totals


def sub_fingerprints(logs: np.ndarray) -> np.ndarray:
    """One 32-bit value per frame after the first."""
    steps = logs[:, :-1] - logs[:, 1:]
    bits = steps[1:] - steps[:-1] > 0
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def upper_median(x: np.ndarray) -> float:
    return float(np.sort(x)[len(x) // 2]) if len(x) else float(np.finfo(np.float32).max)


def shape(totals: np.ndarray, frames: int) -> np.ndarray:
    if not frames:
        return np.zeros(0, np.int16)
    means = totals / frames
    rel = np.clip(means - means.max(), -SHAPE_RANGE, 0)
    return np.floor((rel + SHAPE_RANGE) / SHAPE_RANGE * 255 + 0.5).astype(np.int16)


def shape_distance(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b) or not len(a):
        return 1.0
    weight = np.maximum(a, b) / 255.0
    return float((weight * np.abs(a.astype(float) - b)).sum() / weight.sum() / 255) if weight.sum() else 0.0


def fingerprint(x: np.ndarray) -> Fingerprint:
    logs, totals = band_energies(x)
    change = np.abs(logs[1:] - logs[:-1]).sum(1, dtype=np.float32) / np.float32(BANDS) if len(logs) else np.zeros(0, np.float32)
    return Fingerprint(sub_fingerprints(logs) if len(logs) else np.zeros(0, np.int64), shape(totals, len(logs)), upper_median(change))


def analyze(x: np.ndarray, rate: float = RATE) -> tuple[Fingerprint, float, float]:
    """(fingerprint of the content, leading silence, trailing silence in seconds)."""
    start, end = content_range(x)
    return fingerprint(x[start:end]), start / rate, (len(x) - end) / rate


def downmix(x: np.ndarray) -> np.ndarray:
    """Mean of the channels of an array of frames."""
    return x.mean(axis=1, dtype=np.float32) if x.ndim == 2 else x


def _sinc_kernel(t: np.ndarray, half: int, scale: float) -> np.ndarray:
    phase = np.pi * (t / half + 1)
    taper = 0.35875 - 0.48829 * np.cos(phase) + 0.14128 * np.cos(2 * phase) - 0.01168 * np.cos(3 * phase)
    return scale * np.sinc(scale * t) * taper


@lru_cache(maxsize=8)
def _resampler(source: int, target: int, taps: int, cutoff: float) -> tuple[np.ndarray, int] | None:
    """(matrix from a stretch of samples to the ones that it gives, samples from a stretch to the next); None if it would be too large."""
    common = math.gcd(source, target)
    up, down = target // common, source // common
    times = -(-256 // up)
    if (down * times + taps) * up * times > RESAMPLER_VALUES:
        return None
    half, place = taps // 2, np.arange(up * times) * down
    base, k = place // up, np.arange(-half + 1, half + 1)
    kernel = _sinc_kernel(k[None, :] - (place % up / up)[:, None], half, min(1.0, target / source) * cutoff)
    matrix = np.zeros((down * times + taps, up * times))
    matrix[base[:, None] + np.arange(taps), np.arange(up * times)[:, None]] = kernel
    return matrix, down * times


def resample(x: np.ndarray, source: float, target: float, taps: int = 256, cutoff: float = 0.95) -> np.ndarray:
    """Windowed-sinc resampling with a Blackman-Harris window; rates within half a hertz pass through."""
    if abs(source - target) < 0.5 or not len(x):
        return x.astype(np.float32)
    ratio = target / source
    scale = min(1.0, ratio) * cutoff
    half = taps // 2
    n = int(np.floor(len(x) * ratio))
    made = _resampler(int(source), int(target), taps, cutoff) if source == int(source) and target == int(target) else None
    if made:
        matrix, step = made
        stretches = max(1, -(-n // matrix.shape[1]))
        padded = np.zeros(max(stretches * step + taps, half - 1 + len(x)))
        padded[half - 1 : half - 1 + len(x)] = x
        return (np.lib.stride_tricks.sliding_window_view(padded, len(matrix))[: stretches * step : step] @ matrix).astype(np.float32).ravel()[:n]
    padded = np.concatenate([np.zeros(half, np.float32), x.astype(np.float32), np.zeros(half + 1, np.float32)])
    out = np.empty(n, np.float32)
    k = np.arange(-half + 1, half + 1)
    for low in range(0, n, 8192):
        at = np.arange(low, min(low + 8192, n)) / ratio
        base = np.floor(at).astype(np.int64)
        t = k[None, :] - (at - base)[:, None]
        kernel = _sinc_kernel(t, half, scale)
        out[low : low + len(at)] = (padded[base[:, None] + half + k[None, :]] * kernel).sum(1)
    return out


def best_alignment(a: np.ndarray, b: np.ndarray, reach: int = 600, least: int = 64) -> tuple[float, int, int] | None:
    """(bit error rate, offset, overlap) at the best offset; the first of equal minima."""
    best = None
    for offset in range(-reach, reach + 1):
        i, j = max(offset, 0), max(-offset, 0)
        n = min(len(a) - i, len(b) - j)
        if n < least:
            continue
        rate = float(np.bitwise_count((a[i : i + n] ^ b[j : j + n]).astype(np.uint64)).sum()) / (32 * n)
        if best is None or rate < best[0]:
            best = (rate, offset, n)
    return best
