"""Resampling by a matrix for each pair of rates."""

import numpy as np
import pytest

from echolot.functions import signal


def direct(x, source, target, taps=256, cutoff=0.95):
    """Each sample by its own kernel."""
    half, scale = taps // 2, min(1.0, target / source) * cutoff
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + 1)])
    out = []
    for i in range(int(len(x) * (target / source))):
        base, rest = divmod(i * source, target)
        t = np.arange(-half + 1, half + 1) - rest / target
        phase = np.pi * (t / half + 1)
        taper = 0.35875 - 0.48829 * np.cos(phase) + 0.14128 * np.cos(2 * phase) - 0.01168 * np.cos(3 * phase)
        out.append((padded[base + 1 : base + 1 + taps] * scale * np.sinc(scale * t) * taper).sum())
    return np.array(out)


@pytest.mark.parametrize(("source", "target"), [(8000, 11025), (44100, 11025), (48000, 11025), (44101, 11025), (11025, 8000)])
@pytest.mark.parametrize("n", [1, 5, 700, 3001])
def test_resample_equals_direct_kernels(source, target, n):
    x = np.random.default_rng(n).uniform(-1, 1, n).astype(np.float32)
    got, want = signal.resample(x, source, target), direct(x, source, target)
    assert got.dtype == np.float32 and got.shape == want.shape and np.allclose(got, want, atol=1e-6)


def test_kernels_are_computed_once_for_two_rates(monkeypatch):
    calls, kernel = [], signal._sinc_kernel
    monkeypatch.setattr(signal, "_sinc_kernel", lambda *x: calls.append(1) or kernel(*x))
    signal._resampler.cache_clear()
    for _ in range(5):
        signal.resample(np.ones(4000, np.float32), 8000, 11025)
    assert len(calls) == 1
