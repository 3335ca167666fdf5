import numpy as np
import pytest

from echolot.functions import signal


def lcg(seed: int, n: int) -> np.ndarray:
    state, out = seed, []
    for _ in range(n):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(state / 2**31 - 1)
    return np.array(out, np.float32)


def test_window_and_edges():
    w = signal.window()
    assert w.max() == pytest.approx(1.63299, abs=1e-5) and w[0] == 0
    assert np.mean(w.astype(float) ** 2) == pytest.approx(1.0, rel=1e-6)
    edges = signal.band_edges()
    assert len(edges) == 34 and edges[0] == 111 and edges[-1] == 1115 and (np.diff(edges) > 0).all()


def test_content_range_cases():
    assert signal.content_range(np.zeros(1000, np.float32)) == (0, 1000)
    assert signal.content_range(np.full(1000, 0.5, np.float32)) == (0, 1000)
    padded = np.zeros(1000, np.float32)
    padded[300:700] = 0.5
    assert signal.content_range(padded) == (300, 700)
    ramp = (np.arange(1000) / 1000).astype(np.float32)
    assert signal.content_range(ramp) == (5, 1000)
    assert signal.content_range(np.zeros(0, np.float32)) == (0, 0)


def test_framing_and_median():
    assert [signal.frame_count(n) for n in (0, 4096, 4607, 4608, 36863, 36864)] == [0, 0, 0, 2, 64, 65]
    assert signal.upper_median(np.array([4, 1, 3, 2])) == 3 and signal.upper_median(np.array([3, 1, 2])) == 2
    assert signal.upper_median(np.zeros(0)) == np.finfo(np.float32).max


def test_band_energies_match_direct_transform():
    x = lcg(1, 6000)
    logs, totals = signal.band_energies(x)
    edges = signal.band_edges()
    for f in range(len(logs)):
        power = np.abs(np.fft.rfft(x[f * 512 : f * 512 + 4096].astype(float) * signal.window().astype(float))) ** 2
        want = [np.log10(power[a:b].sum() + 1e-9) for a, b in zip(edges[:-1], edges[1:])]
        assert logs[f] == pytest.approx(want, abs=1e-4)
    assert totals == pytest.approx(logs.sum(0), rel=1e-5)


def test_bits_follow_definition():
    logs = lcg(7, 33 * 5).reshape(5, 33)
    values = signal.sub_fingerprints(logs)
    for f in range(1, 5):
        for m in range(32):
            step = (logs[f, m] - logs[f, m + 1]) - (logs[f - 1, m] - logs[f - 1, m + 1])
            assert (int(values[f - 1]) >> m & 1) == int(step > 0)


def test_shape_distance_edges():
    a = np.array([255, 0, 10], np.int16)
    assert signal.shape_distance(a, a) == 0 and signal.shape_distance(a, a[:2]) == 1
    assert signal.shape_distance(np.zeros(3, np.int16), np.zeros(3, np.int16)) == 0


def test_resample_keeps_a_tone():
    t = np.arange(44100) / 44100
    out = signal.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 44100, 11025)
    want = np.sin(2 * np.pi * 440 * np.arange(len(out)) / 11025)
    assert np.abs(out[400:-400] - want[400:-400]).max() < 0.02
    x = lcg(3, 100)
    assert (signal.resample(x, 11025.3, 11025) == x).all()


def test_downmix_and_alignment():
    assert signal.downmix(np.array([[1, 3], [2, 4]], np.float32)).tolist() == [2, 3]
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**32, 300)
    assert signal.best_alignment(a, a[37:]) == (0.0, 37, 263)
    assert signal.best_alignment(a[:10], a) is None
