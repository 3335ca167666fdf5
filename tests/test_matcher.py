from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from echolot.functions.signal import shape_distance
from echolot.operators import matcher
from echolot.options import KeepRule, Level, MatchOptions

SCHEMA = "idx bigint, values array<bigint>, shape array<smallint>, flux double, duration double"


def rows(*values, flux=1.0, shape=(), duration=None):
    return [(i, [int(x) for x in v], list(shape), flux, duration) for i, v in enumerate(values)]


def groups_by_brute_force(made, options):
    """The matching rules over all pairs, with dictionaries."""
    buckets, scores = defaultdict(list), {}
    good = {i: (np.array(v, np.int64), np.array(s), f, d if d is not None else len(v) * 512 / 11025) for i, v, s, f, d in made if len(v) >= 64}
    for i, (v, *_) in good.items():
        for pos in range(0, len(v), 2):
            buckets["low", int(v[pos]) & 0xFFFF].append((i, pos))
            buckets["high", int(v[pos]) >> 16].append((i, pos))
    votes = defaultdict(Counter)
    for entries in buckets.values():
        if 2 <= len(entries) <= 400:
            for (i, p), (j, q) in combinations(sorted(entries), 2):
                if i != j:
                    votes[i, j][p - q] += 1
    for i, j in combinations(sorted(good), 2):
        (v, s, f, d), (w, t, g, e) = good[i], good[j]
        still = f < 0.10 and g < 0.10
        near = abs(d - e) <= max(0.5, max(d, e) * options.stationary_tolerance)
        if votes[i, j] and (not still or near):
            n, off = max((n, -off) for off, n in votes[i, j].items())
            off = -off
            a, b = v[max(off, 0) :], w[max(-off, 0) :]
            overlap = min(len(a), len(b))
            share = overlap >= 0.95 * max(len(v), len(w)) if options.whole_file else overlap >= 0.25 * min(len(v), len(w))
            errors = int(np.bitwise_count((a[:overlap] ^ b[:overlap]).astype(np.uint64)).sum()) / (32 * overlap) if overlap else 1.0
            if n >= 6 and share and overlap * 512 / 11025 >= 3.0 and errors <= options.max_bit_error:
                scores[i, j] = min(1.0, max(0.0, 1 - errors / 0.5))
        if still and near and (apart := shape_distance(s, t)) <= options.max_shape_distance:
            scores[i, j] = max(scores.get((i, j), 0.0), min(1.0, max(0.0, 1 - apart / 0.6)))
    label = {i: i for pair in scores for i in pair}
    for i, j in scores:
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = {k: new if x == old else x for k, x in label.items()}
    weakest = defaultdict(lambda: 1.0)
    for (i, _), score in scores.items():
        weakest[label[i]] = min(weakest[label[i]], score)
    return {i: (c, pytest.approx(weakest[c], abs=1e-9)) for i, c in label.items()}


def recordings():
    """Prints of tunes in several encodings: noise up to the limits, excerpts, shifts, steady tones and strangers."""
    rng = np.random.default_rng(11)
    made = []
    noisy = lambda v, rate: v ^ (rng.random((len(v), 32)) < rate) @ (1 << np.arange(32))
    for tune in range(4):
        whole = rng.integers(0, 2**32, 150)
        made += [noisy(whole, rate) for rate in (0, 0.01, 0.04, 0.08, 0.11)] + [noisy(whole, 0.02)[30 + tune :], noisy(whole[: 66 + tune], 0.02), noisy(whole, 0.03)[2:]]
    prints = [(i, v.tolist(), [], 0.3, None if i % 2 else len(v) * 0.0464) for i, v in enumerate(made)]
    for shape in rng.integers(0, 256, (3, 33)):
        for k in range(4):
            blurred = np.clip(shape + rng.integers(-40 * k, 40 * k + 1, 33), 0, 255)
            values = [int(x) for x in rng.integers(0, 2**32, 70)]
            prints.append((len(prints), values, blurred.tolist(), 0.02 + 0.03 * k, 4.0 + 0.2 * k))
    return prints + [(len(prints), [1] * 63, [9] * 33, 0.01, 4.0)]


@pytest.mark.parametrize("level", list(Level))
def test_groups_equal_brute_force(spark, level):
    made, options = recordings(), MatchOptions.for_level(level)
    want = groups_by_brute_force(made, options)
    got = {r.idx: (r.rep, r.confidence) for r in matcher.match_groups(spark.createDataFrame(made, SCHEMA), options).collect()}
    assert got == want and len(want) > 10


def test_joint_keys(spark):
    """Keys of two values: the same links at little noise, with far fewer files to a key."""
    rng = np.random.default_rng(4)
    noisy = lambda v, rate: v ^ (rng.random((len(v), 32)) < rate) @ (1 << np.arange(32))
    tunes = [rng.integers(0, 2**32, 1000) for _ in range(6)]
    fps = spark.createDataFrame(rows(*(noisy(t, r) for t in tunes for r in (0, 0.04, 0.08))), SCHEMA)
    plain, joint = (MatchOptions.for_level("very-strict", joint_keys=x) for x in (False, True))
    found = [{(r.a, r.b): round(r.score, 9) for r in matcher.match_edges(fps, o).collect()} for o in (plain, joint)]
    assert found[0] == found[1] and len(found[0]) == 18
    keys = [matcher.postings(fps, o).groupBy("key").count().agg({"count": "avg"}).first()[0] for o in (plain, joint)]
    assert keys[1] < keys[0]


def test_excerpt_matches_only_without_whole_file(spark):
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 2**32, 400)
    fps = spark.createDataFrame(rows(whole, whole[100:260]), SCHEMA)
    assert matcher.match_edges(fps, MatchOptions.for_level("perfect")).count() == 0
    [edge] = matcher.match_edges(fps, MatchOptions.for_level("very-strict")).collect()
    assert (edge.a, edge.b, edge.score) == (0, 1, 1.0)


@pytest.mark.parametrize(("frames", "links"), [(63, 0), (64, 0), (65, 1)])
def test_least_frames_and_seconds(spark, frames, links):
    values = np.random.default_rng(2).integers(0, 2**32, frames)
    fps = spark.createDataFrame(rows(values, values), SCHEMA)
    assert matcher.match_edges(fps, MatchOptions.for_level("perfect")).count() == links


def test_key_bounds(spark):
    entries = spark.createDataFrame([(1, i, i) for i in range(400)] + [(2, i, i) for i in range(401)] + [(3, 0, 0)], "key bigint, idx bigint, pos int")
    kept = matcher.index_entries(entries, MatchOptions()).select("key").distinct().collect()
    assert [r.key for r in kept] == [1]


def test_offset_ties_take_the_smallest(spark):
    voted = spark.createDataFrame([(0, 1, 4, 6), (0, 1, -2, 6), (0, 1, 8, 5), (0, 2, 0, 5)], "a bigint, b bigint, off bigint, n bigint")
    assert [tuple(r) for r in matcher.best_offsets(voted, MatchOptions()).collect()] == [(0, 1, -2, 6)]


def test_alignment_at_negative_offsets_and_without_overlap(spark):
    a, b = list(range(100)), list(range(-10, 90))
    fps = spark.createDataFrame([(0, a, [], 1.0, None), (1, [x % 2**32 for x in b], [], 1.0, None)], SCHEMA)
    pairs = spark.createDataFrame([(0, 1, -10, 9), (0, 1, 500, 9)], "a bigint, b bigint, off bigint, n bigint")
    got = {r.off: (r.overlap, r.errors, r.ber) for r in matcher.aligned(pairs, fps, MatchOptions()).collect()}
    assert got == {-10: (90, 0, 0.0), 500: (0, 0, 1.0)}


def test_length_gate_for_stationary_only(spark):
    shape = [255] * 33
    close = [(0, [7] * 100, shape, 0.01, 4.0), (1, [9] * 100, shape, 0.01, 4.5), (2, [5] * 100, shape, 0.01, 5.1), (3, [3] * 100, shape, 0.5, 4.0)]
    got = matcher.shape_edges(spark.createDataFrame(close, SCHEMA), MatchOptions.for_level("strict")).collect()
    assert sorted((r.a, r.b) for r in got) == [(0, 1)]


def test_shape_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    options = MatchOptions.for_level("relaxed")
    made = [(i, [i] * 70, rng.integers(0, 256, 33).tolist(), 0.01, float(d)) for i, d in enumerate(rng.uniform(0.1, 60, 60))]
    got = {(r.a, r.b) for r in matcher.shape_edges(spark.createDataFrame(made, SCHEMA), options).collect()}
    want = set()
    for i, _, s, _, d in made:
        for j, _, t, _, e in made[i + 1 :]:
            if abs(d - e) <= max(0.5, max(d, e) * 0.10) and shape_distance(np.array(s), np.array(t)) <= 0.33:
                want.add((i, j))
    assert got == want


def test_parsing():
    assert Level.parse("Very_Strict") is Level.VERY_STRICT and KeepRule.parse("best-quality") is KeepRule.BEST_QUALITY
    assert Level.PERFECT.label == "Perfect" and MatchOptions().max_bit_error == 0.22
    with pytest.raises(ValueError):
        Level.parse("lenient")
