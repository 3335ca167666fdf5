"""Votes by blocks: no pair leaves a task before it is counted, and blocks don't change results."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from test_matcher import SCHEMA, groups_by_brute_force, recordings, rows

from echolot.operators import matcher
from echolot.options import MatchOptions


def test_votes_are_not_joined(spark):
    values = np.random.default_rng(3).integers(0, 2**32, (4, 80))
    fps = spark.createDataFrame(rows(*values), SCHEMA)
    for made in (matcher.match_edges(fps, MatchOptions()), matcher.pair_votes(fps, MatchOptions())):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan


def some_prints():
    """Random prints of few values, so that keys repeat within and between files; a file of two rows."""
    rng = np.random.default_rng(8)
    return [(i, rng.choice([*range(40), *(x << 16 for x in range(40))], n).tolist(), [], 1.0, None) for i, n in zip((5, 3, 9, 3, 1, 40, 17), (70, 90, 64, 66, 130, 75, 80), strict=True)]


@pytest.mark.parametrize(("entries", "least"), [(10_000_000, 1), (100, 1), (100, 6)])
def test_pair_votes_equal_brute_force(spark, monkeypatch, entries, least):
    monkeypatch.setattr(matcher, "BLOCK_ENTRIES", entries)
    made, keys, votes = some_prints(), defaultdict(list), defaultdict(Counter)
    for i, values, *_ in made:
        for pos in range(0, len(values), 2):
            keys["low", values[pos] & 0xFFFF].append((i, pos))
            keys["high", values[pos] >> 16].append((i, pos))
    for found in keys.values():
        if 2 <= len(found) <= 400:
            for (i, p), (j, q) in combinations(sorted(found), 2):
                if i != j:
                    votes[i, j][p - q] += 1
    want = set()
    for (a, b), offs in votes.items():
        if kept := [(n, -off) for off, n in offs.items() if n >= least]:
            want.add((a, b, -max(kept)[1], max(kept)[0], sum(n for n, _ in kept), len(kept)))
    got = [tuple(r) for r in matcher.pair_votes(spark.createDataFrame(made, SCHEMA), MatchOptions(max_entries_per_key=400), least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 10


@pytest.mark.parametrize("level", ["perfect", "very-relaxed"])
def test_blocks_do_not_change_groups(spark, monkeypatch, level):
    monkeypatch.setattr(matcher, "BLOCK_ENTRIES", 1200)
    monkeypatch.setattr(matcher, "BLOCK_SHAPES", 5)
    made, options = recordings(), MatchOptions.for_level(level)
    got = {r.idx: (r.rep, r.confidence) for r in matcher.match_groups(spark.createDataFrame(made, SCHEMA), options).collect()}
    assert got == groups_by_brute_force(made, options)


def test_shapes_of_other_sizes_and_unknown_ones(spark):
    made = [(0, [1] * 70, [9] * 33, 0.01, 4.0), (1, [2] * 70, [9] * 32, 0.01, 4.0), (2, [3] * 70, None, 0.01, 4.0), (3, [4] * 70, [9] * 33, 0.01, 4.0), (4, [5] * 70, [], 0.01, 4.0)]
    got = matcher.shape_edges(spark.createDataFrame(made, SCHEMA), MatchOptions.for_level("strict")).collect()
    assert [tuple(r) for r in got] == [(0, 3, 1.0)]


def test_empty_table(spark):
    assert matcher.match_edges(spark.createDataFrame([], SCHEMA), MatchOptions()).count() == 0


def test_both_kinds_of_links_meet(spark, monkeypatch):
    """A pair that is linked both ways comes once, with the better score, also if a file has two rows."""
    values = np.random.default_rng(6).integers(0, 2**32, 80)
    other = values.copy()
    other[::9] ^= 0xFFFF
    made = [(i, [int(x) for x in v], s, 0.01, 4.0) for i, v, s in ((0, values, [90] * 33), (1, other, [10] * 33), (2, values, [90] * 33), (2, values, [90] * 33), (7, other[::-1], [90] * 33))]
    for size in (10_000_000, 8):
        monkeypatch.setattr(matcher, "BLOCK_ENTRIES", size)
        monkeypatch.setattr(matcher, "BLOCK_SHAPES", size)
        got = [tuple(r) for r in matcher.match_edges(spark.createDataFrame(made, SCHEMA), MatchOptions.for_level("strict")).collect()]
        assert {(a, b) for a, b, _ in got} == {(0, 1), (0, 2), (0, 7), (1, 2), (2, 7)} and len(got) == 5
        assert all((s == 1.0) == ((a, b) in {(0, 2), (0, 7), (2, 7)}) for a, b, s in got)
