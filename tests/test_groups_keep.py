import pytest

from echolot.operators import exact, groups, keep
from echolot.operators.graph import connected_components

FILES = "rep bigint, idx bigint, path string, byte_size bigint, modified bigint, duration double, content_duration double, sample_rate double, bit_depth int, channel_count int, lossless boolean"


def file(idx, path="/a", size=10, modified=0, duration=1.0, content=None, rate=None, depth=None, channels=None, lossless=None):
    return (0, idx, path, size, modified, duration, duration if content is None else content, rate, depth, channels, lossless)


def kept(spark, rule, *files):
    return keep.keepers(spark.createDataFrame(list(files), FILES), rule).collect()[0].idx


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    edges = spark.createDataFrame(chain + star + [(5, 4), (7000, 7000), (None, 3)], "a bigint, b bigint")
    got = {r.vertex: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)} | {7000: 7000}
    assert connected_components(edges.limit(0)).count() == 0


def test_cycle_of_quality_depends_on_order(spark):
    wav16 = dict(size=10, depth=16, lossless=True)
    flac = dict(size=15, lossless=True)
    wav24 = dict(size=20, depth=24, lossless=True)
    assert kept(spark, "best-quality", file(0, **wav16), file(1, **flac), file(2, **wav24)) == 2
    assert kept(spark, "best-quality", file(0, **wav24), file(1, **flac), file(2, **wav16)) == 2


@pytest.mark.parametrize(
    ("a", "b", "best"),
    [
        (dict(duration=None), dict(), 1),
        (dict(lossless=True, size=99), dict(lossless=False, size=1), 0),
        (dict(lossless=None, size=10), dict(lossless=True, size=20), 0),
        (dict(lossless=False, size=900), dict(lossless=False, size=9000), 1),
        (dict(lossless=True, rate=48000.0, size=30), dict(lossless=True, rate=44100.0), 0),
        (dict(lossless=True, rate=48000.0, size=30), dict(lossless=True), 1),
        (dict(lossless=True, path="/longer"), dict(lossless=True), 1),
        (dict(), dict(), 1),
    ],
)
def test_quality_rules(spark, a, b, best):
    assert kept(spark, "best-quality", file(0, **a), file(1, **b)) == best


def test_incomplete_files_lose(spark):
    assert kept(spark, "best-quality", file(0, lossless=True, duration=10.0, content=5.0), file(1, lossless=False, duration=10.0)) == 1


def test_other_rules_and_ties(spark):
    files = [file(0, "/a/b/c", 5, 3), file(1, "/a/b", 9, 1), file(2, "/a/z", 9, 3), file(3, "/a/b/d", 5, 1)]
    got = {rule: kept(spark, rule, *files) for rule in ("largest", "smallest", "oldest", "newest", "shallowest")}
    assert got == {"largest": 2, "smallest": 0, "oldest": 1, "newest": 2, "shallowest": 1}


def test_marks_never_empty_a_group(spark):
    rows = spark.createDataFrame([file(0), file(1)], FILES)
    assert keep.refuse_empty_groups(rows, rows).count() == 0
    assert keep.refuse_empty_groups(rows, keep.marks(rows, "oldest")).count() == 1


def test_exact_pass(spark):
    files = spark.createDataFrame([(0, 5, "x"), (1, 5, "x"), (2, 5, "y"), (3, 6, "x"), (4, 7, None), (5, 7, None)], "idx bigint, byte_size bigint, content_hash string")
    assert sorted(r.idx for r in exact.size_candidates(files).collect()) == [0, 1, 2, 4, 5]
    made = exact.exact_groups(exact.size_candidates(files))
    assert [(r.files, r.rep, r.reclaimable) for r in made.collect()] == [(2, 0, 5)]
    found = exact.exact_members(files.where("idx < 2"), made)
    assert sorted(map(tuple, found.collect())) == [(0, 0), (1, 0)]
    assert sorted(r.idx for r in exact.representatives(files, found).collect()) == [0, 2, 3, 4, 5]
    marked = files.withColumn("tag", files.byte_size.cast("string")).selectExpr("idx", "CASE WHEN idx <> 1 THEN tag END AS tag")
    assert {r.idx: r.tag for r in exact.fill_from_representative(marked, found, ["tag"]).collect()}[1] == "5"


def test_expansion_absorption_order(spark):
    found = spark.createDataFrame([(0, 0), (1, 0), (5, 5), (6, 5)], "idx bigint, rep bigint")
    similar = spark.createDataFrame([(0, 0, 0.9), (0, 3, 0.9)], "rep bigint, idx bigint, confidence double")
    wide = groups.expand_similar(similar, found)
    assert sorted(r.idx for r in wide.collect()) == [0, 1, 3]
    files = spark.createDataFrame([(i, 10) for i in range(8)], "idx bigint, byte_size bigint")
    every = groups.all_groups(found, wide)
    ranked = groups.ranked(every, files).collect()
    assert [(r.kind, r.rep, r.files, r.reclaimable) for r in ranked] == [("similar", 0, 3, 20), ("exact", 5, 2, 10)]
    gone = spark.createDataFrame([(6,)], "idx bigint")
    assert {r.kind for r in groups.after_removal(every, gone).collect()} == {"similar"}
    a, b = spark.createDataFrame([(1, 2), (2, 3), (3, 3)], "k int, v int"), spark.createDataFrame([(1, 2), (2, 4), (9, 9)], "k int, v int")
    assert {r.k: r.status for r in groups.compare_reports(a, b, "k", "v").collect()} == {1: "same", 2: "changed", 3: "only_a", 9: "only_b"}
