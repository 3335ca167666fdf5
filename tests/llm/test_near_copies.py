"""Near copies against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from echolot.llm import near_copies, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows, similarity=0.8):
    label = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= similarity * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), c in zip(rows, label):
        least[c] = min(doc, least.get(c, doc))
    return sorted((doc, least[c]) for (doc, _), c in zip(rows, label))


def rows_with_near_copies(seed=3):
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(1, 160))] for _ in range(60)]
    passage = [f"p{i}" for i in range(60)]
    for i in range(0, 30, 2):
        texts[i][:0] = passage  # shared, not similar
    for i in range(160):  # edits up to about the limit, and chains of them
        own = list(texts[i % 20 if i % 2 else rng.randrange(len(texts))])
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(own)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(1000, None), (1001, ""), (1002, "One"), (1003, "one"), (1004, "one two")] + [(1005 + i, rows[7][1]) for i in range(3)]


@pytest.mark.parametrize("small", [False, True])
def test_near_copies_equal_brute_force(spark, small, monkeypatch):
    if small:  # many packs, many slices, merges on the way, a filter that lets much pass
        monkeypatch.setattr(near_copies, "FILTER_BITS", 7)
        monkeypatch.setattr(near_copies, "PACK_KEYS", 50)
        monkeypatch.setattr(near_copies, "SLICE_KEYS", 100)
    rows = rows_with_near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys run across batches
    try:
        got = sorted((r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = components(rows)
    assert got == want and 40 < sum(d != c for d, c in want) < len(want) - 40
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_stage_drops_near_copies(spark):
    rows = rows_with_near_copies(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect())
    want = components(rows)
    assert kept == [d for d, c in want if d == c]
    prints = {d: simhash.fingerprint((t or "").encode()) for d, t in rows}
    assert any((prints[d] ^ prints[c]).bit_count() > 3 for d, c in want)
