"""The registered queries over the smallest tables, against definitions and brute force."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from test_groups import components_by_brute_force, decontaminated_by_brute_force, fingerprint_by_definition, lines_by_brute_force, removed_by_brute_force
from tokenizers import Tokenizer

from echolot.llm import mpeg, packing, queries, templates

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="tables not here")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    return {r.doc_id: r for r in rows}


def run(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, DATA).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(key, folds):
    return zlib.crc32(str(key).encode()) % folds


def test_op1(spark, docs):
    df = queries.op1_toxicity(spark, DATA)
    assert [(f.name, f.dataType.simpleString()) for f in df.schema][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r.doc_id: r for r in df.collect()}
    assert got.keys() == docs.keys()
    assert all(r.held_out == (crc(k, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert sum(got[k].predicted == y for k, y in labels.items() if k in got) > 0.9 * len(labels)


def test_op2(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = decontaminated_by_brute_force([(k, r.text) for k, r in docs.items()], items)
    got = run(spark, "op2_benchmark_decontamination")
    assert {k: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for k, r in got.items()} == {k: (w, h, n, sha(i), h > 0) for k, (w, h, n, i) in want.items()}


def test_op3(spark, docs):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    want = {k: (len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for k, r in docs.items()}
    got = run(spark, "op3_token_counts")
    assert {k: (r.n_bytes, r.n_tokens, r.over_limit) for k, r in got.items()} == {k: (b, n, n > 512) for k, (b, n) in want.items()}


def test_op4(spark, docs):
    want = removed_by_brute_force([(k, r.text) for k, r in docs.items()], 20)
    got = run(spark, "op4_substring_dedup")
    assert {k: (r.n_words, r.n_removed, r.kept_sha256) for k, r in got.items()} == {k: (n, gone, sha(kept)) for k, (n, gone, kept) in want.items()}


def test_op5(spark, docs):
    got = run(spark, "op5_mpeg_audio")
    for k, r in docs.items():
        payload = mpeg.padded((r.text or "").encode())
        media = mpeg.store_payload(payload)
        row = got[k]
        assert len(payload) % 64 == 0 and (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len((r.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert (row.tail_crc32, row.media_bytes, row.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
    assert len({(docs[k].text, r.feature) for k, r in got.items()}) == len({r.text for r in docs.values()})


def test_op6(spark, docs):
    library = Tokenizer.from_file(queries.WORD_BPE)
    want = {}
    for k, r in docs.items():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for p, low in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[low : low + 2048], "<u4")
            want[k, p] = (low, len(part), zlib.crc32(part.tobytes()))
    rows = queries.op6_best_fit_packing(spark, DATA).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) <= -(-sum(n for _, n, _ in want.values()) // 2048) + 2


def test_op7(spark, docs):
    got = run(spark, "op7_language_id")
    letters = re.compile(r"[^\W\d_]")
    assert got.keys() == docs.keys() and all(r.held_out == (crc(k, 4) == 2) and 0 <= r.score <= 1 for k, r in got.items())
    assert all((got[k].lang_pred == "und") == (not letters.search(r.text or "")) for k, r in docs.items())
    held = [k for k, r in docs.items() if crc(k, 4) == 2 and r.lang is not None]
    assert sum(got[k].lang_pred == docs[k].lang for k in held) >= 0.95 * len(held)


def test_op8(spark, docs):
    prints = {k: fingerprint_by_definition(r.text) for k, r in docs.items()}
    component = components_by_brute_force(prints.values(), 3)
    least = {}
    for k, f in prints.items():
        least[component[f]] = min(k, least.get(component[f], k))
    got = run(spark, "op8_simhash_neardup")
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{f:016x}", least[component[f]]) for k, f in prints.items()}


def test_op9(spark, docs):
    want = lines_by_brute_force([(k, r.text) for k, r in docs.items()], templates.MIN_DOCS, templates.PATTERN_DOCS)
    got = run(spark, "op9_line_templates")
    assert sorted((k, r.n_lines, r.n_removed, r.kept_sha256) for k, r in got.items()) == sorted((d, n, gone, sha(kept or "")) for d, n, gone, kept in want)


def test_op10(spark, docs):
    library, at, want = Tokenizer.from_file(queries.BYTE_BPE), 0, {}
    for k in sorted(docs):
        ids = np.array([*library.encode(docs[k].text or "", add_special_tokens=False).ids, 2], "<u4")
        want[k] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {k: (r.start, r.n_tokens, r.ids_crc32) for k, r in run(spark, "op10_wavelet_matrix").items()} == want
