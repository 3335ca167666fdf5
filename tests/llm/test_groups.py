"""Operators on pairs and passages against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from echolot.llm import decontam, repeats, simhash, templates

SCHEMA = "doc_id bigint, text string, seed int, content string, start int"  # with clashing names


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA)


def corpus(seed, n=60, vocabulary=8, least=0, most=120):
    """Texts over few words with shared passages, copies and periodic stretches."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "x\u00a0y", "\u3000", "The", "the"]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 60))] for _ in range(5)]
    made = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(least, most))]
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
        if i % 7 == 0:
            own += ["a", "b"] * rng.randint(10, 30)
        made.append(own)
    made += [list(made[3]), list(made[3]), made[5][:40]]
    texts = [rng.choice([" ", "\n", "  "]).join(w) for w in made]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (4, " \t\n")]


def removed_by_brute_force(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone.update(range(s, s + length))
            seen.add(window)
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


@pytest.mark.parametrize(("seed", "length", "anchor", "vocabulary"), [(1, 20, 8, 200), (2, 20, 8, 3), (3, 6, 3, 4), (4, 5, 5, 3), (5, 4, 1, 3)])
def test_repeats(spark, seed, length, anchor, vocabulary, monkeypatch):
    rows = corpus(seed, vocabulary=vocabulary)
    docs = frame(spark, rows).repartition(5)
    want = removed_by_brute_force(rows, length)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs, length, anchor).collect()}
    assert got == want
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # groups run across batches
    try:
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs, length, anchor).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeats_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 30), (1, 30), (2, 30)]  # null comes first; equal rows get the same
    assert repeats.remove_repeats(frame(spark, rows).limit(0)).count() == 0
    other = " ".join(f"v{i}" for i in range(40))
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeats.remove_repeats(frame(spark, [(1, text), (2, text), (2, other), (None, None), (None, other + " x")])).collect() if r.doc_id)
    assert got == [(1, 30, 0), (2, 30, 30), (2, 40, 40)]  # the null key holds the other text first
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in repeats.remove_repeats(frame(spark, [(1, text), (2, text), (2, other)])).collect())
    assert got == [(1, 30, 0), (2, 30, 30), (2, 40, 0)]  # a text that repeats nothing loses nothing
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    [r] = repeats.remove_repeats(frame(spark, [(1, long)])).collect()
    assert (r.n_words, r.n_removed) == (60_000, 55_000)


@pytest.mark.parametrize("chunk_bytes", [32 << 20, 1])
def test_repeated_rows_keep_the_first_holder(spark, chunk_bytes, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk_bytes)
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "wv")
    rows = [(1, text), (1, text), (1, text), (3, other), (3, other), (4, text + " " + other)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # equal occurrences in different batches
    try:
        for given, want in ((rows[:2], [(1, 0)] * 2), (rows, [(1, 0)] * 3 + [(3, 0)] * 2 + [(4, 60)])):
            got = sorted((r.doc_id, r.n_removed) for r in repeats.remove_repeats(frame(spark, given).repartition(3), 20).collect())
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def fingerprint_by_definition(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_by_brute_force(values, radius):
    label = {v: v for v in values}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ordered = sorted(set(values))
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                label[root(b)] = root(a)
    return {v: root(v) for v in ordered}


def test_fingerprints_follow_definition(spark):
    rows = corpus(7) + [(9001, "One"), (9002, "one TWO"), (9003, "É é A a"), (9004, "tok " * 80_000)]
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(frame(spark, rows)).collect()}
    assert got == {d: fingerprint_by_definition(t) for d, t in rows}


@pytest.mark.parametrize("tree_size", [4096, 7])
def test_links_keep_components(spark, tree_size):
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        v = rng.choice(values)
        for _ in range(rng.randint(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values += [0, 2**64 - 1, 1 << 63]
    signed = sorted({simhash._signed(v) for v in values})
    links = simhash.neighbour_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 3, tree_size).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links)
    want = components_by_brute_force([v % 2**64 for v in signed], 3)
    label = {v: v for v in want}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        a, b = sorted((root(r.a % 2**64), root(r.b % 2**64)))
        label[b] = a
    groups = {}
    for v in want:
        groups.setdefault(root(v), set()).add(v)
    expected = {}
    for v, c in want.items():
        expected.setdefault(c, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_tree_search_equals_scan():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << np.uint64(k)) for k in range(6))]))
    tree = simhash.BKTree(values)
    got = {(node, int(h)) for node, hits in tree.search(values, 2) for h in hits}
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert got == want


def test_near_duplicates(spark):
    rows = corpus(11) + [(None, "w1 w2 w3 w4"), (500, "W1 w2 w3 w4"), (500, "W1 w2 w3 w4")]
    got = sorted((r.doc_id or -1, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    prints = [(d, fingerprint_by_definition(t)) for d, t in rows]
    component = components_by_brute_force([f for _, f in prints], 3)
    least = {}
    for d, f in prints:
        if d is not None:
            least[component[f]] = min(d, least.get(component[f], d))
    assert got == sorted((d or -1, f, least[component[f]]) for d, f in prints)
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def decontaminated_by_brute_force(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for item, text in items:
        words = split(text)
        for s in range(max(1, len(words) - window + 1) if words else 0):
            windows.setdefault(tuple(words[s : s + window]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(words) - size + 1):
                names = windows.get(tuple(words[s : s + size]))
                if names:
                    hit.update(range(s, s + size))
                    found |= names
        out[doc] = (len(words), len(hit), len(found), ",".join(sorted(found)))
    return out


@pytest.mark.parametrize("rows_to_broadcast", [200_000, 0])
def test_decontamination(spark, rows_to_broadcast, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows_to_broadcast)
    docs = corpus(13, vocabulary=4) + [(900, "Alpha, BETA! gamma"), (901, "alpha beta"), (902, "gamma 日本 x 日本"), (903, "alpha " * 300)]
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(docs[:60])[1].split()[:n])) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 25, 40, 12, 30])]
    items += [(50, None), (51, "!!"), (52, "alpha beta"), (53, "Alpha Beta"), (52, "alpha beta"), (54, "日本"), (60, "alpha " * 12), (61, "not there at all")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc_id string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items) for r in decontam.decontaminate(frame(spark, docs), bench).collect()}
    assert got == decontaminated_by_brute_force(docs, items)


def test_decontamination_edges(spark):
    docs = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "a b"), (2, None)])
    bench = spark.createDataFrame([(7, "b c")], "item_id bigint, text string")
    got = sorted(((r.doc_id or 0), r.n_words, r.n_hit, r.items) for r in decontam.decontaminate(docs, bench).collect())
    assert got == [(0, 2, 0, ""), (1, 3, 2, "7"), (2, 0, 0, "")]
    assert [r.spans for r in decontam.decontaminate(docs, bench).where("doc_id = 1").collect()] == [[(1, 2)]]
    assert {r.n_hit for r in decontam.decontaminate(docs, bench.limit(0)).collect()} == {0}
    long = "x y " * 40_000 + "b c " + "z " * 40_000
    assert [(r.n_words, r.n_hit) for r in decontam.decontaminate(frame(spark, [(1, long)]), bench).collect()] == [(120_002, 2)]
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def lines_by_brute_force(rows, min_docs, pattern_docs, splits=templates.SPLITS, constant=templates.CONSTANT, solid=templates.SOLID):
    """The tree with dictionaries."""

    def key(line):
        tokens = tuple("<*>" if re.search(r"\d", t) else t for t in line.split())
        return tuple(line.split()) if set(tokens) == {"<*>"} else tokens

    first_of, holders = {}, {}  # text -> least document; line -> texts
    for doc, text in rows:
        if text is not None:
            first_of[text] = min(first_of.get(text, math.inf), math.inf if doc is None else doc)
    for text in first_of:
        for k in {key(x) for x in text.split("\n") if x.split()}:
            holders.setdefault(k, set()).add(text)
    template = {k: ("own", k) for k, t in holders.items() if len(t) >= min_docs}
    total = lambda node: sum(len(holders[k]) for k in node)
    leaves = {}
    for k in holders.keys() - template.keys():
        leaves.setdefault((len(k), k[:3]), []).append(k)
    nodes = [n for n in leaves.items() if total(n[1]) >= pattern_docs and len(n[1]) > 1]
    for level in range(splits + 1):
        below = {}
        for name, lines in nodes:
            if total(lines) < pattern_docs:
                continue
            pattern, varying = [], []
            for pos in range(len(lines[0])):
                votes = Counter()
                for k in lines:
                    votes[k[pos]] += len(holders[k])
                n, token = max((n, t) for t, n in votes.items())
                pattern.append(token if n >= constant * sum(votes.values()) else None)
                if pattern[-1] is None:
                    varying.append((len(votes), pos))
            if sum(p not in (None, "<*>") for p in pattern) >= solid * len(pattern):
                for k in lines:
                    if all(p is None or p == t for p, t in zip(pattern, k)):
                        template[k] = ("node", name)
                    else:
                        below.setdefault((name, level), []).append(k)
            else:
                for k in lines:
                    below.setdefault((name, min(varying)[1], k[min(varying)[1]]) if varying else (name,), []).append(k)
        nodes = list(below.items())
    texts = {}
    for k, name in template.items():
        texts.setdefault(name, set()).update(holders[k])
    keeper = {}
    for k, name in template.items():
        if len(texts[name]) >= (min_docs if name[0] == "own" else pattern_docs):
            keeper[k] = min(texts[name], key=lambda t: (first_of[t], templates._hash(t)))
    out = []
    for doc, text in rows:
        parts = [] if text is None else text.split("\n")
        stay = [not x.split() or keeper.get(key(x), text) == text for x in parts]
        out.append((doc, len(parts), stay.count(False), None if text is None else "\n".join(x for x, s in zip(parts, stay) if s)))
    return out


def template_rows():
    rng = random.Random(17)
    rows = []
    for i in range(80):
        lines = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.choice(["", 7])) for _ in range(rng.randint(1, 9))) for _ in range(8)]
        if i % 2:
            lines.insert(rng.randint(0, 8), f"Posted by user {rng.choice(['ann', 'bob', 'cy'])}{i} on day {i}")
        if i % 3 == 0:
            lines.insert(0, "All rights reserved.")
        if i % 5 == 0:
            lines.append(f"Read more about {rng.choice('abcdefghijkl') * 3} {rng.choice('abcdefghijkl') * 4} in our archive today")
        if i % 5 == 1:
            lines.append(f"Read more about the new {rng.choice('abcdefghijkl') * 3} {rng.choice('abcdefghijkl') * 4} before lunch")
        if i % 4 == 0:
            lines += ["", "  ", f"{i} {i + 1}"]
        rows.append((i, "\n".join(lines)))
    rows += [(200 + i, rows[7][1]) for i in range(12)] + [(90, None), (91, ""), (92, "All rights reserved."), (None, rows[9][1] + "\nlast"), (93, rows[3][1]), (93, "All rights reserved.\nother")]
    return rows + [(300 + i, "All rights reserved by the owner and the publisher") for i in range(30)] + [(400 + i, f"All rights reserved by {chr(97 + i) * 3} and {chr(98 + i) * 4} publisher") for i in range(12)]


@pytest.mark.parametrize("rows_to_broadcast", [1_000_000, 0])
def test_templates(spark, rows_to_broadcast, monkeypatch):
    monkeypatch.setattr(templates, "BROADCAST_ROWS", rows_to_broadcast)
    if not rows_to_broadcast:
        monkeypatch.setattr(templates, "PATTERN_ROWS", 0)
    rows = template_rows()
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in templates.drop_recurring_lines(frame(spark, rows).repartition(3), min_docs=3, pattern_docs=6).collect()), key=repr)
    assert got == sorted(lines_by_brute_force(rows, 3, 6), key=repr)
    whole = "\n".join(r[3] or "" for r in got)
    assert whole.count("All rights reserved.") == 1 and whole.count("Posted by user") == 1
    assert whole.count("in our archive") == 1 and whole.count("before lunch") == 1  # two templates in one leaf
    assert whole.count("All rights reserved by") == 30 + 1  # copies of the first text keep it; the hot line doesn't hide the variable one


def test_boilerplate_documents_and_passages_in_few_documents(spark):
    notice = "Cookie notice: accept all\nSubscribe to our newsletter now"
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"{notice}\nunique {chr(97 + i)} words {chr(98 + i)}") for i in range(20)] + [(100 + i, f"other {chr(97 + i)}\n{passage}") for i in range(5)]
    got = {r.doc_id: r.n_removed for r in templates.drop_recurring_lines(frame(spark, rows)).collect()}
    assert got == {0: 0, 100: 0} | {i: 2 for i in range(1, 20)} | {100 + i: 1 for i in range(1, 5)}


def test_templates_edges(spark):
    rows = [(None, "a b\nx"), (1, "a b\ny z"), (1, "a b\ny z"), (2, "a b\n" + "w " * 50_000), (3, "12 34"), (4, "12 35"), (5, "12 36")]
    got = templates.drop_recurring_lines(frame(spark, rows), carry=["doc_id", "text", "seed", "content", "start"]).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 1), (3, 0), (4, 0), (5, 0)]
    assert all(r.carried.doc_id == r.doc_id and r.carried.content == "x" for r in got)
    assert templates.drop_recurring_lines(frame(spark, rows).limit(0)).count() == 0
