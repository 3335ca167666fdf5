"""Trained operators: properties of the models and held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from echolot.llm import kneser_ney, langid, toxicity

SYLLABLES = {"aa": ["ka", "ri", "to", "mun", "sel"], "bb": ["thé", "qu", "eau", "lor", "ix"], "cc": ["sch", "ung", "ber", "öl", "ein"]}
INSULTS = ["idiot", "moron", "scumbag", "loser"]


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return [(i, sentence(rng, lang, rng.randint(3, 60)), lang) for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]


def test_kneser_ney_by_hand():
    words, weights = ["ab", "abc", "b"], np.array([3, 2, 1])
    keys, counts = kneser_ney.count_keys(words, weights, 2)
    pairs = Counter()
    for w, n in zip(words, weights.tolist()):
        for a, b in zip(" " + w, w + " "):
            pairs[a + b] += n
    assert dict(zip([chr(k >> 16) + chr(k & 65535) for k in keys.tolist()], counts.tolist())) == pairs
    model = kneser_ney.train({"m": (keys, counts)}, 2, 0.75)

    def probability(a, b):
        kinds = Counter(p[1] for p in pairs)
        total = sum(kinds.values())
        low = max(kinds[b] - 0.75, 0) / total + 0.75 * len(kinds) / total / kneser_ney.ALPHABET
        seen = {p: n for p, n in pairs.items() if p[0] == a}
        if not seen:
            return low
        return max(seen.get(a + b, 0) - 0.75, 0) / sum(seen.values()) + 0.75 * len(seen) / sum(seen.values()) * low

    for word in ["ab", "ba", "cz", "z", "aaa"]:
        want = sum(math.log2(probability(a, b)) for a, b in zip(" " + word, word + " "))
        assert model.score_words([word])[0, 0] == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_one():
    words = ["kato", "rimun", "toka", "selri", "munmun"]
    keys, counts = kneser_ney.count_keys(words, np.ones(5, np.int64), 3)
    model = kneser_ney.train({"x": (keys, counts)}, 3)
    for context in ("  ", " k", "un", "zz"):
        every = np.array([(ord(context[0]) << 32) | (ord(context[1]) << 16) | c for c in range(kneser_ney.ALPHABET)], np.uint64)
        assert np.exp2(model.log_probabilities(every)[:, 0].astype(float)).sum() == pytest.approx(1, abs=1e-3)


def test_language_held_out(spark, texts):
    rows = [(i, t, lang, "x") for i, t, lang in texts] + [(None, "kato rimun", "aa", "n"), (9001, None, "aa", "n"), (9002, "", "bb", "n"), (9003, "123 !? 45", "cc", "n"), (9004, "ka" * 40_000, None, "n"), (9005, "kato ri", None, "n"), (9005, "kato ri", None, "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    fold = langid.fold(docs.doc_id, 4)
    identifier = langid.fit(docs.where(fold != 2))
    got = {r.doc_id: r for r in langid.identify(docs, identifier).collect()}
    held = {r.doc_id for r in docs.where(fold == 2).select("doc_id").collect()}
    right = [got[i].lang_pred == lang for i, _, lang in texts if i in held]
    assert len(right) > 100 and sum(right) / len(right) > 0.98
    for key in (9001, 9002, 9003):
        assert (got[key].lang_pred, got[key].score, got[key].rejected) == ("und", 0.0, True)
    assert got[None].lang_pred == "aa" and got[9005].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert not any(got[i].rejected for i, _, _ in texts)
    strange = spark.createDataFrame([(1, " ".join("xzqvj wkpf" for _ in range(60)))], "doc_id bigint, text string")
    assert langid.identify(strange, identifier).collect()[0].rejected
    assert langid.identify(docs.limit(0), identifier).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_junk_does_not_lift_the_limit(spark, texts):
    rng = random.Random(9)
    noise = lambda: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(60))
    rows = [(t, lang) for _, t, lang in texts] + [(noise(), "aa") for _ in range(6)] + [(noise(), None) for _ in range(60)]
    rows += [("kato", "dd"), ("12", "ee")]  # a language with one text, and one without a letter
    identifier = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert identifier.models.names == ["aa", "bb", "cc", "dd", "ee"] and not np.isposinf(identifier.limits).any()
    asked = [(i, noise()) for i in range(20)] + [(100 + i, t) for i, t, _ in texts]
    got = {r.doc_id: r.rejected for r in langid.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), identifier).collect()}
    assert all(got[i] for i in range(20)) and not any(got[100 + i] for i, _, _ in texts)


def test_trigrams_by_definition():
    """Interpolated Kneser-Ney of order 3 from plain dictionaries: raw counts at the beginnings of words."""
    words = Counter({"ab": 3, "abc": 2, "b": 1, "cab": 4, "日本": 2, "日": 1})
    grams = Counter()
    for w, n in words.items():
        for i in range(len(w) + 1):
            grams.update({("  " + w + " ")[i : i + 3]: n})
    pairs = {g[1:] for g in grams}
    middle = {p: sum(n for g, n in grams.items() if g[1:] == p) if p[0] == " " else sum(g[1:] == p for g in grams) for p in pairs}
    low = {c: sum(p[1] == c for p in pairs) for c in {p[1] for p in pairs}}

    def probability(table, gram, d=0.75):
        if not gram:
            return 1 / kneser_ney.ALPHABET
        lower = probability([grams, middle, low, {}][4 - len(gram)], gram[1:])
        seen = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen.get(gram, 0) - d, 0) / total + d * len(seen) / total * lower

    keys, counts = kneser_ney.count_keys(list(words), np.array(list(words.values())), 3)
    model = kneser_ney.train({"m": (keys, counts)}, 3)
    for word in ["ab", "cab", "bc", "本日", "日本", "zz", "c"]:
        padded = "  " + word + " "
        want = sum(math.log2(probability(grams, padded[i : i + 3])) for i in range(len(word) + 1))
        assert model.score_words([word])[0, 0] == pytest.approx(want, rel=1e-4)


def test_models_beyond_the_bound_judge_alike(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in texts[:300]] + [(1000, None, "aa"), (1001, "12", "aa"), (1002, "日本 kato 語", "bb")], "doc_id bigint, text string, lang string")
    small = langid.fit(docs)
    want = {r.doc_id: r for r in langid.identify(docs, small).collect()}
    monkeypatch.setattr(langid, "MODEL_ENTRIES", 10)
    joined = langid.fit(docs)
    assert isinstance(joined.models, langid.JoinedModels) and joined.limits == pytest.approx(small.limits, abs=0.041)
    got = {r.doc_id: r for r in langid.identify(docs, joined, carry=["text", "doc_id"]).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r.lang_pred == want[k].lang_pred and r.carried.doc_id == k and r.text == r.carried.text
        assert r.bits_per_char == pytest.approx(want[k].bits_per_char, rel=1e-4, nan_ok=True) and r.score == pytest.approx(want[k].score, abs=1e-2)


def readings_by_enumeration(restorer, token, gaps=None):
    """The best score over all paths of the lattice, and all readings that reach it."""
    last, best = len(token) - 1, (-math.inf, set())

    def finish(text, score):
        nonlocal best
        for word in text.split(" "):
            context = restorer.start
            for letter in word + " ":
                score += restorer.step(context, letter)
                context = (context + letter)[1:]
        if score > best[0] + 1e-9:
            best = (score, {text})
        elif score > best[0] - 1e-9:
            best[1].add(text)

    def single(at, end, text, score, then):
        if at == end:
            return then(text, score)
        options = [(token[at], 0.0)] + [(c, toxicity.SUBSTITUTE) for c in toxicity.LOOKALIKES.get(token[at], "")]
        if not token[at].isalnum() and 0 < at < last:
            options.append(("", toxicity.DROP))
        for glue, price in [(" ", 0.0), ("", gaps[at - 1])] if gaps and at else [("", 0.0)]:
            for letters, cost in options:
                single(at + 1, end, text + glue + letters, score + price + cost, then)

    def runs(at, text, score):
        if at > last:
            return finish(text, score)
        end = at
        while end <= last and token[end] == token[at]:
            end += 1
        single(at, end, text, score, lambda t, s: runs(end, t, s))
        if end - at > 1:
            inside = sum(gaps[at : end - 1]) if gaps else 0.0
            for c, cost in [(token[at], 0.0)] + [(c, toxicity.SUBSTITUTE) for c in toxicity.LOOKALIKES.get(token[at], "")]:
                for k in (1, 2) if end - at > 2 else (1,):
                    for glue, price in [(" ", 0.0), ("", gaps[at - 1])] if gaps and at else [("", 0.0)]:
                        runs(end, text + glue + c * k, score + price + inside + cost + toxicity.SHORTEN)

    runs(0, "", 0.0)
    return best


def test_decoder_equals_enumeration(spark):
    rng = random.Random(8)
    words = INSULTS + ["letter", "kato", "rimun", "book", "élan", "日本"]
    docs = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(20)),) for _ in range(50)], "text string")
    restorer = toxicity.Restorer(toxicity.corpus_model(docs))
    for n in range(1000):
        token = "".join(rng.choice("idot1!0ol|3m.-ns@") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 4)))[:7]
        gaps = [rng.choice([toxicity.DROP, toxicity.WIDE]) for _ in token[1:]] if n % 4 == 0 else None
        got, score = restorer.decode(token, gaps)
        want, texts = readings_by_enumeration(restorer, token, gaps)
        assert score == pytest.approx(want, abs=1e-6) and got in texts, token


def test_disguises(spark):
    rng = random.Random(8)
    words = INSULTS + ["letter", "kato", "rimun", "book", "well-known", "you", "are"]
    docs = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(20)),) for _ in range(200)], "text string")
    model = toxicity.corpus_model(docs)
    restorer = toxicity.Restorer(model)
    assert {restorer.restore_token("l" + "o" * n + "ser") for n in (3, 4, 254, 300, 600)} == {"loser"}
    for token in ("iiddiioott", "id" + "i" * 280 + "ot", "1d10t", "i.d.i.o.t", "id.iot", "idi-ot", "!d!ot", "id|0t", "i__d__i__o__t"):
        assert restorer.restore_token(token) == "idiot", token
    assert [restorer.restore_token(w) for w in ("letter", "book", "well-known", "rimun", "42", "日日本")] == ["letter", "book", "well-known", "rimun", "42", "日日本"]
    assert restorer.restore_token("1d10t" * 4000) == "idiot" * 4000
    for text in ("x i d i o t x", "i  d  i  o  t", "i\td\ni o t"):
        assert "idiot" in toxicity.restored_text(text, model), text
    assert toxicity.restored_text("y o u  a r e  a  l o s e r", model).split()[-1].endswith("loser")
    assert toxicity.restored_text("kato 1d10t r1 m.o.r.o.n", model) == "kato idiot r1 moron"


def test_readers_give_each_token_its_own_reading(spark, monkeypatch):
    rng = random.Random(3)
    words = INSULTS + ["letter", "kato", "rimun", "book", "élan", "日本"]
    model = toxicity.corpus_model(spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(20)),) for _ in range(50)], "text string"))
    tokens = ["".join(rng.choice("idot1!0ol|3m.-ns@") * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    restorer = toxicity.Restorer(model)
    restored = [restorer.restore_token(t) for t in tokens]
    assert any(restorer.restore_token(w) != w for w in restored)  # so a word's reading is not that of the token spelled alike
    texts = [" ".join(restored), None, "", "a b", "c d", "x i d i o t x", "... --", *(" ".join(tokens[k : k + 7]) for k in range(0, 400, 7)), " ".join(tokens)]
    want = []
    for text in texts:
        lower = (text or "").lower()
        want.append([restorer.restore_token(t) for t in lower.split()] + [w for row in toxicity._SPACED.finditer(lower) for w in restorer.restore_row(row.group())])

    evaluated, seen, looked_up = [], {"": 0.0}, []

    def evaluate(found):
        evaluated.extend(found)
        return np.array([float(seen.setdefault(w, len(seen))) for w in found])

    plain = toxicity.HashedModel.bucket
    monkeypatch.setattr(toxicity.HashedModel, "bucket", staticmethod(lambda key: looked_up.append(key) or plain(key)))
    for entries in (600_000, 50):
        reader, size = toxicity.WordReader(model, evaluate, 0.0, entries), 5
        got = []
        for low in range(0, len(texts), size):
            values, bounds = reader.read(texts[low : low + size])
            got += [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [[seen[w] for w in found] for found in want]
        if entries > len(tokens):
            assert len(evaluated) <= len(reader.numbers) + sum(map(len, want)) - sum(len((t or "").split()) for t in texts)  # once for each token
            assert len(looked_up) < 4 * reader.restorer.step.cache_info().misses  # two for each order without memory of shorter ones


def test_bounded_model_agrees_with_the_plain_one(spark, texts):
    docs = spark.createDataFrame([(t,) for _, t, _ in texts[:100]] + [("日本 語",)], "text string")
    model = toxicity.corpus_model(docs)
    counts = Counter(w for _, t, _ in texts[:100] for w in t.lower().split()) + Counter(["日本", "語"])
    plain = kneser_ney.train({"m": kneser_ney.count_keys(list(counts), np.array(list(counts.values())))})
    keys, _ = kneser_ney.word_keys(["kato", "rimun", "thé", "日本", "zzz"])
    want = plain.log_probabilities(keys)[:, 0]
    got = [math.log2(model.probability(int(k))) for k in keys]
    assert np.abs(np.array(got) - want).max() < 0.01
    assert all(len(g[0]) <= kneser_ney.HashedModel.BUCKETS for g in model.grams)


def test_toxicity_ties_and_labels(spark, toxic_rows):
    rows = toxic_rows + [(7000 + k, toxic_rows[5][1], 1 - toxic_rows[5][2]) for k in range(3)]  # one text with both labels
    docs = spark.createDataFrame([(i, t, y) for i, t, y in rows], "doc_id bigint, text string, label int")
    first = toxicity.fit(docs, docs)
    again = toxicity.fit(docs.repartition(7), docs.repartition(5))  # another layout, the same model
    assert np.array_equal(first.weights, again.weights) and first.coefficients == pytest.approx(again.coefficients, rel=1e-9)
    got = {r.doc_id: r.score for r in toxicity.score(docs, first).collect()}
    assert got[7000] == got[7001] == got[toxic_rows[5][0]]


def disguise(rng, word):
    kind = rng.randrange(4)
    if kind == 0:
        return word.translate(str.maketrans("oieas", "01345"))
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return ".".join(word)
    at = rng.randrange(len(word))
    return word[:at] + word[at] * 4 + word[at + 1 :]


@pytest.fixture(scope="module")
def toxic_rows():
    rng, rows = random.Random(4), []
    for i in range(900):
        words = sentence(rng, "aa", rng.randint(8, 60)).split()
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(2, 4) if toxic else int(rng.random() < 0.05)):
            words.insert(rng.randint(0, len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_held_out_and_disguised(spark, toxic_rows):
    extra = [(5001, None, 0), (5002, "", 0), (5003, "kato", None), (None, "ka ri", 0), (5004, "to" * 30_000, 0)]
    docs = spark.createDataFrame([(i, t, y, "x") for i, t, y in toxic_rows + extra], "doc_id bigint, text string, label int, score string")
    fold = langid.fold(docs.doc_id, 5)
    model = toxicity.fit(docs, docs.where(fold != 0))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(fold == 0).select("doc_id").collect()}
    right = [got[i].predicted == y for i, _, y in toxic_rows if i in held]
    assert len(right) > 120 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[5001].predicted == 0 and got[5002].score == got[5001].score
    rng, hidden = random.Random(6), []
    for i, t, y in toxic_rows:
        if y and i in held:
            hidden.append((i, " ".join(disguise(rng, w) if w in INSULTS else w for w in t.split())))
    found = toxicity.score(spark.createDataFrame(hidden, "doc_id bigint, text string"), model).collect()
    assert sum(r.predicted for r in found) / len(found) > 0.9
    restorer = toxicity.Restorer(model.characters)
    long = "k4to" * 2000
    assert restorer.restore_token(long) == "kato" * 2000
    assert toxicity.score(docs.limit(0), model).count() == 0
    empty = toxicity.fit(docs, docs.where("label = 0"))
    assert {r.predicted for r in toxicity.score(docs, empty).collect()} == {0}
