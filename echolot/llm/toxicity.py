"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then a scorer on restored words.

A suspicious token spans a lattice: each character may stand for itself or for a letter that it imitates, a run
of one character for itself, for one or, from three on, for two of it, and separators between letters may be
noise. A row of single characters spans a lattice in which every gap joins two letters or parts two words. Viterbi
decoding under a character language model of the whole corpus picks the most likely reading; all states of the
model are kept, so it is the best of all readings. Any other token has one reading, itself.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolot.llm.arrow import keyed_texts, map_arrow
from echolot.llm.joins import narrow_side
from echolot.llm.kneser_ney import DISCOUNT, ORDER, HashedModel, code_of
from echolot.llm.langid import context_sums, lower_order, ngram_counts
from echolot.runtime import materialize

#: Letters that characters imitate.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Signs that may imitate a letter at either edge of a token, and those that may only at its beginning.
EDGE_LETTERS, FIRST_LETTERS = ("@", "$", "€", "£"), ("!", "|")
#: log2 costs of the channel: an imitated letter, a run shortened, a separator or a gap dropped, a gap wider than the least of its row dropped.
SUBSTITUTE, SHORTEN, DROP, WIDE = -2.0, -1.0, -1.0, -2.0
#: Runs after which a long token's reading is settled as far as all survivors agree.
SETTLE = 256
#: Hashed features, their prior weight, and labelled rows (at most) that fit the final regression.
BUCKETS, PRIOR, SAMPLE_ROWS = 1 << 20, 20.0, 20_000
#: Folds of the labelled rows: the regression sees each one under weights from all others.
FOLDS = 5
#: Lengths of word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)
#: Strongest pieces of evidence that the regression sees one by one; all others are summed.
TOP = 4
#: Documents that are read at a time, and tokens that a task remembers with a value each, and with a row of buckets each.
SLICE, VALUES, ROWS = 100, 600_000, 300_000

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¡¿"
_STUDDED = re.compile(r"[^\W_]+(?:[.\-_*·]+[^\W_]+)+")
_LETTER, _LEET = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|+(€£]")
#: Three of a letter, or two pairs side by side: beyond ordinary spelling.
_RUN = re.compile(r"([^\W\d_])\1(?:\1|([^\W\d_])\2)")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


class Restorer:
    """Viterbi decoder of tokens under a character model."""

    def __init__(self, model: HashedModel) -> None:
        self.model = model
        self.start = " " * (model.order - 1)
        self.probability = model.reader()
        self.step = lru_cache(maxsize=50_000)(self._step)

    def _step(self, context: str, character: str) -> float:
        key = 0
        for c in context + character:
            key = key << 16 | code_of(c)
        return float(np.log2(self.probability(key)))

    def decode(self, token: str, gaps: list[float] | None = None) -> tuple[str, float]:
        """The best reading of a token and its log2 probability with the channel's costs; of equal ones the first.

        `gaps` gives the cost of joining each two neighbours; a gap that isn't joined ends a word. States are
        the model's contexts, each with its best path; as soon as all paths share a beginning it is settled, so
        a long token takes memory for its open end only.
        """
        alive: dict[str, tuple[float, list]] = {self.start: (0.0, [None, ""])}
        whole, at, runs, last = [], 0, 0, len(token) - 1

        def move(states: dict, options: list[tuple[str, float]]) -> dict:
            after: dict[str, tuple[float, list]] = {}
            for context, (score, path) in states.items():
                for letters, cost in options:
                    total, state = score + cost, context
                    for letter in letters:
                        total += self.step(state, letter)
                        state = (state + letter)[1:]
                    best = after.get(state)
                    if best is None or total > best[0]:
                        after[state] = (total, [path, letters])
            return after

        def part(states: dict, cost: float) -> dict:
            after = {context: (score + cost, path) for context, (score, path) in states.items()}
            score, path = max(((score + self.step(context, " "), path) for context, (score, path) in states.items()), key=lambda x: x[0])
            best = after.get(self.start)
            if best is None or score > best[0]:
                after[self.start] = (score, [path, " "])
            return after

        while at <= last:
            here, run = token[at], 1
            while at + run <= last and token[at + run] == here:
                run += 1
            readings = [(here, 0.0), *((c, SUBSTITUTE) for c in LOOKALIKES.get(here, ""))]
            inner = [*readings, ("", DROP)] if not here.isalnum() else readings
            states = alive
            for k in range(at, at + run):
                if gaps is not None and k:
                    states = part(states, gaps[k - 1])
                states = move(states, inner if 0 < k < last else readings)
            if run > 1:
                joins = sum(gaps[at : at + run - 1]) if gaps is not None else 0.0
                before = part(alive, gaps[at - 1]) if gaps is not None and at else alive
                shorter = move(before, [(c * k, cost + SHORTEN + joins) for c, cost in readings for k in ((1, 2) if run > 2 else (1,))])
                for state, found in shorter.items():
                    if state not in states or found[0] > states[state][0]:
                        states[state] = found
            alive, at, runs = states, at + run, runs + 1
            if runs % SETTLE == 0:
                self._settle([path for _, path in alive.values()], whole)
        score, path = max(((score + self.step(context, " "), path) for context, (score, path) in alive.items()), key=lambda x: x[0])
        tail = []
        while path is not None:
            tail.append(path[1])
            path = path[0]
        return "".join([*whole, *reversed(tail)]), score

    @staticmethod
    def _settle(paths: list[list], whole: list[str]) -> None:
        """Move the beginning that all paths share to `whole`."""
        trail, path = [], paths[0]
        while path is not None:
            trail.append(path)
            path = path[0]
        place = {id(node): k for k, node in enumerate(trail)}
        common = 0
        for path in paths[1:]:
            while id(path) not in place:
                path = path[0]
            common = max(common, place[id(path)])
        whole.extend(node[1] for node in reversed(trail[common:]))
        trail[common][0], trail[common][1] = None, ""

    def restore_token(self, token: str) -> str:
        """A lower-case token without edge punctuation, decoded if anything about it is ambiguous."""
        core = token if token.isalpha() else token.strip(_EDGE)
        if len(core) < 3:
            return core
        signs = core is not token and (token[0] in EDGE_LETTERS + FIRST_LETTERS or token[-1] in EDGE_LETTERS)
        if not signs and core.isalpha() and not _RUN.search(core):
            return core
        at = token.index(core)
        lead, tail = token[:at], token[at + len(core) :]
        # one sign at an edge may imitate a letter, a row of them is decoration
        whole = (lead if lead in EDGE_LETTERS + FIRST_LETTERS else "") + core + (tail if tail in EDGE_LETTERS else "")
        if _LEET.search(whole) and _LETTER.search(core) or _RUN.search(core) or _STUDDED.fullmatch(core) and _LETTER.search(core):
            return self.decode(whole)[0].strip(_EDGE)
        return core

    def restore_row(self, row: str) -> list[str]:
        """The words of two letters or more that a row of single characters spells."""
        if not _LETTER.search(row):
            return []
        widths = [len(x) for x in re.findall(r"\s+", row)]
        gaps = [DROP if w == min(widths) else WIDE for w in widths]
        words = (w.strip(_EDGE) for w in self.decode("".join(row.split()), gaps)[0].split(" "))
        return [w for w in words if len(w) > 1]


def _buckets(words: list[str]) -> np.ndarray:
    """A row of buckets for each word, of itself and of its beginnings; the word itself stands in for missing beginnings."""

    def hashed(features: Iterable[str], n: int) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, features), np.uint64, n) % np.uint64(BUCKETS)

    sizes = np.fromiter(map(len, words), np.int64, len(words))
    found = np.empty((len(words), 1 + len(PREFIXES)), np.int32)
    found[:] = hashed(map("w".__add__, words), len(words))[:, None]
    for k, n in enumerate(PREFIXES, 1):
        longer = sizes > n
        found[longer, k] = hashed(["p" + w[:n] for w in words if len(w) > n], int(longer.sum()))
    return found


class WordReader:
    """Values of restored words by token, remembered for a bounded number of tokens.

    Tokens are numbered as they come; those that are new in a slice of texts are restored and their words given to
    `evaluate` at once, which returns a value, or a row of values, for each word. Tokens without a word have the
    value `none`.
    """

    def __init__(self, model: HashedModel, evaluate: Callable[[list[str]], np.ndarray], none: float | np.ndarray, entries: int = VALUES) -> None:
        self.restorer, self.evaluate, self.none, self.entries = Restorer(model), evaluate, np.asarray(none), entries
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.values, self.single = self.none[None][:0], np.zeros(0, bool)  # by number: the value, whether it is one character

    def _learn(self, tokens: list[str]) -> None:
        restore, run = self.restorer.restore_token, _RUN.search
        words = [t if t.isalpha() and not run(t) else restore(t) for t in tokens]
        values = self.evaluate(words)
        values[np.fromiter(map(len, words), np.int64, len(words)) == 0] = self.none
        self.values = np.concatenate([self.values, values])
        self.single = np.concatenate([self.single, np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1])

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(values, bounds): a value for each token, and for each word that a row of characters spells, text by text."""
        if len(self.numbers) > self.entries:
            self._forget()
        sizes: list[int] = []

        def split() -> Iterator[list[str]]:
            for text in texts:
                tokens = (text or "").lower().split()
                sizes.append(len(tokens))
                yield tokens

        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split())), np.int32)
        if len(self.numbers) > len(self.values):
            self._learn(list(islice(reversed(self.numbers), len(self.numbers) - len(self.values)))[::-1])  # the latest, in their order
        bounds, values, single = np.cumsum([0, *sizes]), self.values[numbers], self.single[numbers]
        at = np.flatnonzero(single[:-2] & single[1:-1] & single[2:])
        ends, spelled = [], []
        for k in np.unique(np.searchsorted(bounds, at, "right") - 1).tolist():  # three that reach into the next text are no row
            words = [w for row in _SPACED.finditer(texts[k].lower()) for w in self.restorer.restore_row(row.group())]
            ends += [bounds[k + 1]] * len(words)
            sizes[k] += len(words)
            spelled += words
        if spelled:
            bounds, values = np.cumsum([0, *sizes]), np.insert(values, ends, self.evaluate(spelled), axis=0)
        return values, bounds


@dataclass
class ToxicityModel:
    characters: HashedModel
    weights: np.ndarray
    coefficients: np.ndarray

    def evidence(self, words: list[str]) -> np.ndarray:
        """The strongest weight among each word's features."""
        return self.weights[_buckets(words)].max(1).astype(np.float64)

    def score(self, summary: np.ndarray) -> float:
        z = self.coefficients[0] + float(summary @ self.coefficients[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def summarise(values: np.ndarray) -> np.ndarray:
    """What the regression sees of a text's evidence: the strongest pieces, the logarithm of the sum of all other
    positive ones, and the mean of all pieces."""
    positive = np.sort(values[values > 0])[::-1]
    out = np.zeros(TOP + 2)
    out[: len(positive[:TOP])] = positive[:TOP]
    out[TOP] = np.log1p(positive[TOP:].sum())
    out[TOP + 1] = values.mean() if len(values) else 0.0
    return out


_UNFIT = np.array([-30.0] + [0.0] * (TOP + 2))


def corpus_model(docs: DataFrame, text: str = "text", order: int = ORDER, discount: float = DISCOUNT) -> HashedModel:
    """One character model over all texts of the corpus. Counts of all n-grams are summed in tables; the driver gets
    at most HashedModel.BUCKETS rows for each order's n-grams and contexts."""
    counts = ngram_counts(docs.select(F.lit("all").alias("lang"), F.col(text).alias("text")), order=order)
    bucket = lambda key: F.pmod(F.xxhash64(key), F.lit(HashedModel.BUCKETS)).cast("int")
    tables, parts = materialize(counts, "ngrams"), []
    for k in range(order, 0, -1):
        tables = tables if k == order else materialize(lower_order(tables, k), f"grams{k}")
        parts.append(tables.select(F.lit(k).alias("k"), F.lit(0).alias("kind"), bucket("key").alias("slot"), F.col("n").cast("double").alias("n"), F.lit(0.0).alias("m")))
        parts.append(context_sums(tables).select(F.lit(k), F.lit(1), bucket("context"), F.col("total"), F.col("followers")))
    rows = reduce(DataFrame.union, parts).groupBy("k", "kind", "slot").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toArrow()
    k, kind, slot, n, m = (rows[c].to_numpy() for c in ("k", "kind", "slot", "n", "m"))
    by = np.lexsort((slot, kind, k))
    k, kind, slot, n, m = (x[by] for x in (k, kind, slot, n, m))
    own = lambda level, which: (k == level) & (kind == which)
    grams = [(slot[own(j, 0)], n[own(j, 0)]) for j in range(1, order + 1)]
    return HashedModel(order, discount, grams, [(slot[own(j, 1)], n[own(j, 1)], m[own(j, 1)]) for j in range(1, order + 1)])


def _feature_counts(labelled: DataFrame, model: HashedModel) -> np.ndarray:
    """(FOLDS, 2, BUCKETS + 1) different texts with each feature by fold and label; the last column counts texts."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        reader = WordReader(shared.value, _buckets, np.full(1 + len(PREFIXES), BUCKETS, np.int32), ROWS)
        counts = np.zeros((2 * FOLDS, BUCKETS + 1), np.int32)
        texts = np.zeros(2 * FOLDS, np.int32)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                features, bounds = reader.read(part.column(2).to_pylist())
                cells = part.column(0).to_numpy() * 2 + part.column(1).to_numpy()
                for cell, a, b in zip(cells.tolist(), bounds.tolist(), bounds[1:].tolist()):
                    counts[cell][features[a:b]] += 1  # once, however often a feature occurs
                texts += np.bincount(cells, minlength=len(texts)).astype(np.int32)
        counts[:, BUCKETS] = texts
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(counts[k, at], pa.int64()) for k in range(2 * FOLDS))], schema=out)

    names = [f"n{k}" for k in range(2 * FOLDS)]  # clean and toxic by turns
    rows = map_arrow(labelled.select("fold", "label", "text"), run, "bucket int, " + ", ".join(f"{n} bigint" for n in names))
    frame = rows.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).where(" + ".join(names[1::2]) + " > 0").toArrow()  # at most BUCKETS + 1 rows
    counts = np.zeros((2 * FOLDS, BUCKETS + 1))
    for k, name in enumerate(names):
        counts[k, frame["bucket"].to_numpy()] = frame[name].to_numpy()
    return counts.reshape(FOLDS, 2, -1)


def _weights(counts: np.ndarray) -> np.ndarray | None:
    """Smoothed log odds of each feature from counts (label, feature); None without texts of both labels."""
    clean, toxic = counts[:, -1]
    if not clean or not toxic:
        return None
    prior = toxic / (clean + toxic)
    odds = np.log((counts[1, :-1] + PRIOR * prior) / (counts[0, :-1] + PRIOR * (1 - prior))) - np.log(prior / (1 - prior))
    return odds.astype(np.float32)


def _first_of_equal(labelled: DataFrame) -> DataFrame:
    """Equal texts teach once for each label that they bear, in the row with the least key. Texts themselves stay in place."""
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    firsts = hashed.groupBy("h", F.md5("text").alias("m"), "label").agg(F.min("key").alias("key")).select("key", "h", "label")
    return hashed.join(narrow_side(firsts, "firsts"), ["key", "h", "label"], "left_semi").drop("h")


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the first coefficient is the intercept."""
    design = np.concatenate([np.ones((len(x), 1)), x], 1)
    beta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - y) + ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        move = np.linalg.solve(hessian, gradient)
        beta -= move
        if np.abs(move).max() < 1e-8:
            break
    return beta


def _summaries(docs: DataFrame, model: ToxicityModel, schema: str, pick) -> DataFrame:
    """What `pick(batch, summaries, model, schema)` makes of the evidence of texts (the last column)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = WordReader(own.characters, own.evidence, 0.0)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                values, bounds = reader.read(part.column(part.num_columns - 1).to_pylist())
                yield pick(part, [summarise(values[a:b]) for a, b in zip(bounds, bounds[1:])], own, out)

    return map_arrow(docs, run, schema)


def _out_of_fold(sample: DataFrame, characters: HashedModel, weights: list[np.ndarray]) -> DataFrame:
    """(label, x): summaries of labelled texts (fold, label, text) under the weights of their fold."""
    shared = sample.sparkSession.sparkContext.broadcast((characters, np.stack(weights)))  # of bounded size

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        model, by_fold = shared.value
        reader = WordReader(model, _buckets, np.full(1 + len(PREFIXES), -1, np.int32), ROWS)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                features, bounds = reader.read(part.column(2).to_pylist())
                fold = np.repeat(part.column(0).to_numpy(), np.diff(bounds))
                values = np.where(features[:, 0] >= 0, by_fold[fold[:, None], features].max(1, initial=-np.inf), 0.0)
                found = [list(summarise(values[a:b])) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found, pa.list_(pa.float64()))], schema=out)

    return map_arrow(sample, run, "label int, x array<double>")


def fit(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Train on labelled texts; `docs` is the whole corpus, for the character model.

    Feature weights are smoothed log odds over all labelled rows. Equal texts of different keys count once for each
    label that they bear; null labels, texts and keys teach nothing. The regression on the evidence is fitted on about `sample_rows`
    rows, drawn by a hash of their keys, each under weights from the other folds of the rows, so that no row is
    evidence for itself. Without rows of both labels every text gets the score 0.
    """
    characters = corpus_model(docs, text)
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(FOLDS)).cast("int")
    rows = labelled.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.col(text).alias("text"), part.alias("fold")).where("label IN (0, 1) AND text IS NOT NULL AND key IS NOT NULL")
    counts = _feature_counts(_first_of_equal(rows), characters)
    weights = _weights(counts.sum(0))  # None without texts of both labels
    if weights is None:
        return ToxicityModel(characters, np.zeros(BUCKETS), _UNFIT)
    others = [_weights(counts.sum(0) - counts[k]) for k in range(FOLDS)]
    share = min(1.0, sample_rows / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    drawn = _out_of_fold(sample.select("fold", "label", "text"), characters, [weights if w is None else w for w in others]).toArrow()
    model = ToxicityModel(characters, weights, _UNFIT)
    if drawn.num_rows:
        x, y = np.array(drawn["x"].to_pylist()), drawn["label"].to_numpy().astype(float)
        by = np.lexsort((*x.T, y))  # the sum of rows depends on their order in its last digits
        model.coefficients = _regression(x[by], y[by])
    return model


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxicity of every whole text, after restoration. Null and empty texts have no evidence.

    Rows are independent: repeated rows, null keys, ties, long texts and further columns are fine; no rows give no rows.
    Returns doc_id, score (0 to 1), predicted (1 from 0.5 on).
    """

    def pick(part: pa.RecordBatch, found: list[np.ndarray], own: ToxicityModel, out: pa.Schema) -> pa.RecordBatch:
        scores = [own.score(x) for x in found]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=out)

    pairs = keyed_texts(docs, key, text)
    kind = pairs.schema["doc_id"].dataType.simpleString()
    return _summaries(pairs, model, f"doc_id {kind}, score double, predicted int", pick)


def restored_text(text: str | None, model: HashedModel) -> str:
    """A text with its disguised words restored, lower-case."""
    restorer = Restorer(model)
    lower = _SPACED.sub(lambda m: " ".join(restorer.restore_row(m.group())) or m.group(), (text or "").lower())
    return " ".join(restorer.restore_token(t) for t in lower.split())
