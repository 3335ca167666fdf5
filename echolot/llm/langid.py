"""Language identification by character language models, one per language.

The n-grams of all training texts are counted. While the models are known to be small they go to every task as
sorted arrays; beyond a bound on their size the counts stay in tables, the different words of the texts are scored
by joins on their n-grams, and texts add up the scores of their words. Both ways follow the same formula.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolot.llm.arrow import map_arrow
from echolot.llm.kneser_ney import ALPHABET, DISCOUNT, ORDER, CharacterModels, WordScores, count_keys, merge_counts, suffix_mask, train, word_keys
from echolot.runtime import materialize

#: Different words, over all languages, after which a task counts their n-grams; n-grams after which it sends them.
FLUSH_WORDS, FLUSH_KEYS = 80_000, 1_000_000
#: Documents that are judged at a time.
SLICE = 500
#: N-grams, and probabilities (n-grams times languages), up to which models go to every task; beyond that they are joined.
MODEL_ENTRIES, MODEL_CELLS = 2_000_000, 8_000_000
#: Quantile of a language's training documents from which its limit is reckoned, as many times the distance
#: from their median, bits of slack beyond it, and bits that are divided by the root of a text's length, for
#: the noise of short texts. Junk up to a share of 1 - QUANTILE of a language can't lift its limit.
QUANTILE, SPREAD, SLACK, NOISE = 0.9, 4.0, 0.5, 10.0
#: Steps per bit of the calibration histogram, and bits that it spans.
_STEPS, _SPAN = 50, 40

_LETTER = re.compile(r"[^\W\d_]")


def _words(text: str) -> list[str]:
    return text.lower().split()


def ngram_counts(train_docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, key, n): how often each character n-gram occurs in all texts of a language."""

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def gather() -> None:
            for name, words in counts.items():
                fresh = count_keys(list(words), np.fromiter(words.values(), np.int64, len(words)), order)
                tables[name] = merge_counts(tables[name], fresh) if name in tables else fresh
            counts.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (keys, n) in tables.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], schema=out)
            tables.clear()

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(name, Counter()).update(_words(content))
                if sum(map(len, counts.values())) > FLUSH_WORDS:
                    gather()
                    if sum(len(keys) for keys, _ in tables.values()) > FLUSH_KEYS:
                        yield from flush()
        gather()
        yield from flush()

    known = train_docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return map_arrow(known, run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def collect_tables(counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """N-gram tables (lang, key, n) for the driver, sorted by key; for tables of checked size."""
    rows = counts.toArrow()
    names, keys, n = rows["lang"].to_numpy(), rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    tables = {}
    for name in sorted(set(names.tolist())):
        own = np.flatnonzero(names == name)
        own = own[np.argsort(keys[own])]
        tables[name] = (keys[own], n[own])
    return tables


def lower_order(table: DataFrame, k: int) -> DataFrame:
    """(lang, key, n) of k-grams from the table of (k + 1)-grams: see `kneser_ney.train`."""
    summed = table.groupBy("lang", F.col("key").bitwiseAND(F.lit(suffix_mask(k))).alias("key")).agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
    begins = (F.shiftrightunsigned("key", 16 * (k - 1)) == ord(" ")) & F.lit(k > 1)
    return summed.select("lang", "key", F.when(begins, F.col("total")).otherwise(F.col("kinds")).alias("n"))


def context_sums(table: DataFrame) -> DataFrame:
    """(lang, context, total, followers) of a table of n-grams."""
    return table.groupBy("lang", F.shiftrightunsigned("key", 16).alias("context")).agg(F.sum("n").cast("double").alias("total"), F.count("*").cast("double").alias("followers"))


@dataclass
class JoinedModels:
    """Models as tables: for each order k the counts by k-gram and the sums by context, one map over languages a row."""

    names: list[str]
    order: int
    discount: float
    counts: list[DataFrame]
    contexts: list[DataFrame]

    @staticmethod
    def of(counts: DataFrame, names: list[str], order: int, discount: float) -> JoinedModels:
        by_key, by_context, table = [], [], counts
        for k in range(order, 0, -1):
            table = table if k == order else materialize(lower_order(table, k), f"grams{k}")
            entry = F.map_from_entries(F.collect_list(F.struct("lang", F.col("n").cast("double"))))  # one entry a language
            sums = F.map_from_entries(F.collect_list(F.struct("lang", F.struct("total", "followers"))))
            by_key.insert(0, materialize(table.groupBy("key").agg(entry.alias("counts")), f"keys{k}"))
            by_context.insert(0, materialize(context_sums(table).groupBy("context").agg(sums.alias("sums")), f"contexts{k}"))
        return JoinedModels(names, order, discount, by_key, by_context)

    def score_keys(self, keys: DataFrame) -> DataFrame:
        """(key, logs): log2 probability of the last character of different n-grams in each model, in order of names."""
        names = F.array(*map(F.lit, self.names))
        found = keys.withColumn("p", F.transform(names, lambda _: F.lit(1.0 / ALPHABET)))
        for k, (counts, contexts) in enumerate(zip(self.counts, self.contexts, strict=True), 1):
            gram = F.col("key") if k == self.order else F.col("key").bitwiseAND(F.lit(suffix_mask(k)))
            found = found.withColumn("gram", gram).withColumn("context", F.shiftrightunsigned("gram", 16))
            found = found.join(counts.withColumnRenamed("key", "gram"), "gram", "left").join(contexts, "context", "left")

            def step(name: Column, i: Column) -> Column:
                n, sums = F.coalesce(F.try_element_at("counts", name), F.lit(0.0)), F.try_element_at("sums", name)
                own = F.greatest(n - self.discount, F.lit(0.0)) / sums["total"]
                return F.when(sums.isNull(), F.get("p", i)).otherwise(own + self.discount * sums["followers"] / sums["total"] * F.get("p", i))

            found = found.select("key", F.transform(names, step).alias("p"))
        return found.select("key", F.transform("p", lambda x: F.log2(F.greatest(x, F.lit(1e-30)))).alias("logs"))

    def text_bits(self, texts: DataFrame) -> DataFrame:
        """(id, total): log2 probability of all words of different texts (id, text) in each model."""
        order = self.order

        def counted(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = Counter(_words(content or ""))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(words.values(), pa.int64())], schema=out)

        def grams(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(0).to_pylist()
                keys, starts = word_keys(words, order)
                sizes = np.diff(np.append(starts, len(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(words)), sizes))), pa.array(keys.view(np.int64))], schema=out)

        held = materialize(map_arrow(texts.select("id", "text"), counted, "id string, word string, n bigint"), "word-counts")
        spelled = materialize(map_arrow(held.select("word").distinct(), grams, "word string, key bigint"), "word-grams")
        scored = materialize(self.score_keys(spelled.select("key").distinct()), "gram-scores")
        sums = [F.sum(F.get("logs", F.lit(j))).alias(f"s{j}") for j in range(len(self.names))]
        words = spelled.join(scored, "key").groupBy("word").agg(*sums)
        added = [F.sum(F.col("n") * F.col(f"s{j}")) for j in range(len(self.names))]
        return held.join(words, "word").groupBy("id").agg(F.array(*added).alias("total"))


@dataclass
class LanguageIdentifier:
    """Models with the cross-entropy beyond which each language rejects a text."""

    models: CharacterModels | JoinedModels
    limits: np.ndarray

    def judge(self, content: str | None, words: list[str], total: np.ndarray) -> tuple[str, float, float, bool, np.ndarray]:
        """(language, score, bits per character, rejected, bits per character in each model)."""
        return _judge(self.models.names, self.limits, content, words, total)


def _judge(names: list[str], limits: np.ndarray, content: str | None, words: list[str], total: np.ndarray) -> tuple[str, float, float, bool, np.ndarray]:
    if not names or content is None or not _LETTER.search(content):
        return "und", 0.0, float("nan"), True, np.full(len(names), np.nan)
    characters = sum(map(len, words)) + len(words)
    bits = -total / characters
    best = int(np.argmin(bits))
    odds = np.exp2(np.minimum(0.0, (bits[best] - bits) * characters))
    return names[best], float(1 / odds.sum()), float(bits[best]), bool(bits[best] > limits[best] + NOISE / characters**0.5), bits


def _judged(docs: DataFrame, identifier: LanguageIdentifier, schema: str | T.StructType, pick) -> DataFrame:
    """Run the identifier over texts (the first column) and emit what `pick(batch, judgements)` makes of each batch."""
    names, limits = identifier.models.names, identifier.limits
    joined = isinstance(identifier.models, JoinedModels)
    if joined:
        marked = docs.withColumn("id", F.md5("text"))
        totals = identifier.models.text_bits(marked.where("text IS NOT NULL").groupBy("id").agg(F.first("text").alias("text")))
        docs = marked.join(totals, "id", "left").drop("id")
        shared = None
    else:
        shared = docs.sparkSession.sparkContext.broadcast(identifier.models)  # of checked size, see `fit`

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        scores = None if joined else WordScores(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                texts = part.column(0).to_pylist()
                words = [_words(x or "") for x in texts]
                if joined:
                    totals = [np.zeros(len(names)) if x is None else np.array(x) for x in part.column(part.num_columns - 1).to_pylist()]
                else:
                    totals = list(scores.totals(words))
                yield pick(part, [_judge(names, limits, x, w, t) for x, w, t in zip(texts, words, totals, strict=True)], out)

    return map_arrow(docs, run, schema)


def fit(train_docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, discount: float = DISCOUNT) -> LanguageIdentifier:
    """Count n-grams over all training texts, train the models, and calibrate rejection on all of these texts.

    Rows with null language or text teach nothing; no n-gram is left out at any size. The limit of a language comes
    from the cross-entropies of all its documents under its own model: their median, plus SPREAD times the distance
    from there to their QUANTILE, plus SLACK. A language none of whose texts has a letter accepts nothing.
    """
    counts = materialize(ngram_counts(train_docs, lang, text, order), "ngrams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # one row a language
    small = counts.count() <= MODEL_ENTRIES and counts.select("key").distinct().count() * len(names) <= MODEL_CELLS
    models = train(collect_tables(counts), order, discount) if small else JoinedModels.of(counts, names, order, discount)
    identifier = LanguageIdentifier(models, np.full(len(names), -np.inf))
    if not names:
        return identifier

    place = {name: j for j, name in enumerate(names)}

    def pick(part: pa.RecordBatch, judged: list[tuple], out: pa.Schema) -> pa.RecordBatch:
        bits = [(name, j[4][place[name]]) for name, j in zip(part.column(1).to_pylist(), judged, strict=True) if name in place]
        pairs = Counter((name, min(_SPAN * _STEPS, int(b * _STEPS))) for name, b in bits if b == b)
        found, bins = [k[0] for k in pairs], [k[1] for k in pairs]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(bins, pa.int32()), pa.array(list(pairs.values()), pa.int64())], schema=out)

    known = train_docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    histogram = _judged(known, identifier, "lang string, bin int, n bigint", pick).groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()
    for j, name in enumerate(names):  # at most _SPAN * _STEPS rows for each language
        rows = sorted((r["bin"], r["n"]) for r in histogram if r["lang"] == name)
        if rows:
            seen = np.cumsum([n for _, n in rows])
            middle, high = ((rows[int(np.searchsorted(seen, q * seen[-1]))][0] + 1) / _STEPS for q in (0.5, QUANTILE))
            identifier.limits[j] = middle + SPREAD * (high - middle) + SLACK
    return identifier


def identify(docs: DataFrame, identifier: LanguageIdentifier, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Predict the language of every whole text: the model with the lowest cross-entropy per character.

    Texts that are null or have no letter get `und`, score 0 and rejected = true; so does every text if the
    training data had no language. Equal cross-entropies go to the name that sorts first. Rows are
    independent: repeated rows, null keys and long texts are fine. Other columns are ignored, but those named in
    `carry` come back as the struct column `carried`, whatever their names, and the text beside them.

    Returns doc_id, lang_pred, score (posterior among the models, 0 to 1), bits_per_char, rejected.
    """

    def pick(part: pa.RecordBatch, judged: list[tuple], out: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([j[k] for j in judged], out.field(k + 1).type) for k in range(4)]
        return pa.RecordBatch.from_arrays([part.column(1), *columns, *([part.column(0), part.column(2)] if carry else [])], schema=out)

    extra = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []
    source = docs.select(F.col(text).alias("text"), F.col(key).alias("doc_id"), *extra)
    found = T.StructType.fromDDL("lang_pred string, score double, bits_per_char double, rejected boolean").fields
    also = [source.schema["text"], source.schema["carried"]] if carry else []
    return _judged(source, identifier, T.StructType([source.schema["doc_id"], *found, *also]), pick)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds."""
    return F.crc32(key.cast("string")) % folds
