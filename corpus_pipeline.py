"""The corpus pipeline: stages over `documents`, each written as Parquet and read again for the next.

Null texts have no language and go in the first stage, as do documents without a doc_id, which no later
table could name. Rows that repeat a doc_id stay until the near-duplicate stage, which keeps one of them for each
group of near copies: of equal keys the one whose text has the least hash, of equal texts the one whose row has.
An empty table passes through every stage. Further columns travel along up to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echolot.llm import decontam, langid, near_copies, packing, templates
from echolot.llm.joins import narrow_side
from echolot.llm.queries import WORD_BPE
from echolot.runtime import materialize, release_executors, table


def _others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def _restored(found: DataFrame, columns: list[str], changed: dict[str, Column]) -> DataFrame:
    """The columns of documents again, from the struct in which an operator carried them."""
    return found.select(*(changed.get(c, F.col("carried").getField(c)).alias(c) for c in columns))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models accept; lang becomes the prediction."""
    found = langid.identify(docs, langid.fit(docs), carry=_others(docs)).where("NOT rejected AND doc_id IS NOT NULL")
    return _restored(found, docs.columns, {"text": F.col("text"), "lang": F.col("lang_pred")})


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across documents; n_chars follows the text."""
    found = templates.drop_recurring_lines(docs, carry=_others(docs))
    return _restored(found, docs.columns, {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")})


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    groups = materialize(near_copies.near_copies(docs), "near-copies")
    gone = narrow_side(groups.where("NOT keeper").select(F.col("doc_id").alias("key"), F.col("text_id").alias("hash")).distinct(), "gone")
    again = groups.where("keeper").groupBy(F.col("doc_id").alias("key"), F.col("text_id").alias("hash")).agg(F.count("*").alias("n")).where("n > 1").select("key", "hash")
    again = narrow_side(again, "again")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), near_copies.text_id("text").alias("hash"))
    kept = packed.join(gone, ["key", "hash"], "left_anti")
    repeated = kept.join(again, ["key", "hash"], "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("key", "hash").orderBy(F.xxhash64("row"), F.to_json("row"))))
    once = kept.join(again, ["key", "hash"], "left_anti").select("row").unionByName(repeated.where("place = 1").select("row"))
    return once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    hit = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id")
    return docs.join(narrow_side(hit, "hit"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    pieces = packing.token_pieces(docs, WORD_BPE, entries=250_000)  # other stages have used the same workers
    return packing.pack_best_fit(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_room(stage: Stage) -> Stage:
    """The stage, begun with heaps as small as they can be: its Python workers share an executor's memory with them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language", _with_room(identified)),
    ("lines", _with_room(without_recurring_lines)),
    ("near_duplicates", _with_room(without_near_duplicates)),
    ("decontamination", _with_room(decontaminated)),
    ("packing", _with_room(packed)),
]

#: SQL can't express the language models and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
