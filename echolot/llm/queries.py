"""Queries over the ten operators: they apply each one to its whole table and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolot.llm import decontam, langid, mpeg, packing, repeats, simhash, templates, tokens, toxicity, wavelet
from echolot.llm.joins import narrow_side
from echolot.runtime import table

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    labels = narrow_side(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "labels")
    labelled = docs.where(~held_out).select("doc_id", "text").join(labels, "doc_id")
    model = toxicity.fit(docs, labelled)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mpeg.audio_columns(table(spark, sf_dir, "documents"))
    feature = F.format_string("frames=%d table=%d crc=%d/%d skipped=%d samples=%d/%d seek=%d", "frames", "table_frames", "crc_bad", "crc_checked", "skipped", "samples", "rate", F.element_at("seek_offsets", -1))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"),
        F.length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), WORD_BPE)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_best_fit(digests)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = langid.fold(F.col("doc_id"), 4)
    identifier = langid.fit(docs.where(fold != 2))
    found = langid.identify(docs, identifier)
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op10_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = wavelet.write_shards(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return wavelet.read_shards(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_benchmark_decontamination,
        op3_token_counts,
        op4_substring_dedup,
        op5_mpeg_audio,
        op6_best_fit_packing,
        op7_language_id,
        op8_simhash_neardup,
        op9_line_templates,
        op10_wavelet_matrix,
    )
}
