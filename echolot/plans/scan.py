"""The whole scan: files, exact pass, fingerprints, similar pass, groups and keepers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolot.functions import formats
from echolot.operators import exact, groups, keep, matcher
from echolot.options import ScanOptions
from echolot.runtime import materialize
from echolot.sources import audio, folder


@dataclass
class ScanResult:
    """Tables of a scan. `groups` has kind, rep, confidence, files, reclaimable, the largest gain first;
    `membership` has kind, rep, idx, confidence."""

    files: DataFrame
    groups: DataFrame
    membership: DataFrame
    skipped: DataFrame
    options: ScanOptions

    def members(self) -> DataFrame:
        """One row per file of each group."""
        return self.membership.join(self.files, "idx")

    def keepers(self, rule: str) -> DataFrame:
        rows = self.members()
        return keep.keepers(rows.withColumn("lossless", formats.is_lossless(F.col("codec_is_lossless"), formats.extension_of("path"))), rule)

    def plan(self, rule: str) -> DataFrame:
        """Files to move to the trash, as a table; executors delete nothing."""
        rows = self.members().withColumn("lossless", formats.is_lossless(F.col("codec_is_lossless"), formats.extension_of("path")))
        return keep.refuse_empty_groups(rows, keep.marks(rows, rule)).select("rep", "idx", "path", "byte_size")


_ATTRIBUTES = ["duration", "content_duration", "sample_rate", "bit_depth", "channel_count", "codec", "codec_is_lossless", "values", "shape", "flux"]


def scan(spark: SparkSession, roots: list[str], options: ScanOptions | None = None, tag: str | None = None) -> ScanResult:
    """Find groups of equal and of like recordings below the roots. Another thread may `cancel` the jobs under the tag."""
    options = options or ScanOptions()
    if tag:
        spark.addTag(tag)
    try:
        return _scan(spark, roots, options)
    finally:
        if tag:
            spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the scans that run under a tag."""
    spark.interruptTag(tag)


def _scan(spark: SparkSession, roots: list[str], options: ScanOptions) -> ScanResult:
    files = materialize(folder.collect(spark, roots, options), "files")
    hashes = folder.with_content_hash(spark, exact.size_candidates(files)) if options.find_exact else None
    files = files.join(hashes, "idx", "left") if hashes is not None else files.withColumn("content_hash", F.lit(None).cast("string"))
    files = materialize(files, "hashed")
    found = materialize(exact.exact_members(files, exact.exact_groups(files)), "exact")
    similar = spark.createDataFrame([], "rep bigint, idx bigint, confidence double")
    skipped = spark.createDataFrame([], "name string, reason string")
    if options.find_similar:
        firsts = exact.representatives(files, found)
        if firsts.limit(1).count():
            analysed = audio.analyze_files(spark, firsts, options.minimum_duration, options.maximum_seconds)
            joined = files.join(analysed.drop("error", "leading", "trailing", "truncated"), "idx", "left")
            files = materialize(exact.fill_from_representative(joined, found, _ATTRIBUTES), "files")
            fps = analysed.where("values IS NOT NULL").select("idx", "values", "shape", "flux", F.col("content_duration").alias("duration"))
            edges = materialize(matcher.match_edges(fps, options.matching), "edges")
            similar = groups.expand_similar(matcher.groups_of(edges), found)
            bad = analysed.where("error IS NOT NULL").select("idx", "error").join(files.select("idx", "path"), "idx")
            reason = formats.skip_reason(formats.extension_of("path"), F.col("error"), F.lit(None).cast("double"), options.minimum_duration)
            skipped = bad.select(formats.display_name("path").alias("name"), reason.alias("reason"))
    else:
        empty = {"values": "array<bigint>", "shape": "array<smallint>", "flux": "double", "codec": "string", "codec_is_lossless": "boolean", "bit_depth": "int", "channel_count": "int"}
        files = files.select("*", *(F.lit(None).cast(empty.get(c, "double")).alias(c) for c in _ATTRIBUTES))
    membership = materialize(groups.all_groups(found, similar), "groups")
    return ScanResult(files, groups.ranked(membership, files), membership, skipped, options)
