"""Exact and similar groups together: expansion, absorption, order, marks and reports.

Groups are tables with one row per member: kind, rep (the first file of the group), idx, confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_similar(similar: DataFrame, exact: DataFrame) -> DataFrame:
    """Similar groups (rep, idx, confidence) of representatives with all the files that these stand for (exact: idx, rep)."""
    copies = exact.where("idx <> rep").select(F.col("rep").alias("idx"), F.col("idx").alias("copy"))
    return similar.unionByName(similar.join(copies, "idx").select("rep", F.col("copy").alias("idx"), "confidence"))


def absorb_exact(exact: DataFrame, similar: DataFrame) -> DataFrame:
    """Exact groups that no similar group holds: copies move together, so the representative decides."""
    return exact.join(similar.select(F.col("idx").alias("rep")).distinct(), "rep", "left_anti")


def all_groups(exact: DataFrame, similar: DataFrame) -> DataFrame:
    """(kind, rep, idx, confidence) of exact groups that remain and similar ones."""
    one = absorb_exact(exact, similar).select(F.lit("exact").alias("kind"), "rep", "idx", F.lit(1.0).alias("confidence"))
    return one.unionByName(similar.select(F.lit("similar").alias("kind"), "rep", "idx", "confidence"))


def ranked(groups: DataFrame, files: DataFrame, idx: str = "idx", size: str = "byte_size") -> DataFrame:
    """Groups with numbers of files and reclaimable bytes, the most first; exact before similar, then file order, on ties."""
    sized = groups.join(files.select(F.col(idx).alias("idx"), F.col(size).alias("size")), "idx").groupBy("kind", "rep")
    made = sized.agg(F.min("confidence").alias("confidence"), F.count("*").alias("files"), (F.sum("size") - F.max("size")).cast("bigint").alias("reclaimable"))
    return made.orderBy(F.desc("reclaimable"), F.when(F.col("kind") == "exact", 0).otherwise(1), "rep")


def summary(groups: DataFrame) -> DataFrame:
    """Numbers of groups, files and reclaimable bytes of a ranked table."""
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files"), F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("bigint").alias("reclaimable"))


def after_removal(groups: DataFrame, removed: DataFrame, idx: str = "idx") -> DataFrame:
    """Members of groups without removed files; groups with fewer than two left go."""
    left = groups.join(removed.select(F.col(idx).alias("idx")), "idx", "left_anti")
    enough = left.groupBy("kind", "rep").agg(F.count("*").alias("n")).where("n > 1").select("kind", "rep")
    return left.join(enough, ["kind", "rep"], "left_semi")


def compare_reports(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Entries of two reports: only in one, in both, or in both with different values."""
    left, right = a.select(key, F.col(value).alias("value_a"), F.lit(True).alias("in_a")), b.select(key, F.col(value).alias("value_b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(F.col("value_a").eqNullSafe(F.col("value_b")), "same").otherwise("changed")
    return left.join(right, key, "full").select(key, status.alias("status"), "value_a", "value_b")
