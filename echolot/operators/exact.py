"""Byte-identical files: cheap key first, hash second, collapse before anything expensive.

Groups are tables with one row per member, so that a group of any size stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_candidates(files: DataFrame, size: str = "byte_size") -> DataFrame:
    """Files whose size occurs more than once. Counts are aggregated apart, so a common size isn't one task's work."""
    shared = files.groupBy(size).agg(F.count("*").alias("__n")).where("__n > 1").select(size)
    return files.join(shared, size, "left_semi")


def exact_groups(hashed: DataFrame, idx: str = "idx", content_hash: str = "content_hash", size: str = "byte_size") -> DataFrame:
    """Groups (content_hash, files, rep, reclaimable) of files with equal hashes; null hashes are unique."""
    grouped = hashed.where(F.col(content_hash).isNotNull()).groupBy(F.col(content_hash).alias("content_hash"))
    return grouped.agg(F.count("*").alias("files"), F.min(idx).alias("rep"), reclaimable(F.col(size)).alias("reclaimable")).where("files > 1")


def exact_members(hashed: DataFrame, groups: DataFrame, idx: str = "idx", content_hash: str = "content_hash") -> DataFrame:
    """(idx, rep): the files of each exact group."""
    keyed = hashed.select(F.col(idx).alias("idx"), F.col(content_hash).alias("content_hash"))
    return keyed.join(groups.select("content_hash", "rep"), "content_hash").select("idx", "rep")


def reclaimable(size: Column) -> Column:
    """Bytes freed when all but the largest file go; an aggregate."""
    return F.when(F.count("*") > 1, F.sum(size) - F.max(size)).otherwise(F.lit(0)).cast("bigint")


def representatives(files: DataFrame, members: DataFrame, idx: str = "idx") -> DataFrame:
    """Files without the later members of exact groups."""
    later = members.where("idx <> rep").select(F.col("idx").alias(idx))
    return files.join(later, idx, "left_anti")


def fill_from_representative(files: DataFrame, members: DataFrame, columns: list[str], idx: str = "idx") -> DataFrame:
    """Copy attributes found for a representative to the members that it stands for, where they have none."""
    source = files.select(F.col(idx).alias("rep"), *(F.col(c).alias(f"__{c}") for c in columns))
    known = members.select(F.col("idx").alias(idx), "rep").join(source, "rep").drop("rep")
    joined = files.join(known, idx, "left")
    return joined.select(*(F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in files.columns))
