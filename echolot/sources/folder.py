"""Folders of recordings as a table of files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from echolot.functions import formats
from echolot.operators.order import with_order
from echolot.options import ScanOptions
from echolot.runtime import new_path

#: Paths that one read job is given.
PATHS_AT_ONCE = 20_000


def plain_path(path: str | Column) -> Column:
    """Local URIs as plain paths; those of other stores stay."""
    return F.regexp_replace(path, "^file:/+", "/")


def plain_root(root: str) -> str:
    """A root as its files' paths begin; a local one without links and `..`."""
    path = re.sub("^file:/+", "/", root)
    return os.path.realpath(path) if path.startswith("/") else path.rstrip("/")


def distinct_roots(roots: list[str]) -> list[str]:
    return list(dict.fromkeys(plain_root(r) for r in roots))


@F.pandas_udf(BooleanType())
def _reached_without_links(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: os.path.realpath(p) == p)


def list_files(spark: SparkSession, root: str, options: ScanOptions) -> DataFrame:
    """(path, byte_size, modified) of the files below one root. The content isn't read.

    A file is hidden if any part of its path below the root starts with a dot; the root itself is never tested.
    Links below a local root aren't followed, so every path is the file's own.
    """
    root = plain_root(root)
    local = root.startswith("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", str(options.include_subfolders).lower()).load(f"file://{root}" if local else root)
    found = read.select(plain_path("path").alias("path"), F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"))
    found = found.where((F.col("byte_size") > 0) & formats.is_audio("path"))
    if options.skip_hidden:
        below = F.when(F.startswith(F.col("path"), F.lit(root)), F.expr(f"substring(path, {len(root) + 1})")).otherwise(F.col("path"))
        found = found.where(~F.exists(F.split(below, "/"), lambda part: part.startswith(".")))
    return found.where(_reached_without_links("path")) if local else found


def collect(spark: SparkSession, roots: list[str], options: ScanOptions | None = None) -> DataFrame:
    """All audio files below the roots, each once, numbered in path order (by component, as arrays compare).

    Unknown attributes are null: nothing is decoded here.
    """
    options = options or ScanOptions()
    found = reduce(DataFrame.unionByName, [list_files(spark, r, options) for r in distinct_roots(roots)])
    once = found.dropDuplicates(["path"])
    return with_order(once, [F.split("path", "/")]).withColumn("format_name", formats.format_label(formats.extension_of("path")))


def map_listed(spark: SparkSession, files: DataFrame, function: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """Apply a function from (idx, path, content) to the binary files that a table lists, and read no others.

    Paths go to the reader PATHS_AT_ONCE at a time, so the driver never holds the whole list. Only what the
    function makes of the content is written, to one table in the shared folder.
    """
    path = new_path(spark, tag)
    empty = spark.createDataFrame([], "idx bigint, path string, content binary")
    listed = files.select("idx", "path").toLocalIterator()
    found = False
    while chunk := [(r["idx"], r["path"]) for r in islice(listed, PATHS_AT_ONCE)]:
        rows = spark.createDataFrame(chunk, "idx bigint, path string")
        read = spark.read.format("binaryFile").load([p for _, p in chunk]).select(plain_path("path").alias("path"), "content")
        function(read.join(F.broadcast(rows), "path").select("idx", "path", "content")).write.mode("append").parquet(path)  # at most PATHS_AT_ONCE rows
        found = True
    made = function(empty)
    return spark.read.schema(made.schema).parquet(path) if found else made


def with_content_hash(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(idx, content_hash) of files: SHA-256 over the bytes, read for these files only.

    The JVM hashes the whole value, so files up to 2 GB; larger ones are outside binaryFile's reach.
    """
    return map_listed(spark, files, lambda content: content.select("idx", F.sha2("content", 256).alias("content_hash")), "hashes")
