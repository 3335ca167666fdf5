"""Which file of a group stays.

Group tables have one row per file: rep (the group), idx (file order), path, byte_size, modified, and the
nullable duration, content_duration, sample_rate, bit_depth, channel_count and lossless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolot.functions.formats import path_depth
from echolot.options import KeepRule

#: A file this much shorter than the longest of its group is incomplete.
COMPLETE = 0.95

_QUALITY = ("idx", "path", "byte_size", "duration", "sample_rate", "bit_depth", "channel_count", "lossless")


def _sign(better: Column, worse: Column) -> Column:
    """-1, 1 or null for no difference."""
    return F.when(better, F.lit(-1)).when(worse, F.lit(1))


def _more(a: Column, b: Column) -> Column:
    """The larger is better, if both are known."""
    return _sign(a > b, a < b)


def quality_order(a: Column, b: Column) -> Column:
    """Negative if a is worse than b, positive if better, 0 if equal. It isn't transitive: unknowns skip a test."""
    known_a, known_b = a["duration"].isNotNull(), b["duration"].isNotNull()
    lossless_a, lossless_b = F.coalesce(a["lossless"], F.lit(False)), F.coalesce(b["lossless"], F.lit(False))
    rate = lambda f: F.coalesce(F.when(f["duration"] > 0.05, F.round(f["byte_size"] * 8 / f["duration"] / 1000)), F.lit(0.0))
    tests = [
        _sign(known_a & ~known_b, known_b & ~known_a),
        F.when(a["lossless"].isNotNull() & b["lossless"].isNotNull(), _sign(lossless_a & ~lossless_b, lossless_b & ~lossless_a)),
        F.when(~lossless_a & ~lossless_b, _more(rate(a), rate(b))),
        _more(a["sample_rate"], b["sample_rate"]),
        _more(a["bit_depth"], b["bit_depth"]),
        _more(a["channel_count"], b["channel_count"]),
        _more(-a["byte_size"], -b["byte_size"]),
        _more(-F.length(a["path"]), -F.length(b["path"])),
    ]
    return -F.coalesce(*tests, F.lit(0))


def complete_files(files: DataFrame) -> DataFrame:
    """Files about as long as the longest of their group; an unknown length counts as the longest."""
    longest = files.groupBy("rep").agg(F.max("content_duration").alias("__longest"))
    marked = files.join(longest, "rep")
    return marked.where(F.col("__longest").isNull() | (F.coalesce("content_duration", "__longest") >= F.col("__longest") * COMPLETE)).drop("__longest")


def best_quality(files: DataFrame) -> DataFrame:
    """(rep, idx): fold over the files in order, the last of equals wins.

    The order matters, as the relation has cycles; so the attributes of a group (some 100 bytes a file) meet in one row.
    """
    packed = complete_files(files).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct(*_QUALITY))).alias("fs"))
    folded = F.aggregate(F.slice("fs", 2, F.greatest(F.size("fs") - 1, F.lit(0))), F.element_at("fs", 1), lambda best, x: F.when(quality_order(best, x) <= 0, x).otherwise(best))
    return packed.select("rep", folded.alias("keep")).select("rep", F.col("keep.idx").alias("idx"))


def keepers(files: DataFrame, rule: KeepRule | str) -> DataFrame:
    """(rep, idx) of the file that stays in each group."""
    rule = KeepRule(rule)
    if rule is KeepRule.BEST_QUALITY:
        return best_quality(files)
    least = {
        KeepRule.SMALLEST: F.min(F.struct("byte_size", "idx")),
        KeepRule.OLDEST: F.min(F.struct("modified", "idx")),
        KeepRule.SHALLOWEST: F.min(F.struct(path_depth("path").alias("depth"), F.length("path").alias("length"), "path", "idx")),
        KeepRule.LARGEST: F.max(F.struct("byte_size", "idx")),
        KeepRule.NEWEST: F.max(F.struct("modified", "idx")),
    }
    # aggregates of one row, so a group of any size is reduced before the shuffle
    return files.groupBy("rep").agg(least[rule].alias("keep")).select("rep", F.col("keep.idx").alias("idx"))


def marks(files: DataFrame, rule: KeepRule | str) -> DataFrame:
    """Files to remove: all of a group but its keeper."""
    return files.join(keepers(files, rule), ["rep", "idx"], "left_anti")


def refuse_empty_groups(files: DataFrame, marked: DataFrame) -> DataFrame:
    """Marks without those of groups in which nothing would stay."""
    left = files.join(marked.select("rep", "idx"), ["rep", "idx"], "left_anti").select("rep").distinct()
    return marked.join(left, "rep", "left_semi")
