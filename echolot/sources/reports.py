"""Reports of a scan."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolot.functions import formats
from echolot.plans.scan import ScanResult


def report_groups(result: ScanResult) -> DataFrame:
    """Canonical groups: kind, paths by name, confidence to three places, reclaimable bytes, keepers by rule."""
    members = result.members()
    base = members.groupBy("kind", "rep", "confidence").agg(
        F.array_sort(F.collect_list(formats.display_name("path"))).alias("paths"), (F.sum("byte_size") - F.max("byte_size")).cast("bigint").alias("reclaimableBytes")
    )
    kept = [result.keepers(rule).join(result.files.select("idx", formats.display_name("path").alias("name")), "idx").select("rep", F.lit(rule.label).alias("rule"), "name") for rule in result.options.keep_rules]
    keepers = reduce(DataFrame.unionByName, kept).groupBy("rep").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "name")))).alias("keepers"))
    full = base.join(keepers, "rep", "left").withColumn("confidence", F.round("confidence", 3))
    return full.select("kind", "paths", "confidence", "reclaimableBytes", "keepers").orderBy("kind", F.array_join("paths", "|"))


def report_json(result: ScanResult) -> DataFrame:
    """The report as one JSON text per row: a header, then the groups in order."""
    head = result.files.agg(F.count("*").alias("filesScanned")).crossJoin(result.skipped.agg(F.array_sort(F.collect_list("name")).alias("skipped")))  # one row each
    lines = report_groups(result).select(F.to_json(F.struct("*")).alias("value"))
    return head.select(F.to_json(F.struct("*")).alias("value")).unionByName(lines)


def write_json(result: ScanResult, path: str) -> None:
    report_groups(result).write.mode("overwrite").json(path)


def write_report(result: ScanResult, path: str) -> None:
    """The whole report as one JSON document in a local file, group by group, so the driver holds one at a time."""
    head = json.loads(report_json(result).first()["value"])
    with open(path, "w", encoding="utf-8") as out:
        out.write('{"filesScanned": %d, "groups": [' % head["filesScanned"])
        for place, row in enumerate(report_groups(result).select(F.to_json(F.struct("*")).alias("value")).toLocalIterator()):
            out.write((", " if place else "") + row["value"])
        out.write('], "skipped": %s}' % json.dumps(head["skipped"], ensure_ascii=False))


def report_text(result: ScanResult) -> str:
    """A listing for people; it is as long as the report, so meant for single scans."""
    out = []
    for row in report_groups(result).toLocalIterator():
        out.append(f"{row.kind}  {row.confidence:.3f}  {len(row.paths)} files, {row.reclaimableBytes} bytes to reclaim")
        out += [f"    {p}" for p in row.paths]
    return "\n".join(out) or "no duplicates found"


def write_pcm(samples: DataFrame, path: str) -> None:
    """Decoded samples as Parquet arrays of floats."""
    samples.where("samples IS NOT NULL").write.mode("overwrite").parquet(path)
