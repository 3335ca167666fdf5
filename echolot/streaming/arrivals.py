"""Files that arrive over time: exact duplicates as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def duplicate_arrivals(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running groups (content_hash, files, first, reclaimable) of a stream with content_hash, path, byte_size, modified.

    The state is one row per hash seen within the watermark.
    """
    marked = files.withWatermark("modified", delay).where("content_hash IS NOT NULL")
    made = marked.groupBy("content_hash").agg(F.count("*").alias("files"), F.min("path").alias("first"), (F.sum("byte_size") - F.max("byte_size")).cast("bigint").alias("reclaimable"))
    return made.where("files > 1")


def follow(files: DataFrame, known_path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new files to a table, with the first known path of the same content (null if new).

    Batches are idempotent: rows of a batch that is run again replace their earlier copies.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(known_path).where(F.col("batch") < number)
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        rows = batch.select("path", "content_hash", "byte_size")
        if known is not None:
            firsts = known.where("duplicate_of IS NULL").groupBy("content_hash").agg(F.min("path").alias("known"))
            rows = rows.join(firsts, "content_hash", "left")
        else:
            rows = rows.withColumn("known", F.lit(None).cast("string"))
        inside = rows.groupBy("content_hash").agg(F.min("path").alias("least"))
        joined = rows.join(inside, "content_hash", "left")
        of = F.coalesce("known", F.when(F.col("path") != F.col("least"), F.col("least")))
        joined.select("path", "content_hash", "byte_size", of.alias("duplicate_of")).write.mode("overwrite").parquet(f"{known_path}/batch={number}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
