"""A global order number without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolot.runtime import materialize


def with_order(df: DataFrame, keys: list[Column], name: str = "idx") -> DataFrame:
    """Number rows from 0 in the order of the keys: range partitions, places inside them, and their offsets."""
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = df.select("*", *(k.alias(f"__k{i}") for i, k in enumerate(keys)))
    cols = [f"__k{i}" for i in range(len(keys))]
    dealt = named.repartitionByRange(partitions, *cols).withColumn("__part", F.spark_partition_id())
    stored = materialize(dealt, "order")
    counts = stored.groupBy("__part").agg(F.count("*").alias("n"))  # one row per partition
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*cols)) - 1
    numbered = stored.withColumn("__place", place).join(F.broadcast(before), "__part")  # as many rows as partitions
    return numbered.select(*df.columns, (F.col("__place") + F.col("__before")).cast("bigint").alias(name))
