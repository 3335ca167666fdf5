"""Shuffles of finished steps don't stay on disk until the last."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from echolot.runtime import materialize, release


def test_release_drops_shuffles_of_stored_tables(spark):
    blocks = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    release(spark)
    time.sleep(2)
    before = set(blocks.rglob("shuffle_*.data"))
    stored = materialize(spark.range(10_000).groupBy(F.col("id") % 97).agg(F.count("*").alias("n")), "counts")
    for _ in range(20):
        release(spark)
        time.sleep(0.3)
        if not set(blocks.rglob("shuffle_*.data")) - before:
            break
    assert not set(blocks.rglob("shuffle_*.data")) - before and stored.count() == 97
