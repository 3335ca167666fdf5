"""Session, table and scratch-folder helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (single-machine tests).
LOCAL_SCRATCH = os.path.join(tempfile.gettempdir(), "echolot-scratch")


def session(cpus: int | str = "*", app: str = "echolot", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Without one, a session on a single machine uses its temporary folder; on a cluster that is an error, as
    executors would not see each other's files.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_SCRATCH
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder for one table, below one for this application."""
    return f"{scratch_root(spark)}/echolot-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write to the shared folder, by the session's codec if none is named, and read back, which cuts the lineage.

    The files outlive executors, so that a lost one costs a re-read and no recomputation. `clean_up` removes them.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of shuffles and broadcasts that no plan reads any more.

    Spark drops their files once the driver collects garbage, which a driver with little to do puts off.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release_executors(spark: SparkSession) -> None:
    """Let executors collect their garbage, which makes their heaps smaller.

    A heap that one step has filled stays that large through the next ones, whose Python workers need memory beside it.
    One task a core reaches every executor that isn't busy with other jobs; nothing depends on those that it doesn't reach.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()  # one row a core


def clean_up(spark: SparkSession) -> bool:
    """Remove all tables that this application has stored; results that aren't read yet go with them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/echolot-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
