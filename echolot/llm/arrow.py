"""Helpers for functions that run over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Rows and bytes of an Arrow batch; texts may be long, and a batch lies in memory several times.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Smaller batches than Spark's defaults; a session's own smaller values stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def _release() -> None:
    """Give free memory back at the end of a task: workers live on and run the next operator."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, function, schema: str | T.StructType, release: bool = True) -> DataFrame:
    """mapInArrow with the Arrow schema handed to `function(batches, arrow_schema)`.

    Without `release` a worker keeps its free memory, for functions whose dictionaries outlive a task.
    """
    _bound_batches(df.sparkSession)
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    out = to_arrow_schema(struct)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches, out)
        if release:
            _release()

    return df.mapInArrow(run, struct)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Values of a string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, under fixed names; other columns, clashing names included, stay outside."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
