"""Joins of documents with narrow tables of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolot.runtime import materialize

#: Rows, and bytes of their values, up to which a table is sent to all executors.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 48 << 20


def _bytes(field: T.StructField) -> Column:
    """Bytes of a value: those of texts and binaries as they are, of lists of texts joined, 8 for anything else."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
        return F.coalesce(F.octet_length(F.array_join(field.name, "")) + 16 * F.size(field.name), F.lit(0)) + 8
    return F.lit(8)


def is_small(stored: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table of flat columns and lists of texts has at most so many rows and bytes."""
    total = sum((_bytes(f) for f in stored.schema.fields), F.lit(0))
    found = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()
    return found["n"] <= rows and found["b"] <= size


def narrow_side(df: DataFrame, tag: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of keys for a join: written once, then sent to all executors if it is small (rows and bytes are counted), else shuffled.

    In the first case the documents on the other side stay where they are.
    """
    stored = materialize(df, tag)
    return F.broadcast(stored) if is_small(stored, rows) else stored
