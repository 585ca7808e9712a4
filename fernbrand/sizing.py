"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 48_000_000


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)) + 16
        return F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * 8 + 16
    if isinstance(kind, (T.StructType, T.MapType)):
        return F.coalesce(F.length(F.to_json(F.struct(column))), F.lit(0)) + 16
    return F.lit(8)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of at most ``bytes_`` bytes together, else ``df`` as it is.

    The count stops at ``rows + 1``. Beyond the limits the join that follows shuffles by key,
    and adaptive execution splits skewed partitions.
    """
    size = F.lit(0)
    for f in df.schema.fields:
        size = size + _bytes(F.col(f"`{f.name}`"), f.dataType)
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["b"] or 0) <= bytes_ else df
