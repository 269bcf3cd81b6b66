"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows are broadcast only if their counted size is below this bound; above it the join shuffles.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """Size of one row: fixed-width columns by width, text and binary by their real length."""
    per_row = F.lit(16)
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            per_row = per_row + F.coalesce(F.octet_length(f.name), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            per_row = per_row + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            per_row = per_row + 8
    return per_row.cast("bigint")


def counted_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def is_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return counted_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has been counted below the bound, else unchanged."""
    return F.broadcast(df) if is_small(df, limit) else df
