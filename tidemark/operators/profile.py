"""Counts, marker bounds and lag of sources."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def marker_min(df: DataFrame, marker: str) -> DataFrame:
    return df.agg(F.min(marker).alias("min_marker"))


def marker_max(df: DataFrame, marker: str) -> DataFrame:
    return df.agg(F.max(marker).alias("max_marker"))


def marker_profile(df: DataFrame, marker: str) -> DataFrame:
    """Rows, rows without marker and both marker bounds in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(marker).isNull()).alias("n_null"),
                  F.min(marker).alias("min_marker"), F.max(marker).alias("max_marker"))


def source_max(tasks: DataFrame, sources: Mapping[str, tuple[DataFrame, str]], table_column: str = "source_table"
               ) -> DataFrame:
    """``tasks`` with the maximum marker of their source table; tables without a known source give NULL.

    ``sources`` maps a table name to (DataFrame, timestamp marker). One aggregate per source; the joined side has one
    row per source, so its size is known.
    """
    parts = [df.agg(F.max(m).cast("timestamp_ntz").alias("source_max")).withColumn(table_column, F.lit(name))
             for name, (df, m) in sources.items()]
    maxima = parts[0]
    for p in parts[1:]:
        maxima = maxima.unionByName(p)
    return tasks.join(F.broadcast(maxima), table_column, "left")


def lag_days(source_max: Column, stored: Column) -> Column:
    """Whole days the stored marker is behind the source."""
    return F.date_diff(source_max.cast("date"), stored.cast("date")).cast("bigint")


# Name pattern of likely increment columns.
INCREMENT_NAME = re.compile("ID|TIME|CREATE|UPDATE|MODIFY", re.IGNORECASE)


def increment_candidates(schema: T.StructType) -> list[str]:
    """Date/time columns and columns named like a key or a change time; all columns if there is none."""
    def fits(f):
        return isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) \
            or INCREMENT_NAME.search(f.name) is not None
    return [f.name for f in schema if fits(f)] or [f.name for f in schema]


def candidate_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per candidate column: rows, NULLs, distinct values, smallest and largest value (as text), all exact.

    Values are counted per (column, value) and combined before the shuffle, so neither a hot value nor
    a NULL-heavy column lands in one task; the second step only adds up counts.
    """
    names = list(columns or increment_candidates(df.schema))
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in names]
    per_value = (df.select(F.inline(F.array(*cells)))
                 .groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n")))
    counts = per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.count("v").alias("n_distinct"))
    # the order is that of the column's type, so the bounds are taken before values become text: one row for all columns
    ends = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))])
    each = [F.struct(F.lit(c).alias("column_name"), F.col(f"lo{i}").cast("string").alias("min_value"),
                     F.col(f"hi{i}").cast("string").alias("max_value")) for i, c in enumerate(names)]
    return counts.join(ends.select(F.inline(F.array(*each))), "column_name")


#: Column types whose smallest and largest value parquet's statistics hold exactly.
STATISTICS_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def footer_profile(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Per column of a parquet table: rows, NULLs, smallest and largest value as text.

    Counts of all columns, and the bounds of those whose statistics hold them exactly, are aggregates pushed into the files' footers: no column is
    read. The bounds of the others (texts are cut in statistics, times have none that Spark uses) come from one pass over these columns. Both need
    settings of the reader, so they run in a session of their own; what they give is one row.
    """
    with_footers = spark.newSession()
    for key, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true")):
        with_footers.conf.set(key, value)
    with_footers.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    table = with_footers.read.parquet(path)
    types = {f.name: f.dataType for f in table.schema}
    exact = [c for c in columns if isinstance(types[c], STATISTICS_TYPES)]
    counts = from_footers(table, columns, exact).first()
    found = {c: (counts["n"], counts["n"] - counts[f"n_{c}"], counts[f"lo_{c}"] if c in exact else None, counts[f"hi_{c}"] if c in exact else None) for c in columns}
    rest = [c for c in columns if c not in exact]
    if rest:
        ends = table.agg(*[f(c).cast("string").alias(f"{k}_{c}") for c in rest for k, f in (("lo", F.min), ("hi", F.max))]).first()
        found |= {c: (*found[c][:2], ends[f"lo_{c}"], ends[f"hi_{c}"]) for c in rest}
    rows = [(c, n, nulls, None if lo is None else str(lo), None if hi is None else str(hi)) for c, (n, nulls, lo, hi) in found.items()]
    return spark.createDataFrame(rows, "column_name string, n_rows long, n_null long, min_value string, max_value string")


def from_footers(table: DataFrame, columns: Sequence[str], bounded: Sequence[str]) -> DataFrame:
    """Counts of ``columns`` and bounds of ``bounded``, in a form that the scan of a parquet table takes over as a whole."""
    bounds = [f(c).alias(f"{k}_{c}") for c in bounded for k, f in (("lo", F.min), ("hi", F.max))]
    return table.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns], *bounds)
