"""Scans, pages, previews and key checks over any DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import staged

DEFAULT_PAGE_SIZE = 1000
PREVIEW_ROWS = 10


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_sql(spark: SparkSession, text: str, args: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """A SELECT or WITH text as a source. ``{name}`` in the text stands for a DataFrame given by keyword,
    ``:name`` for a bound parameter. Wrapping it as a derived table admits queries only."""
    body = text.strip().rstrip(";")
    return spark.sql(f"select * from ({body}) src", args=args or {}, **tables)


def resolve_source(spark: SparkSession, folder: str, table: str | None, sql: str | None = None,
                   **tables: DataFrame) -> DataFrame:
    """The SELECT text wins over the table name."""
    if sql and sql.strip():
        return read_sql(spark, sql, **tables)
    if not table:
        raise ValueError("neither a table nor a SELECT text was given")
    return read_table(spark, folder, table)


def read_columns(df: DataFrame, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.select(*columns) if columns else rows


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def with_total(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """``rows`` plus the row count of ``counted`` in every row; the count is a scalar subquery, not a join."""
    return rows.select("*", total(counted).scalar().alias("total"))


def page(df: DataFrame, order: Sequence[str], number: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1). For deep pages use :func:`page_after`, whose cost does not grow with the page number."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_after(df: DataFrame, order: Sequence[str], last: Sequence[Any] | None,
               size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The next ``size`` rows after key ``last``. The leading column is also compared on its own, which the scan
    can use to skip row groups."""
    rows = df
    if last is not None:
        types = {f.name: f.dataType for f in df.schema}
        bound = F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(order, last)])
        lead = F.col(order[0]) >= F.lit(last[0]).cast(types[order[0]])
        rows = df.where(lead & (F.struct(*order) > bound))
    return rows.orderBy(*order).limit(size)


def preview(df: DataFrame, order: Sequence[str], size: int = PREVIEW_ROWS) -> DataFrame:
    """First rows in key order with the total."""
    return with_total(df.orderBy(*order).limit(size), df)


def ordered_within(df: DataFrame, group: Column, order: Sequence[str]) -> DataFrame:
    """Every row with its position (from 1) in its group, as an ordered reader would deliver them.

    A window over the group alone would put a hot group into one task. Rows are range-partitioned by
    (group, order) instead, positions are counted per slice, and the slice sizes are added up.
    """
    ranged = staged(df.withColumn("_group", group).repartitionByRange("_group", *order)
                    .withColumn("_slice", F.spark_partition_id()))
    # one row per (slice, group): at most slices + groups rows, never per source row
    sizes = ranged.groupBy("_group", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_slice", "_group").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(within).cast("bigint"))
    return (numbered.join(offsets, ["_group", "_slice"])
            .withColumn("row_no", F.col("_row") + F.col("_before")).drop("_group", "_slice", "_row", "_before"))


def write_ordered(df: DataFrame, path: str, marker: str) -> None:
    """Write in marker order: ranges across files, sorted inside, so readers can skip by marker statistics."""
    df.repartitionByRange(marker).sortWithinPartitions(marker).write.mode("errorifexists").parquet(path)


# Type families shown to the user.
FAMILIES = {"date": "datetime", "timestamp": "datetime", "timestamp_ntz": "datetime", "string": "text",
            "binary": "binary", "boolean": "boolean"}


def family(type_name: str) -> str:
    return FAMILIES.get(type_name.split("(")[0], "number")


def column_report(df: DataFrame) -> DataFrame:
    """Columns of a table or SELECT with type family and number of values, in one pass over the data."""
    fields = list(df.schema)
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(family(f.dataType.simpleString())).alias("family"),
                     F.col(f"c{i}").alias("n_values")) for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows)))


def key_check(df: DataFrame, keys: Sequence[str], label: str | None = None) -> DataFrame:
    """Whether the columns identify rows: counted per key first, so a key holding many rows is combined before
    the shuffle."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    no_null = F.lit(True)
    for k in keys:
        no_null = no_null & F.col(k).isNotNull()
    return per_key.agg(
        F.lit(label or ",".join(keys)).alias("key_columns"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        (F.coalesce(F.max("n"), F.lit(1)) == 1).alias("is_unique"),
        F.coalesce(F.bool_and(no_null), F.lit(True)).alias("is_not_null"))


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views that SELECT texts may use."""
    return spark.sql("show tables")
