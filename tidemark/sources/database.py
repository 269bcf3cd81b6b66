"""Parallel reads of database tables through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, table: str | None = None, sql: str | None = None, fetch_size: int = 2000,
                 **extra: str) -> dict[str, str]:
    """Reader options; a SELECT text takes precedence over the table and becomes a derived table."""
    source = f"({sql.strip().rstrip('; ')}) src" if sql and sql.strip() else table
    if not source:
        raise ValueError("neither a table nor a SELECT text was given")
    return {"url": url, "dbtable": source, "fetchsize": str(fetch_size), **extra}


def read_partitioned(spark: SparkSession, options: dict[str, str], column: str, lower: Any, upper: Any,
                     partitions: int) -> DataFrame:
    """Equal-width slices of a numeric, date or timestamp column; the bounds only shape slices, no row is lost."""
    return (spark.read.format("jdbc").options(**options)
            .option("partitionColumn", column).option("lowerBound", str(lower)).option("upperBound", str(upper))
            .option("numPartitions", str(partitions)).load())


def quoted(value: Any) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def marker_slices(column: str, cuts: Sequence[Any], nulls: bool = True) -> list[str]:
    """Predicates of contiguous ``(lo, hi]`` slices cut at ``cuts``, open at both ends, rows without marker first.
    With cuts planned from the data (see ``operators.ranges``) slices are equally loaded even on a skewed marker."""
    if not cuts:
        return ["1 = 1"]
    first = f"{column} <= {quoted(cuts[0])}" + (f" OR {column} IS NULL" if nulls else "")
    inner = [f"{column} > {quoted(a)} AND {column} <= {quoted(b)}" for a, b in zip(cuts, cuts[1:])]
    return [first, *inner, f"{column} > {quoted(cuts[-1])}"]


def read_slices(spark: SparkSession, options: dict[str, str], predicates: Sequence[str]) -> DataFrame:
    """One partition per predicate."""
    url, table = options["url"], options["dbtable"]
    rest = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=rest)
