"""Coercion to the target schema without failing the job: bad values become NULL and are reported."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lob import decode_binary


def coerced(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """``value`` in the target type, NULL where it cannot be converted. Empty text is NULL for non-text targets, text for a
    binary target is base64 or a data URI. What the target would cut is no value of it: a fraction for a whole number, digits for a narrower
    decimal, a time of day for a date."""
    if source == target:
        return value
    if isinstance(target, T.StringType):
        return value.cast("string")
    if isinstance(target, T.BinaryType) and isinstance(source, T.StringType):
        return decode_binary(F.nullif(F.trim(value), F.lit("")))
    if isinstance(target, T.IntegralType) and isinstance(source, (T.FractionalType, T.DecimalType)):
        whole = value.try_cast(target)
        return F.when(whole.cast(source) == value, whole)  # a fraction would be lost
    given = F.nullif(F.trim(value), F.lit("")) if isinstance(source, T.StringType) else value
    made = given.try_cast(target)
    if isinstance(target, T.DecimalType):
        # digits that the target has no place for would be lost; text is read with all its digits
        exact = given.try_cast(T.DecimalType(38, min(37, target.scale + 18))) if isinstance(source, T.StringType) else given
        return F.when(exact.isNull() | (made.cast(exact_type(source, target)) == exact), made)
    if isinstance(target, T.DateType) and not isinstance(source, T.DateType):
        # a time of day would be lost
        at = given.try_cast(T.TimestampNTZType()) if isinstance(source, T.StringType) else given
        return F.when(at.isNull() | (at == made.cast(T.TimestampNTZType() if isinstance(source, T.StringType) else source)), made)
    return made


def exact_type(source: T.DataType, target: T.DecimalType) -> T.DataType:
    """The type in which a value and what became of it are compared."""
    return T.DecimalType(38, min(37, target.scale + 18)) if isinstance(source, T.StringType) else source


def _plan(df: DataFrame, target: T.StructType):
    wanted = {f.name.lower(): f.dataType for f in target}
    for field in df.schema:
        yield field, wanted.get(field.name.lower(), field.dataType)


def columns(df: DataFrame, target: T.StructType) -> dict[str, Column]:
    """Every column that the target knows, coerced to its type; the others as they are."""
    return {f.name: coerced(F.col(f.name), f.dataType, t) for f, t in _plan(df, target)}


def to_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    return df.select(*[c.alias(name) for name, c in columns(df, target).items()])


def reject_flags(df: DataFrame, target: T.StructType) -> dict[str, Column]:
    """Per coerced column: the value was there (not NULL, not blank) but did not convert."""
    flags = {}
    for field, wanted in _plan(df, target):
        if field.dataType == wanted:
            continue
        value = F.col(field.name)
        given = value.isNotNull()
        if isinstance(field.dataType, T.StringType):
            given = given & (F.trim(value) != "")
        flags[field.name] = given & coerced(value, field.dataType, wanted).isNull()
    return flags


def any_reject(df: DataFrame, target: T.StructType) -> Column:
    return functools.reduce(operator.or_, reject_flags(df, target).values(), F.lit(False))


def split(df: DataFrame, target: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(coerced good rows, original rejected rows)."""
    bad = any_reject(df, target)
    return to_schema(df.where(~bad), target), df.where(bad)


def reject_counts(df: DataFrame, target: T.StructType) -> DataFrame:
    """One row per coerced column: how many values were rejected (a single pass)."""
    flags = reject_flags(df, target)
    sums = df.agg(*[F.count_if(flag).alias(f"r{i}") for i, flag in enumerate(flags.values())])
    pairs = [F.struct(F.lit(name).alias("column_name"), F.col(f"r{i}").alias("rejected"))
             for i, name in enumerate(flags)]
    return sums.select(F.inline(F.array(*pairs)))
