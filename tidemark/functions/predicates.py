"""Marker predicates. Bounds become typed literals on the raw column, so they reach the scan as pushed filters."""

from __future__ import annotations

import datetime as dt
import functools
import operator
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timing import epoch_micros, ntz


@dataclass(frozen=True)
class Stored:
    """A marker as it is kept in a task's state: text that Spark made with :func:`stored_text` and that Spark reads again."""
    text: str


def marker_type(df: DataFrame, marker: str) -> T.DataType:
    field = next((f for f in df.schema if f.name.lower() == marker.lower()), None)
    if field is None:
        raise ValueError(f"no column {marker!r}; have {df.columns}")
    return field.dataType


def stored_text(value: Column, kind: T.DataType) -> Column:
    """The text of a marker. A point in time is its microseconds, so neither session nor driver zone can shift it."""
    return (F.unix_micros(value) if isinstance(kind, T.TimestampType) else value).cast("string")


def typed(df: DataFrame, marker: str, value: Any) -> Column:
    """``value`` as a literal of the marker's own type: no string comparison, no lost precision."""
    kind = marker_type(df, marker)
    if isinstance(value, Stored):
        if isinstance(kind, T.TimestampType) and re.fullmatch(r"-?\d+", value.text):
            return F.timestamp_micros(F.lit(int(value.text)))
        return F.lit(value.text).cast(kind)
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, dt.datetime) and value.tzinfo is None:
        return ntz(value)  # lit() would make it an instant of the driver's zone
    return F.lit(value).cast(kind)


def after(df: DataFrame, marker: str, value: Any) -> Column:
    return F.col(marker) > typed(df, marker, value)


def up_to(df: DataFrame, marker: str, value: Any) -> Column:
    return F.col(marker) <= typed(df, marker, value)


def missing(marker: str) -> Column:
    return F.col(marker).isNull()


def marker_range(df: DataFrame, marker: str, lo: Any = None, hi: Any = None) -> Column:
    """``(lo, hi]``. An open start also takes rows without a marker; no bound at all means only those rows."""
    if lo is not None and hi is not None:
        return after(df, marker, lo) & up_to(df, marker, hi)
    if hi is not None:
        return missing(marker) | up_to(df, marker, hi)
    if lo is not None:
        return after(df, marker, lo)
    return missing(marker)


def all_of(parts: Iterable[Column | str | None]) -> Column:
    """AND of predicates; strings are user SQL fragments, blanks are skipped, nothing means true."""
    columns = [F.expr(f"({p})") if isinstance(p, str) else p
               for p in parts if p is not None and not (isinstance(p, str) and not p.strip())]
    return functools.reduce(operator.and_, columns) if columns else F.lit(True)


def incremental(df: DataFrame, marker: str | None, last_value: Any = None, where: str | None = None) -> Column:
    """Rows beyond the stored marker AND the user fragment. Without a marker or on a first run the range is open."""
    beyond = after(df, marker, last_value) if marker and last_value is not None else None
    return all_of([beyond, where])


def position(value: Column, kind: T.DataType) -> Column:
    """A number that never falls where the marker rises. It finds bins, the exact comparison is made in the marker's type."""
    if isinstance(kind, T.StringType):
        return F.conv(F.hex(F.substring(F.rpad(value.cast("binary"), 6, F.lit(b"\0")), 1, 6)), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        # from the wall clock alone: a zone would move the hours around its changes
        return epoch_micros(value).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("double")
    return value.cast("double")


def envelopes(df: DataFrame, marker: str, windows: Sequence[tuple[Any, Any]], groups: int = 16) -> Column:
    """What the scan can prune by: the hulls of at most ``groups`` runs of the ascending windows ``(lo, hi]``."""
    size = -(-len(windows) // groups)
    hulls = [(windows[i][0], windows[min(i + size, len(windows)) - 1][1]) for i in range(0, len(windows), size)]
    parts = [all_of([after(df, marker, lo) if lo is not None else None, up_to(df, marker, hi) if hi is not None else None,
                     F.col(marker).isNotNull()]) for lo, hi in hulls]
    return functools.reduce(operator.or_, parts)


def search(value: Column, cuts: Sequence[Column], beyond: bool = False) -> Column:
    """How many of the ascending ``cuts`` lie below ``value``; ``beyond`` also counts those equal to it.

    A binary search whose steps are a lambda over a constant array, so the plan is not nested by the number of cuts, and ``value`` is
    computed once. There is at least one cut.
    """
    table, n = F.array(*cuts), len(cuts)
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])

    def place(v: Column) -> Column:
        def step(at: Column, by: Column) -> Column:
            cut = F.get(table, at + by - 1)  # NULL past the last one
            return F.when((cut <= v) if beyond else (cut < v), at + by).otherwise(at)

        return F.reduce(steps, F.lit(0), step)

    return F.transform(F.array(value), place)[0]


def range_number(df: DataFrame, marker: str, cuts: Sequence[Any]) -> Column:
    """Number of the range holding ``marker``: 0 up to and including ``cuts[0]``, then 1, ...; NULL marker, NULL number."""
    if not cuts:
        return F.when(F.col(marker).isNotNull(), F.lit(0))
    return F.when(F.col(marker).isNotNull(), search(F.col(marker), [typed(df, marker, c) for c in cuts]))
