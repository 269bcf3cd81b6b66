"""Durations and epoch arithmetic that do not depend on the session time zone.

Subtracting two timestamps of the same type yields a day-time interval, so ``TIMESTAMP_NTZ`` values are
never converted through a zone.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(value: str | dt.datetime | Column) -> Column:
    """A zone-free timestamp literal (or column)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(value if isinstance(value, str) else value.isoformat(sep=" ")).cast("timestamp_ntz")


def exact_seconds(start: Column, end: Column) -> Column:
    """Elapsed seconds with microseconds, as a decimal."""
    return (end - start).cast("interval second").cast("decimal(20,6)")


def whole_seconds(start: Column, end: Column) -> Column:
    """Elapsed whole seconds, fraction dropped (for end >= start)."""
    return F.floor(exact_seconds(start, end)).cast("bigint")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Elapsed milliseconds, fraction dropped."""
    return F.floor(exact_seconds(start, end) * 1000).cast("bigint")


def shift(ts: Column, seconds: int) -> Column:
    """``ts`` moved by a number of seconds (negative = earlier)."""
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    return (exact_seconds(ntz("1970-01-01 00:00:00"), ts) * 1000000).cast("bigint")


def clock_text(ts: Column) -> Column:
    """``HH:mm:ss`` of a zone-free timestamp."""
    return F.substring(ts.cast("string"), 12, 8)
