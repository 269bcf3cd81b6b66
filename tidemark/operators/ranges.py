"""Marker ranges: planning, progress watermark, checkpoints and resume windows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import predicates
from tidemark.session import staged

# Ranges per encoded checkpoint row; a long list is spread over several rows, so no row grows without bound.
RANGES_PER_CHECKPOINT = 1000

# Up to so many windows of a list are predicates of the scan.
PUSHED_WINDOWS = 16

# The largest size of a KLL sketch; its cuts are then exact to a ten-thousandth of the rows.
MAX_SKETCH = 65535

CHECKPOINT_TYPE = "struct<c:string,g:array<array<string>>>"


def plan_ranges(df: DataFrame, marker: str, rows_per_batch: int) -> DataFrame:
    """Ranges ``(lo, hi]`` of about ``rows_per_batch`` rows: batch_no, lo, hi, n_rows.

    Ties stay together, the first ``lo`` is NULL (open start), rows without marker belong to no range. A marker value that
    holds many rows is one combined count before the shuffle; its range is just larger.

    The exact running count over distinct marker values is built in two levels. Range partitioning
    samples the values, so slices are even whatever the distribution; only one total per slice is summed globally.
    The sliced counts are checkpointed because both levels must see the same slices.
    """
    counts = df.where(F.col(marker).isNotNull()).groupBy(F.col(marker).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    sliced = staged(counts.repartitionByRange("m").withColumn("slice", F.spark_partition_id()))

    # At most one row per slice (number of shuffle partitions), hence a global window is safe here.
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy("slice").agg(F.sum("n").alias("slice_rows"), F.max("m").alias("slice_max"))
    offsets = slices.select("slice", F.coalesce(F.sum("slice_rows").over(earlier), F.lit(0)).alias("before_slice"),
                            F.max("slice_max").over(earlier).alias("prev_max"))

    within = Window.partitionBy("slice").orderBy("m")
    before = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (sliced.select("slice", "m", "n", before.alias("before_m"), F.lag("m").over(within).alias("prev_m"))
              .join(F.broadcast(offsets), "slice")
              .select("m", "n", F.floor((F.col("before_slice") + F.col("before_m")) / rows_per_batch)
                      .cast("bigint").alias("batch_no"),
                      F.coalesce("prev_m", "prev_max").alias("prev_m")))
    return placed.groupBy("batch_no").agg(F.min_by("prev_m", "m").alias("lo"), F.max("m").alias("hi"),
                                          F.sum("n").alias("n_rows"))


def completed_watermark(ranges: DataFrame) -> DataFrame:
    """Up to where everything is done: the smallest start of an incomplete range, else the largest end."""
    return ranges.agg(F.count_if(~F.col("done")).alias("open_ranges"),
                      F.min(F.when(~F.col("done"), F.struct("batch_no", "lo"))).alias("_first_open"),
                      F.max("hi").alias("_end")).select(
        "open_ranges", F.when(F.col("open_ranges") > 0, F.col("_first_open.lo")).otherwise(F.col("_end"))
        .alias("completed"))


def encode_checkpoint(gaps: DataFrame, completed: Any, per_row: int = RANGES_PER_CHECKPOINT) -> DataFrame:
    """Incomplete ranges (``lo``, ``hi`` and an integer ``batch_no``) as JSON texts ``{"c": completed, "g": [[lo, hi], ...]}``,
    one per ``per_row`` consecutive batch numbers: (part, checkpoint). ``completed`` is a value or a scalar column."""
    pair = F.array(F.col("lo").cast("string"), F.col("hi").cast("string"))
    # batch numbers are unique, so a group has at most ``per_row`` elements
    parts = gaps.groupBy(F.floor(F.col("batch_no") / per_row).cast("bigint").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("batch_no", pair.alias("pair")))).alias("ordered"))
    done = (completed if isinstance(completed, Column) else F.lit(completed)).cast("string")
    body = F.struct(done.alias("c"), F.col("ordered.pair").alias("g"))
    return parts.select("part", F.to_json(body, {"ignoreNullFields": "false"}).alias("checkpoint"))


def decode_checkpoint(df: DataFrame, marker_type: T.DataType | str, column: str = "checkpoint",
                      keep: Sequence[str] = ()) -> DataFrame:
    """Typed ranges from JSON texts: completed, lo, hi (one row per range) plus the columns to ``keep``; with those, a row
    without ranges stays as one row of NULLs."""
    parsed = df.select(*keep, F.from_json(column, CHECKPOINT_TYPE).alias("p"))
    each = F.explode_outer if keep else F.explode
    pairs = parsed.select(*keep, F.col("p.c").alias("c"), each("p.g").alias("g"))
    return pairs.select(*keep, F.col("c").cast(marker_type).alias("completed"), F.col("g")[0].cast(marker_type).alias("lo"),
                        F.col("g")[1].cast(marker_type).alias("hi"))


def resume_windows(gaps: Sequence[tuple[Any, Any]], completed: Any, snapshot_end: Any = None
                   ) -> list[tuple[Any, Any]]:
    """Saved gaps, then the tail ``(completed, snapshot_end]``; sorted, overlapping windows joined. Windows that only touch stay
    apart, as each is a unit of work that can be lost."""
    windows = sorted([*gaps, (completed, snapshot_end)], key=lambda w: (w[0] is not None, w[0]))
    merged: list[tuple[Any, Any]] = []
    for lo, hi in windows:
        if merged and (merged[-1][1] is None or (lo is None) or lo < merged[-1][1]):
            last = merged[-1]
            merged[-1] = (last[0], None if last[1] is None or hi is None else max(last[1], hi))
        elif hi is None or lo is None or hi > lo:
            merged.append((lo, hi))
    return merged


def sketch_error(size: int) -> float:
    """Largest error of a rank in a sketch of this size, as a share of the rows (the published bound at 99 %)."""
    return 2.296 / size ** 0.9021


def sketch_size(parts: int) -> int:
    """A size whose error is at most a quarter of a part, as far as sketches go."""
    size = 256
    while size < MAX_SKETCH and 4 * parts * sketch_error(size) > 1:
        size *= 2
    return min(size, MAX_SKETCH)


def quantile_cuts(df: DataFrame, marker: str, parts: int) -> list[float]:
    """``parts`` - 1 ascending positions that cut the rows with a marker into parts of about equal size, from a KLL sketch.

    Each task sketches its rows, the sketches are merged: one pass over one column, nothing is shuffled but sketches. A value that
    holds many rows is many of the cuts.
    """
    place = predicates.position(F.col(marker), predicates.marker_type(df, marker))
    ranks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    place = F.when(~F.isnan(place), place)
    sketch = F.kll_sketch_agg_double(place, F.lit(sketch_size(parts)))
    if parts < 2:
        return []
    cuts = df.agg(F.when(F.count(place) > 0, F.kll_sketch_get_quantile_double(sketch, ranks)).alias("cuts")).first()["cuts"]
    return sorted(cuts or [])


def sketch_ranges(df: DataFrame, marker: str, parts: int) -> DataFrame:
    """At most ``parts`` ranges ``(lo, hi]`` of about equal size, as :func:`plan_ranges` gives them, with exact counts.

    The cuts come from a sketch and each range is then counted exactly, so distinct markers are never shuffled or sorted. A range holds
    the rows of a part give or take two errors of the sketch, except that ties stay together. ``lo`` and ``hi`` are markers of the table.
    """
    cuts = sorted(set(quantile_cuts(df, marker, parts)))
    place = predicates.position(F.col(marker), predicates.marker_type(df, marker))
    number = predicates.search(place, [F.lit(c) for c in cuts]) if cuts else F.lit(0)
    counted = df.where(F.col(marker).isNotNull()).groupBy(number.alias("number")).agg(
        F.max(marker).alias("hi"), F.count(F.lit(1)).alias("n_rows"))
    every = Window.orderBy("number")  # a row per range
    return counted.select((F.row_number().over(every) - 1).cast("bigint").alias("batch_no"), F.lag("hi").over(every).alias("lo"), "hi", "n_rows")


def window_of(df: DataFrame, marker: str, windows: DataFrame, out: str = "window", parts: int | None = None) -> DataFrame:
    """Every row of ``df`` with the window that holds its marker as a struct ``out`` (NULL: none), by a merge of both in marker order.

    ``windows`` has the columns of the windows, among them ``lo`` and ``hi`` in the marker's type: disjoint ``(lo, hi]``, NULL for an open
    end. Their number is not bounded. The marker axis is cut into slices by quantiles of the rows, with a slice of its own for each cut value; a
    window is listed in the slices it touches. In a slice rows and starts of windows are sorted together, and the window last
    started is carried forward. Slices follow the rows, so neither a far window nor a hot marker makes one slice large: a value that is
    several quantiles is dealt into as many piles. Rows without a marker pass beside the merge. A column ``out`` of ``df`` is replaced.
    """
    df = df.select(*[c for c in df.columns if c.lower() != out.lower()])
    kind = predicates.marker_type(df, marker)
    parts = parts or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = quantile_cuts(df, marker, parts)
    often = Counter(found)
    cuts = sorted(often)
    literals = [F.lit(c) for c in cuts]
    piles = F.array(*[F.lit(often[c] if i % 2 else 1) for c in cuts for i in (0, 1)], F.lit(1))

    def slot(place: Column) -> Column:
        return predicates.search(place, literals) + predicates.search(place, literals, beyond=True) if cuts else F.lit(0)

    w = windows.where(F.col("lo").isNull() | F.col("hi").isNull() | (F.col("hi") > F.col("lo")))
    w = w.select(F.struct(*windows.columns).alias("w"))
    first = F.coalesce(slot(predicates.position(F.col("w.lo"), kind)), F.lit(0))
    last = F.coalesce(slot(predicates.position(F.col("w.hi"), kind)), F.lit(2 * len(cuts)))
    starts = w.select("w", F.explode(F.sequence(F.when(F.col("w.lo").isNull(), 0).otherwise(first),
                                                F.when(F.col("w.hi").isNull(), 2 * len(cuts)).otherwise(last))).alias("slot"))
    starts = starts.select("w", "slot", F.explode(F.sequence(F.lit(0), F.get(piles, F.col("slot")) - 1)).alias("pile"))
    starts = starts.select(F.col("w.lo").alias("m"), F.lit(True).alias("starts"), "slot", "pile", "w",
                           F.lit(None).cast(T.StructType(df.schema.fields)).alias("row"))
    marked = df.where(F.col(marker).isNotNull())
    rows = marked.select(F.col(marker).alias("m"), F.lit(False).alias("starts"), slot(predicates.position(F.col(marker), kind)).alias("slot"),
                         F.struct(*df.columns).alias("row"))
    pile = F.when(F.get(piles, F.col("slot")) > 1, F.pmod(F.monotonically_increasing_id(), F.get(piles, F.col("slot"))).cast("int")).otherwise(0)
    rows = rows.select("m", "starts", "slot", pile.alias("pile"), F.lit(None).cast(w.schema["w"].dataType).alias("w"), "row")
    # a row at the start of a window comes before it, as it is not inside
    order = Window.partitionBy("slot", "pile").orderBy(F.col("m").asc_nulls_first(), "starts").rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(starts).withColumn("open", F.last("w", ignorenulls=True).over(order)).where(~F.col("starts"))
    inside = F.when(F.col("open.hi").isNull() | (F.col("m") <= F.col("open.hi")), F.col("open"))
    placed = merged.select("row.*", inside.alias(out))
    unmarked = df.where(F.col(marker).isNull()).withColumn(out, F.lit(None).cast(w.schema["w"].dataType))
    return placed.unionByName(unmarked)


def read_windows(df: DataFrame, marker: str, windows: Sequence[tuple[Any, Any]] | DataFrame) -> DataFrame:
    """Rows whose marker lies in one of the disjoint, ascending ``(lo, hi]`` windows; NULL is an open end.

    A few windows are predicates that the scan prunes by. More, or a table of windows (``lo``, ``hi``), are met by :func:`window_of`; the scan is then
    pruned by the hulls of runs of the windows, if they are given as a list.
    """
    if not isinstance(windows, DataFrame):
        if not windows:
            return df.where(F.lit(False))
        if len(windows) <= PUSHED_WINDOWS:
            return df.where(predicates.envelopes(df, marker, windows, PUSHED_WINDOWS))
        kind = predicates.marker_type(df, marker)
        table = df.sparkSession.createDataFrame([tuple(w) for w in windows], T.StructType([T.StructField("lo", kind), T.StructField("hi", kind)]))
        df, windows = df.where(predicates.envelopes(df, marker, windows)), table
    return window_of(df, marker, windows, "__window").where("__window is not null").drop("__window")


def resume_rows(df: DataFrame, marker: str, gaps: Sequence[tuple[Any, Any]], completed: Any,
                snapshot_end: Any = None, no_update: bool = False) -> DataFrame:
    """Rows a resumed run still has to read. Insert-only style tasks never resume: they read everything."""
    if no_update:
        return df
    return read_windows(df, marker, resume_windows(gaps, completed, snapshot_end))


def without_marker(df: DataFrame, marker: str, where: str | None = None) -> DataFrame:
    """First-run backfill: rows without a marker, still under the user's filter."""
    return df.where(predicates.all_of([predicates.missing(marker), where]))
