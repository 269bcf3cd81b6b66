"""Keys of a table found from its data, and which keys a target has without reading its rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import merge
from tidemark.operators.mapping import known_columns

#: Relative standard deviation of the sketches that count distinct values, and how many of them a key may seem to lack.
SKETCH_RSD, SLACK = 0.02, 6
#: Shares of the values, by their hash, that are searched for one that comes twice, and column sets that are searched by one job.
SLICES, AT_ONCE = (1024, 32), 16


def key_discovery(df: DataFrame, max_columns: int = 2, columns: Sequence[str] | None = None) -> list[tuple[str, ...]]:
    """All minimal keys of at most ``max_columns`` columns: sets without a NULL whose values identify every row, none of which holds
    another. Decimal order of the columns.

    Level by level: the sets of a level are those that hold no key found before and whose columns have enough distinct values between them.
    A set is no key once a slice of its values holds one twice, or a sketch counts too few; what is left is counted exactly over the whole
    table, a set at a time. What reaches the driver are counts, one per set of columns. An empty table has no keys to tell.
    """
    names = list(columns or [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))])
    n, *filled = df.agg(F.count(F.lit(1)), *[F.count(c) for c in names]).first()
    names = [c for c, k in zip(names, filled) if k == n]
    if not n or not names:
        return []
    least, keys, distinct = n * (1 - SLACK * SKETCH_RSD), [], {}
    for size in range(1, max_columns + 1):
        level = [s for s in combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        if size > 1:
            level = [s for s in level if _product(distinct[c] for c in s) >= least]
            for slices in SLICES:
                level = _without_copies(df, level, slices)
        if not level:
            continue
        seen = df.agg(*[F.approx_count_distinct(_value(s), SKETCH_RSD).alias(f"c{i}") for i, s in enumerate(level)]).first()
        if size == 1:
            distinct = {s[0]: max(1, seen[i]) * (1 + SLACK * SKETCH_RSD) for i, s in enumerate(level)}
        maybe = [s for i, s in enumerate(level) if seen[i] >= least]
        if size == 1:
            for slices in SLICES:
                maybe = _without_copies(df, maybe, slices)
        for s in maybe:
            # nearly all values differ, so combining them before the shuffle would only fill memory
            if df.select(*s).repartition(*s).agg(F.count_distinct(*s)).first()[0] == n:
                keys.append(s)
    return keys


def _without_copies(df: DataFrame, sets: Sequence[tuple[str, ...]], slices: int) -> list[tuple[str, ...]]:
    """The sets of filled columns that hold no value twice among those whose hash falls into one of ``slices`` slices."""
    left = []
    for at in range(0, len(sets), AT_ONCE):
        part = sets[at:at + AT_ONCE]
        names = [c for c in df.columns if any(c in s for s in part)]
        # a value is compared in the columns of its set, not by its hash
        values = [F.when(F.pmod(F.xxhash64(*s), F.lit(slices)) == 0, F.struct(F.lit(i).alias("_set"), *[
            (F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in names])) for i, s in enumerate(part)]
        found = df.select(F.explode(F.array_compact(F.array(*values))).alias("v")).select("v.*")
        twice = found.groupBy("_set", *names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_set").distinct()
        gone = {r["_set"] for r in twice.collect()}
        left += [s for i, s in enumerate(part) if i not in gone]
    return left


def _value(columns: Sequence[str]) -> Column:
    return F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)


def _product(values) -> float:
    out = 1.0
    for v in values:
        out *= v
    return out


#: Keys that one bitmap covers, and its size in bytes: fixed by Spark's bitmap functions.
BITMAP_KEYS, BITMAP_BYTES = 32768, 4096


def key_bitmaps(df: DataFrame, key: str) -> DataFrame:
    """``number, bits`` for each stretch of 32 768 whole numbers that holds a key: a bit per number. Only the key column is read, and each
    task sends one bitmap per stretch, however many rows it has."""
    k = F.col(key)
    return df.where(k.isNotNull()).groupBy(F.bitmap_bucket_number(k).alias("number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"))


def bitmaps_pay(df: DataFrame, key: str) -> bool:
    """Whether the bitmaps of a whole-number key are smaller than the keys themselves: its numbers lie close together."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return False
    facts = df.agg(F.count(key).alias("n"), F.approx_count_distinct(F.bitmap_bucket_number(F.col(key))).alias("stretches")).first()
    return facts["stretches"] * BITMAP_BYTES <= 8 * facts["n"]


def has_bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap has the bit of a position, the lowest bit of its first byte being 0."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")), F.lit(0)) == 1


def classify_by_bitmap(target: DataFrame, source: DataFrame, key: str, bitmaps: DataFrame) -> DataFrame:
    """:func:`merge.classify` for one whole-number key, with the bitmaps of the target's keys.

    The source meets the bitmaps, a row per 32 768 keys. What they lack is new and never meets a row of the target; only the keys they
    have are compared with it. Rows of the source have different keys, as for ``classify``.
    """
    k = F.col(key)
    marks = bitmaps.select(F.col("number").alias("_number"), F.col("bits").alias("_bits"))
    met = source.join(marks, F.bitmap_bucket_number(k) == F.col("_number"), "left")
    met = met.withColumn("_there", F.col("_bits").isNotNull() & has_bit(F.col("_bits"), F.bitmap_bit_position(k))).drop("_bits", "_number")
    new = met.where(~F.col("_there")).drop("_there")
    known = merge.classify(target, met.where("_there").drop("_there"), [key])
    fresh = merge.split_null_keys(known_columns(new, target.schema), [key])[0]
    return known.unionByName(fresh.withColumn("kind", F.lit("insert")))
