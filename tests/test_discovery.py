import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from tidemark.operators import discovery, merge, profile
from tidemark.sources import ranged


def plain_keys(data, columns, most):
    keys = []
    for size in range(1, most + 1):
        for s in combinations(range(len(columns)), size):
            values = [tuple(r[i] for i in s) for r in data]
            if data and not any(set(k) <= set(s) for k in keys) and len(set(values)) == len(data) and all(None not in v for v in values):
                keys.append(s)
    return [tuple(columns[i] for i in k) for k in keys]


def test_keys_are_those_of_a_search_over_all_sets(spark):
    rng = random.Random(4)
    columns = ["a", "b", "c", "d", "e"]
    data = [(i // 20, i % 20, rng.randrange(3), None if i == 7 else i, f"x{rng.randrange(40)}") for i in range(400)]
    df = spark.createDataFrame(data, "a int, b int, c int, d int, e string")
    for most in (1, 2, 3):
        assert discovery.key_discovery(df, most) == plain_keys(data, columns, most)
    whole = df.where("d is not null")
    assert discovery.key_discovery(whole, 3) == plain_keys([r for r in data if r[3] is not None], columns, 3)
    assert discovery.key_discovery(df.where("false"), 2) == [] and discovery.key_discovery(df.unionByName(df), 3) == []


def test_sets_that_cannot_be_keys_are_not_counted(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 2).alias("two"), (F.col("id") % 3).alias("three"), (F.col("id") % 7).alias("seven"))
    counted, real = [], F.count_distinct
    monkeypatch.setattr(discovery.F, "count_distinct", lambda *c: counted.append(c) or real(*c))
    assert discovery.key_discovery(df, 3) == [("k",)] and counted == [("k",)]


def test_sets_with_few_copies_are_ruled_out_before_they_are_counted(spark, monkeypatch):
    n = 20_000
    df = spark.range(n).select((F.col("id") % 200).alias("a"), F.expr("cast(id / 200 as int) % 95").alias("b"), F.expr("cast(id / 200 as int)").alias("c"))
    counted, real = [], F.count_distinct
    monkeypatch.setattr(discovery.F, "count_distinct", lambda *c: counted.append(c) or real(*c))
    # (a, b) has copies of one row in twenty, which a sketch cannot tell
    assert discovery.key_discovery(df, 2) == [("a", "c")] and counted == [("a", "c")]


def test_a_slice_compares_values_of_any_type(spark):
    df = spark.createDataFrame([(1, "x", 0.0, b"a"), (1, "y", -0.0, b"a"), (2, "x", float("nan"), b"b"), (2, "z", float("nan"), b"c")], "a int, s string, d double, b binary")
    sets = [("a",), ("s",), ("d",), ("b",), ("a", "s"), ("a", "d"), ("s", "b")]
    assert discovery._without_copies(df, sets, 1) == [("a", "s"), ("s", "b")]


def test_bitmaps_tell_which_keys_are_there(spark):
    keys = [0, 1, 7, 8, 32767, 32768, 40000, -1, -32768, -32769, 10 ** 12]
    target = spark.createDataFrame([(k, "a") for k in keys], "k long, v string")
    source = spark.createDataFrame([(k + d, "a" if k % 2 else "b") for k in keys for d in (0, 2) if d == 0 or k + d not in keys] + [(None, "x")], "k long, v string")
    bits = discovery.key_bitmaps(target, "k")
    got = discovery.classify_by_bitmap(target, source, "k", bits)
    assert rows(got) == rows(merge.classify(target, source, ["k"]))
    assert discovery.classify_by_bitmap(target.where("false"), source, "k", discovery.key_bitmaps(target.where("false"), "k")).where("kind <> 'insert'").count() == 0
    assert discovery.bitmaps_pay(spark.range(100_000), "id") and not discovery.bitmaps_pay(spark.range(0, 10 ** 12, 10 ** 10), "id")
    assert not discovery.bitmaps_pay(target, "v")


def test_counts_and_bounds_come_from_the_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id").cast("int")).alias("n"), F.concat(F.lit("x" * 100), "id").alias("s"),
                                  F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    df.repartition(3).write.parquet(path)
    got = {r[0]: tuple(r)[1:] for r in profile.footer_profile(spark, path, ["id", "n", "s", "d"]).collect()}
    assert got == {"id": (1000, 0, "0", "999"), "n": (1000, 100, "1", "999"), "s": (1000, 0, "x" * 100 + "0", "x" * 100 + "999"),
                   "d": (1000, 0, "2024-01-01", "2026-09-26")}
    other = spark.newSession()
    other.conf.set("spark.sql.sources.useV1SourceList", "")
    other.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = profile.from_footers(other.read.parquet(path), ["id", "s"], ["id", "d"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)" in plan and "MIN(d)" in plan and "ReadSchema: struct<count(*)" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


@pytest.mark.parametrize("marker", ["event_id", "ts"])
def test_a_filter_skips_ranges(spark, tables, marker):
    path = f"{SMALL}/events.parquet"
    df = ranged.read_by_ranges(spark, path, marker, 6)
    assert rows(df) == rows(tables.events)
    # ranges, what lies behind the last, rows without a marker
    assert df.rdd.getNumPartitions() == 8
    low, middle = tables.events.agg(F.min(marker), F.percentile_approx(marker, 0.5) if marker == "event_id" else F.min(marker)).first()
    for test, most in ((F.col(marker) <= low, 1), (F.col(marker) < low, 1), (F.col(marker) == low, 1), (F.col(marker).isNull(), 1), (F.col(marker) > low, 7)):
        part = df.where(test)
        assert part.rdd.getNumPartitions() <= most and rows(part) == rows(tables.events.where(test))
    assert rows(df.select("event_type", marker).where(F.col(marker) > middle)) == rows(tables.events.select("event_type", marker).where(F.col(marker) > middle))


def test_rows_without_a_marker_have_a_range(spark, tables, tmp_path):
    path = str(tmp_path / "t")
    rows_in = tables.events.withColumn("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id")))
    rows_in.write.parquet(path)
    df = ranged.read_by_ranges(spark, path, "event_id", 3)
    assert rows(df) == rows(rows_in) and df.where("event_id is null").rdd.getNumPartitions() == 1
    assert ranged.read_by_ranges(spark, path, "event_id", 1).count() == rows_in.count()
