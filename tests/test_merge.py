import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import merge, sizing
from tidemark.spec import SyncMode

KEY = ["o_orderkey"]


@pytest.mark.parametrize("small", [True, False])
def test_merging_twice_changes_nothing(tables, small):
    once = merge.upsert(tables.orders_tgt, tables.orders_src, KEY, small)
    twice = merge.upsert(once, tables.orders_src, KEY, small)
    assert rows(once) == rows(twice)


def test_both_forms_agree(tables):
    t, s = tables.orders_tgt, tables.orders_src
    assert rows(merge.upsert(t, s, KEY, True)) == rows(merge.upsert(t, s, KEY, False))
    assert rows(merge.insert_absent(t, s, KEY, True)) == rows(merge.insert_absent(t, s, KEY, False))
    assert rows(merge.classify(t, s, KEY, True)) == rows(merge.classify(t, s, KEY, False))


def test_counts_add_up_to_the_source_keys(tables):
    t, s = tables.orders_tgt, tables.orders_src
    counts = {r["kind"]: r["n_rows"] for r in merge.change_counts(t, s, KEY).collect()}
    assert sum(counts.values()) == s.select(*KEY).distinct().count()
    assert merge.upsert(t, s, KEY).count() == t.count() + counts["insert"]
    assert set(counts) == {"insert", "update", "unchanged"}


def test_last_wins_with_a_hot_key(spark):
    """A key holding most rows keeps exactly its last one; a NULL marker ranks lowest."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
                                  F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).alias("m"), "id")
    got = {r["k"]: r["id"] for r in merge.last_wins(df, ["k"], ["m", "id"]).collect()}
    want = {}
    for i in range(9000):
        k = -1 if i % 3 == 0 else i
        rank = (i % 7 != 0, i)
        if k not in want or rank > want[k][0]:
            want[k] = (rank, i)
    assert got == {k: v[1] for k, v in want.items()}


def test_null_values_compare_as_equal(spark):
    t = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k int, v string")
    s = spark.createDataFrame([(1, None), (2, None), (3, "b"), (4, "c")], "k int, v string")
    for small in (True, False):
        assert rows(merge.classify(t, s, ["k"], small), "k", "kind") == [(1, "unchanged"), (2, "update"), (3, "update"), (4, "insert")]
    assert rows(merge.upsert(t, s, ["k"])) == [(1, None), (2, None), (3, "b"), (4, "c")]


def test_rows_without_a_key_are_rejected(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    s = spark.createDataFrame([(None, "x"), (2, "y")], "k int, v string")
    good, bad = merge.split_null_keys(s, ["k"])
    assert rows(good) == [(2, "y")] and rows(bad) == [(None, "x")]
    for small in (True, False):
        assert rows(merge.upsert(t, s, ["k"], small)) == [(1, "a"), (2, "y")]


def test_names_match_without_case_and_unknown_columns_are_dropped(spark):
    t = spark.createDataFrame([(1, "a", 5)], "K int, V string, kept int")
    s = spark.createDataFrame([(1, "b", 9.0), (2, "c", 9.0)], "k int, v string, extra double")
    out = merge.upsert(t, s, ["K"])
    assert out.columns == ["K", "V", "kept"]
    assert rows(out) == [(1, "b", 5), (2, "c", None)]


@pytest.mark.parametrize("small", [True, False])
def test_applying_classified_rows_equals_the_merge(tables, small):
    t, s = tables.orders_tgt, tables.orders_src
    changes = merge.classify(t, s, KEY, small)
    assert rows(merge.apply_classified(t, changes, KEY, small)) == rows(merge.upsert(t, s, KEY))
    assert rows(merge.apply_classified(t, changes, KEY, small, no_update=True)) == rows(merge.insert_absent(t, s, KEY))


def test_later_batch_wins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    b = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert rows(merge.union_batches([a, b], ["k"])) == [(1, "a"), (2, "b"), (3, "b")]


def test_modes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    s = spark.createDataFrame([(2, "b"), (3, "b")], "k int, v string")
    assert rows(merge.apply_mode(t, s, ["k"], 99)) == [(1, "a"), (2, "b"), (3, "b")]
    assert rows(merge.apply_mode(t, s, ["k"], SyncMode.INSERT_ONLY)) == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]
    assert rows(merge.apply_mode(t, s, ["k"], SyncMode.CLEAN_INSERT)) == [(2, "b"), (3, "b")]
    assert rows(merge.apply_mode(t, s, ["k"], SyncMode.MERGE, no_update=True)) == [(1, "a"), (2, "a"), (3, "b")]


def test_rows_given_by_a_caller_may_repeat_a_key(spark):
    t = spark.createDataFrame([(1, 1, "a")], "k int, m int, v string")
    s = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 1, "z"), (2, 1, "zz"), (None, 1, "n")], "k int, m int, v string")
    assert rows(merge.apply_mode(t, s, ["k"], order=["m", "v"])) == [(1, 7, "y"), (2, 1, "zz")]
    assert rows(merge.apply_mode(t, s, ["k"])) == [(1, 7, "y"), (2, 1, "zz")]


def test_the_target_of_a_small_merge_is_not_shuffled(tables):
    out = merge.upsert(tables.orders_tgt, tables.orders_src, KEY, True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # only the keys that both sides have are shuffled, after a broadcast join has found them
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_size_is_counted(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    assert 1000 * 100 <= sizing.counted_bytes(df) <= 1000 * 200
    assert sizing.is_small(df) and not sizing.is_small(df, 1000)
    assert sizing.counted_bytes(df.where("id < 0")) == 0
