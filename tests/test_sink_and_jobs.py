import datetime as dt
import json
import threading
import time
import uuid
from pathlib import Path

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import rows, ts
from tidemark.operators import merge, runlog
from tidemark.plans import job
from tidemark.plans.state import Claim, StateTable, TaskBusy
from tidemark.sinks.files import SmallFiles
from tidemark.sinks.versioned import ConcurrentChange, VersionedTable
from tidemark.spec import MappedField, SyncMode, SyncSpec

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("m", T.LongType()), T.StructField("v", T.StringType())])
NOW = ts("2024-01-15 12:00:00")


@pytest.fixture
def where(tmp_path):
    return lambda name: str(tmp_path / name)


def frame(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def table_of(spark, path, buckets=4):
    return VersionedTable(spark, path, SCHEMA, ["k"], buckets)


def changed(table, version):
    """How each folder that a version brings lies in it."""
    old = {p for paths in table.manifest(version - 1)["folders"].values() for p in paths}
    return [p.split("_how=")[1].split("/")[0] for paths in table.manifest(version)["folders"].values() for p in paths if p not in old]


# ---- versioned table

def test_versions_replace_rewrite_and_add(spark, where):
    t = table_of(spark, where("t"))
    assert t.read().count() == 0 and t.current() == 0
    t.write(spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("m"), F.lit("a").alias("v")))
    assert t.current() == 1 and t.read().count() == 100
    change = frame(spark, [(5, 500, "b")])
    touched = t.touched(change)
    assert len(touched) == 1
    other = [k for k in range(1000, 1100) if t.touched(frame(spark, [(k, 0, "")])) != touched][:1]
    t.change(merge.upsert(t.read(touched), change, ["k"]), frame(spark, [(other[0], 1, "new")]))
    assert t.read().count() == 101 and t.current() == 2
    assert [r["v"] for r in t.read().where("k = 5").collect()] == ["b"]
    assert [r["v"] for r in t.read(version=1).where("k = 5").collect()] == ["a"]
    # only the touched bucket was rewritten, the new row lies beside its bucket
    first, second = t.manifest(1)["folders"], t.manifest(2)["folders"]
    new = [p for paths in second.values() for p in paths if p not in {q for qs in first.values() for q in qs}]
    assert sorted(p.split("/", 1)[1] for p in new)[1] == f"_how=replace/_bucket={touched[0]}" and len(new) == 2
    before = rows(t.read())
    t.compact()
    assert t.current() == 3 and rows(t.read()) == before and max(map(len, t.manifest()["folders"].values())) == 1
    t.write(change.limit(0))
    assert t.read().count() == 0 and t.current() == 4


def test_an_uncommitted_version_is_invisible(spark, where):
    t = table_of(spark, where("t"))
    t.write(frame(spark, [(1, 1, "a")]))
    broken = frame(spark, [(1, 1, "a")]).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        t.write(broken)
    assert t.current() == 1 and rows(t.read()) == [(1, 1, "a")]
    t.write(frame(spark, [(2, 2, "b")]))
    assert t.current() == 2 and rows(t.read()) == [(2, 2, "b")]


def test_a_key_keeps_its_bucket_for_any_integer_type(spark, where):
    t = table_of(spark, where("t"), 16)
    as_int = frame(spark, [(i, i, "") for i in range(50)]).withColumn("k", F.col("k").cast("int"))
    assert t.touched(as_int) == t.touched(as_int.withColumn("k", F.col("k").cast("bigint")))


# ---- jobs

class Bench:
    """A source, a target and the state of one task."""

    def __init__(self, spark, where, **spec):
        self.spark = spark
        self.table = table_of(spark, where("target"))
        self.state = StateTable(spark, where("state"))
        self.log = where("log")
        self.spec = SyncSpec("task", **{"keys": ("k",), "marker": "m", **spec})

    def run(self, source, **kw):
        return job.run_sync(source, self.table, self.spec, self.state, NOW, self.log, **kw)

    def latest(self):
        return self.state.latest("task")


def test_incremental_runs_follow_the_marker(spark, where):
    b = Bench(spark, where)
    first = b.run(frame(spark, [(1, 10, "a"), (2, 20, "a"), (2, 15, "old"), (3, None, "n"), (4, 10, "a")]))
    assert (first.read, first.inserted, first.updated) == (4, 4, 0)
    assert rows(b.table.read()) == [(1, 10, "a"), (2, 20, "a"), (3, None, "n"), (4, 10, "a")]
    assert b.latest().last_marker == "20" and not b.latest().resuming
    # the row at the stored marker and the one before are not read again
    second = b.run(frame(spark, [(1, 10, "late"), (2, 20, "late"), (1, 30, "b"), (5, 21, "b"), (6, None, "late")]))
    assert (second.inserted, second.updated, second.unchanged) == (1, 1, 0)
    assert rows(b.table.read()) == [(1, 30, "b"), (2, 20, "a"), (3, None, "n"), (4, 10, "a"), (5, 21, "b")]
    third = b.run(frame(spark, [(1, 30, "b")]))
    assert third.read == 0 and b.latest().last_marker == "30" and b.table.current() == 3
    log = job.read_run_log(spark, b.log).collect()
    assert len(log) == 3 and all(r["status"] == 2 and r["end_time"] is not None for r in log)
    assert sorted(r["insert_count"] for r in log) == [0, 1, 4]


def test_all_markers_null_copies_everything(spark, where):
    b = Bench(spark, where)
    b.run(frame(spark, [(1, None, "a"), (2, None, "b")]))
    assert rows(b.table.read()) == [(1, None, "a"), (2, None, "b")]


def test_any_split_of_the_marker_axis_gives_the_same_table(spark, where, tables):
    source = tables.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("m"),
                                  F.col("o_orderstatus").alias("v"))
    for parts in (1, 3):
        b = Bench(spark, lambda name, p=parts: where(f"{p}/{name}"))
        result = b.run(source, parts=parts)
        assert result.inserted == source.count() and result.open_ranges == 0
        assert rows(b.table.read()) == rows(source)


def test_a_failed_run_resumes_with_its_open_windows(spark, where, monkeypatch):
    source = spark.range(1, 101).select(F.col("id").alias("k"), F.col("id").alias("m"), F.lit("a").alias("v"))
    b = Bench(spark, where)
    calls, real = [], job.write_changes

    def failing(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("target gone " + "x" * 3000)
        return real(*args)
    monkeypatch.setattr(job, "write_changes", failing)
    with pytest.raises(RuntimeError):
        b.run(source, parts=5)
    saved = b.latest()
    assert saved.resuming and saved.run_status == "failed" and saved.last_marker is None
    assert saved.gaps == (("40", "60"), ("60", "80"), ("80", "100")) and saved.completed == "100"
    assert b.table.read().count() == 40
    failed = job.read_run_log(spark, b.log).where("status = 3").first()
    assert failed["error_msg"].startswith("target gone") and len(failed["error_msg"]) == 3012
    monkeypatch.setattr(job, "write_changes", real)
    more = source.union(frame(spark, [(500, 150, "new"), (1, 5, "not read again")]))
    result = b.run(more)
    assert result.read == 61
    assert rows(b.table.read().select("k")) == rows(source.select("k").union(frame(spark, [(500, 1, "")]).select("k")))
    assert b.latest().last_marker == "150" and not b.latest().resuming


def test_pause_keeps_the_checkpoint_and_stop_clears_it(spark, where):
    source = spark.range(1, 41).select(F.col("id").alias("k"), F.col("id").alias("m"), F.lit("a").alias("v"))
    b = Bench(spark, where)
    asked = []

    def pause():
        asked.append(1)
        return len(asked) > 2
    seen = []
    paused = b.run(source, parts=4, should_stop=pause, on_progress=seen.append)
    assert [(p.read, p.total) for p in seen] == [(10, 40), (20, 40)]
    assert (paused.status, paused.open_ranges, paused.read) == ("paused", 2, 20)
    assert b.latest().gaps == (("20", "30"), ("30", "40"))
    again = b.run(source)
    assert again.read == 20 and b.table.read().count() == 40
    b.run(source.withColumn("m", F.col("m") + 100), parts=4, should_stop=lambda: True)
    assert b.latest().resuming
    b.state.stop("task", NOW)
    assert not b.latest().resuming and b.latest().last_marker == "40"
    b.state.override_marker("task", NOW, 30)
    assert b.run(source).read == 10


def test_modes_of_a_run(spark, where):
    first, second = frame(spark, [(1, 1, "a"), (2, 2, "a")]), frame(spark, [(2, 3, "b"), (3, 3, "b")])

    def both(name, **spec):
        b = Bench(spark, lambda n: where(f"{name}/{n}"), **spec)
        b.run(first)
        return b, b.run(second)
    b, r = both("insert", mode=SyncMode.INSERT_ONLY)
    assert rows(b.table.read()) == [(1, 1, "a"), (2, 2, "a"), (2, 3, "b"), (3, 3, "b")] and r.inserted == 2
    b, r = both("clean", mode=SyncMode.CLEAN_INSERT)
    assert rows(b.table.read()) == [(2, 3, "b"), (3, 3, "b")]
    b, r = both("absent", no_update=True)
    assert rows(b.table.read()) == [(1, 1, "a"), (2, 2, "a"), (3, 3, "b")]
    assert (r.inserted, r.updated, r.unchanged) == (1, 0, 1)
    b, r = both("full", marker=None)
    assert rows(b.table.read()) == [(1, 1, "a"), (2, 3, "b"), (3, 3, "b")]


def test_an_insert_run_whose_state_was_lost_is_not_repeated(spark, where, monkeypatch):
    b = Bench(spark, where, mode=SyncMode.INSERT_ONLY)
    source = frame(spark, [(1, 1, "a"), (2, 2, "a")])
    real = StateTable.save

    def crash(self, task_id, now, run_status, *args, **kw):
        if run_status == "stopped":
            raise SystemExit("driver lost")
        return real(self, task_id, now, run_status, *args, **kw)
    monkeypatch.setattr(StateTable, "save", crash)
    with pytest.raises(SystemExit):
        b.run(source)
    monkeypatch.setattr(StateTable, "save", real)
    result = b.run(source.union(frame(spark, [(3, 3, "a")])))
    assert result.inserted == 1 and rows(b.table.read()) == [(1, 1, "a"), (2, 2, "a"), (3, 3, "a")]


def test_mapping_coercion_and_rejects(spark, where):
    source = spark.createDataFrame([("1", "10", "a", 0), ("x", "11", "bad key", 0), ("", "12", "blank key", 0),
                                    ("2", "bad", "bad marker", 0), ("3", "13", None, 0)],
                                   "id_txt string, mark_txt string, val string, extra int")
    spec = SyncSpec("task", mapping=(MappedField("ID_TXT", "k", True), MappedField("mark_txt", "m"),
                                     MappedField("val", "v")))
    table = table_of(spark, where("t"))
    result = job.run_sync(source, table, spec, StateTable(spark, where("s")), NOW)
    assert rows(table.read()) == [(1, 10, "a"), (3, 13, None)]
    assert (result.read, result.rejected) == (2, 3)


def test_the_marker_may_have_another_name_in_the_target(spark, where):
    spec = SyncSpec("task", keys=("k",), marker="changed", mapping=(MappedField("k", "k"), MappedField("changed", "m"),
                                                                    MappedField("v", "v")))
    table, state = table_of(spark, where("t")), StateTable(spark, where("s"))
    source = frame(spark, [(1, 5, "a"), (1, 7, "b")]).withColumnRenamed("m", "changed")
    job.run_sync(source, table, spec, state, NOW, parts=2)
    assert rows(table.read()) == [(1, 7, "b")] and state.latest("task").last_marker == "7"


def test_timestamp_markers_survive_the_state(spark, where):
    schema = T.StructType.fromDDL("k bigint, m timestamp_ntz")
    table = VersionedTable(spark, where("t"), schema, ["k"], 2)
    state, spec = StateTable(spark, where("s")), SyncSpec("task", keys=("k",), marker="m")
    at = dt.datetime(2024, 1, 1, 0, 0, 0, 500001)
    job.run_sync(spark.createDataFrame([(1, at)], schema), table, spec, state, NOW)
    later = [(1, at), (2, at + dt.timedelta(microseconds=1))]
    assert job.run_sync(spark.createDataFrame(later, schema), table, spec, state, NOW).read == 1
    assert table.read().count() == 2


def test_shared_folder_is_the_one_of_the_session(spark):
    from tidemark.session import scratch_path, shared_dir
    assert scratch_path(spark, uuid.uuid4().hex).startswith(shared_dir(spark))


def test_the_marker_orders_rows_even_if_it_is_not_copied(spark, where):
    schema = T.StructType([SCHEMA["k"], SCHEMA["v"]])
    table = VersionedTable(spark, where("t"), schema, ["k"], 2)
    source = frame(spark, [(1, 9, "last"), (1, 3, "first"), (2, None, "none")])
    job.run_sync(source, table, SyncSpec("task", keys=("k",), marker="m"), StateTable(spark, where("s")), NOW)
    assert rows(table.read()) == [(1, "last"), (2, "none")]
    mapped = SyncSpec("other", keys=("k",), marker="m", mapping=(MappedField("K", "k"), MappedField("V", "v")))
    job.run_sync(source, table, mapped, StateTable(spark, where("s")), NOW)
    assert rows(table.read()) == [(1, "last"), (2, "none")]


def test_many_rows_without_a_key_are_counted_not_merged(spark, where):
    source = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.col("id").alias("m"),
                                      F.lit("a").alias("v"))
    table = table_of(spark, where("t"))
    result = job.run_sync(source, table, SyncSpec("task", keys=("k",), marker="m"), StateTable(spark, where("s")), NOW)
    assert (result.rejected, result.inserted, table.read().count()) == (2000, 1000, 1000)


def test_unchanged_rows_rewrite_nothing(spark, where):
    source = frame(spark, [(i, i, "a") for i in range(40)])
    table, spec = table_of(spark, where("t"), 8), SyncSpec("task", keys=("k",))
    state = StateTable(spark, where("s"))
    job.run_sync(source, table, spec, state, NOW)
    result = job.run_sync(source, table, spec, state, NOW)
    assert result.unchanged == 40 and table.current() == 1
    one = source.withColumn("v", F.when(F.col("k") == 7, "b").otherwise("a"))
    assert job.run_sync(one, table, spec, state, NOW).updated == 1
    assert changed(table, 2) == ["replace"]
    more = one.union(frame(spark, [(i, i, "new") for i in range(100, 140)]))
    result = job.run_sync(more, table, spec, state, NOW)
    assert (result.inserted, result.updated, result.unchanged) == (40, 0, 40)
    assert set(changed(table, 3)) == {"add"} and rows(table.read()) == rows(more)


def test_reopening_keeps_the_buckets_and_checks_the_keys(spark, where):
    t = table_of(spark, where("t"), 4)
    t.write(frame(spark, [(i, i, "a") for i in range(100)]))
    again = table_of(spark, where("t"), 7)
    assert again.buckets == 4
    job.run_sync(frame(spark, [(i, 200, "b") for i in (3, 50, 99)]), again, SyncSpec("task", keys=("k",)), StateTable(spark, where("s")), NOW)
    assert again.read().count() == 100 and again.read().where("v = 'b'").count() == 3
    with pytest.raises(ValueError):
        VersionedTable(spark, where("t"), SCHEMA, ["m"], 4)


def test_the_second_of_two_writers_fails(spark, where):
    one, two = table_of(spark, where("t")), table_of(spark, where("t"))
    one.write(frame(spark, [(1, 1, "a")]))
    base = two.current()
    one.change(None, frame(spark, [(2, 2, "one")]))
    with pytest.raises(ConcurrentChange):
        two.change(None, frame(spark, [(2, 2, "two")]), base=base)
    assert rows(two.read()) == [(1, 1, "a"), (2, 2, "one")]


def test_compaction_and_expiry_keep_the_rows(spark, where):
    t = table_of(spark, where("t"))
    for i in range(4):
        t.change(None, frame(spark, [(k, i, "x") for k in range(10)]))
    before = rows(t.read())
    assert t.compact() == 5 and max(len(p) for p in t.manifest()["folders"].values()) == 1
    assert t.expire(1, 3600) == 0 and t.versions() == [5] and t.expire(1, -60) == 4 and rows(t.read()) == before


def test_a_merge_into_a_target_with_repeated_keys_multiplies_nothing(spark, where):
    b = Bench(spark, where, mode=SyncMode.INSERT_ONLY)
    b.run(frame(spark, [(1, 1, "a")]))
    b.run(frame(spark, [(1, 2, "b")]))
    result = job.run_sync(frame(spark, [(1, 3, "c")]), b.table, SyncSpec("other", keys=("k",)), b.state, NOW)
    assert result.updated == 1 and rows(b.table.read()) == [(1, 3, "c"), (1, 3, "c")]
    target = frame(spark, [(1, 1, "a"), (1, 1, "b"), (2, 2, "x")])
    for small in (True, False):
        kinds = merge.classify(target, frame(spark, [(1, 1, "a"), (2, 2, "x"), (3, 3, "n")]), ["k"], small)
        assert rows(kinds.select("k", "kind")) == [(1, "update"), (2, "unchanged"), (3, "insert")]
        assert rows(merge.upsert(target, frame(spark, [(1, 9, "z"), (3, 3, "n")]), ["k"], small)) == [
            (1, 9, "z"), (1, 9, "z"), (2, 2, "x"), (3, 3, "n")]


@pytest.mark.parametrize("parts", [1, 3])
def test_instants_do_not_depend_on_the_zone_of_the_driver(spark, where, monkeypatch, parts):
    import time
    monkeypatch.setenv("TZ", "Asia/Shanghai")
    time.tzset()
    try:
        source = spark.sql("select id as k, timestamp_seconds(1700000000 + id * 3600) as m from range(20)")
        table = VersionedTable(spark, where("t"), source.schema, ["k"], 2)
        state, spec = StateTable(spark, where("s")), SyncSpec("task", keys=("k",), marker="m")
        job.run_sync(source.where("k < 10"), table, spec, state, NOW, parts=parts)
        assert state.latest("task").last_marker == str((1700000000 + 9 * 3600) * 1_000_000)
        assert job.run_sync(source, table, spec, state, NOW, parts=parts).read == 10 and table.read().count() == 20
    finally:
        monkeypatch.undo()
        time.tzset()


def test_rows_without_a_marker_come_back_after_a_failure(spark, where, monkeypatch):
    b = Bench(spark, where)
    source = frame(spark, [(i, i if i <= 40 else None, "a") for i in range(1, 51)])
    real = job.write_changes
    monkeypatch.setattr(job, "write_changes", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
    with pytest.raises(RuntimeError):
        b.run(source)
    monkeypatch.setattr(job, "write_changes", real)
    assert b.latest().gaps == ((None, None), (None, "40"))
    assert b.run(source).read == 50 and b.table.read().count() == 50
    assert b.run(source).read == 0


def test_inserts_without_any_marker_happen_once(spark, where):
    b = Bench(spark, where, mode=SyncMode.INSERT_ONLY)
    source = frame(spark, [(i, None, "a") for i in range(10)])
    assert [b.run(source).inserted for _ in range(2)] == [10, 0]
    assert b.run(source.union(frame(spark, [(77, 5, "b")]))).inserted == 1 and b.table.read().count() == 11


def test_a_killed_run_goes_on_with_the_next_window(spark, where):
    source = spark.range(1, 101).select(F.col("id").alias("k"), F.col("id").alias("m"), F.lit("a").alias("v"))
    b = Bench(spark, where)

    def killed(result):
        if result.read == 40:
            raise SystemExit("driver lost")
    seen = []
    with pytest.raises(SystemExit):
        b.run(source, parts=5, on_progress=lambda r: (seen.append(r.read), killed(r)))
    assert b.latest().run_status == "running" and len(b.latest().gaps) == 4
    log = job.read_run_log(spark, b.log)
    assert [(r["status"], r["end_time"]) for r in log.collect()] == [(1, None)]
    tasks = spark.createDataFrame([("task", "running")], "id string, run_status string")
    assert [r["status"] for r in runlog.stale_repair(log, tasks, NOW).collect()] == [3]
    more = source.union(frame(spark, [(100 + i, 100 + i, "b") for i in range(1, 41)]))
    windows = []
    result = b.run(more, parts=2, on_progress=lambda r: windows.append(r.read))
    # the window that was being told about is read again, the saved ones stay, the tail is cut in two
    assert windows == [20, 40, 60, 80, 100, 120] and result.open_ranges == 0 and b.table.read().count() == 140
    assert sorted(r["status"] for r in job.read_run_log(spark, b.log).collect()) == [2, 2]


def test_an_item_that_fails_leaves_the_others_whole(spark, where):
    good, bad = frame(spark, [(1, 1, "a")]), frame(spark, [(1, 1, "a")]).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    jobs = {n: (df, table_of(spark, where(n)), SyncSpec(n, keys=("k",))) for n, df in (("a", good), ("b", bad), ("c", good))}
    done = job.run_tables(jobs, StateTable(spark, where("s")), NOW)
    assert done["a"].inserted == done["c"].inserted == 1 and isinstance(done["b"], Exception)


def test_binary_texts_and_fractions_are_coerced_or_rejected(spark, where):
    schema = T.StructType.fromDDL("k bigint, b binary, n bigint")
    source = spark.createDataFrame([(1, "aGVsbG8=", 12.0), (2, "data:image/png;base64,aGVsbG8=", None), (3, " ", 3.0), (4, "%%", 1.0), (5, None, 12.7)],
                                   "k bigint, b string, n double")
    table = VersionedTable(spark, where("t"), schema, ["k"], 2)
    result = job.run_sync(source, table, SyncSpec("task", keys=("k",)), StateTable(spark, where("s")), NOW)
    assert (result.read, result.rejected) == (3, 2)
    assert [(r.k, r.b and bytes(r.b), r.n) for r in table.read().orderBy("k").collect()] == [(1, b"hello", 12), (2, b"hello", None), (3, None, 3)]


def test_markers_of_many_tasks_move_forward_at_once(spark, tmp_path):
    states = StateTable(spark, str(tmp_path / "state"))
    states.save("open", "2024-01-01 00:00:00", "paused", "2024-01-01 00:00:00", [("2024-01-02 00:00:00", None)], "2024-01-02 00:00:00")
    for a, b in (("2024-01-05 00:00:00", "2024-01-09 00:00:00.000001"), ("2024-01-07 00:00:00", "2024-01-08 00:00:00")):
        reached = spark.createDataFrame([("a", a), ("b", b), ("open", b)], "task_id string, m string").select(
            "task_id", F.col("m").cast("timestamp_ntz").alias("last_marker"))
        states.advance(reached, "2024-01-10 00:00:00")
    got = {name: states.latest(name).last_marker for name in ("a", "b", "open")}
    assert got == {"a": "2024-01-07 00:00:00", "b": "2024-01-09 00:00:00.000001", "open": "2024-01-01 00:00:00"}
    assert states.latest("b").seq == 1 and states.latest("open").resuming


@pytest.mark.parametrize("name, n", [("sync_incremental", 1), ("sync_full", 1), ("pause_vs_stop", 2), ("marker_advance", 0)])
def test_queries_of_jobs_go_through_the_job(spark, tables, monkeypatch, name, n):
    from tidemark.plans import job, merge_queries, registry  # noqa: F401
    runs, advances = [], []
    run, advance = job.run_sync, getattr(StateTable, "advance", None)
    monkeypatch.setattr(job, "run_sync", lambda *a, **b: runs.append(run(*a, **b)) or runs[-1])
    monkeypatch.setattr(StateTable, "advance", lambda *a: advances.append(a) or advance(*a), raising=False)
    registry.QUERIES[name](tables)
    assert len(runs) == n and bool(advances) == (name == "marker_advance")


def test_a_table_is_given_another_number_of_buckets(spark, where):
    b = Bench(spark, where)
    b.run(frame(spark, [(i, i, "a") for i in range(200)]))
    before, other = rows(b.table.read()), table_of(spark, where("target"))
    base = other.current()
    assert b.table.rebucket(16) == 2 and b.table.rebucket(16) == 2 and rows(b.table.read()) == before
    assert len(b.table.manifest()["folders"]) == 16 and {int(k) for k in b.table.manifest()["folders"]} == set(b.table.touched(b.table.read()))
    with pytest.raises(ConcurrentChange):
        other.write(frame(spark, [(1, 1, "lost")]), base=base)
    b.run(frame(spark, [(5, 500, "b"), (900, 900, "b")]))  # a merge finds its keys in the new buckets
    assert b.table.read().where("v = 'b'").count() == 2 and b.table.read().count() == 201
    assert table_of(spark, where("target")).rebucket() == 4 and len(b.table.manifest()["folders"]) == 1 and b.table.read().count() == 201


# ---- claims, interruption, side by side, cost of a run

def jobs_of(spark, fn):
    """Number of Spark jobs that a call starts."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        fn()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_second_run_of_a_task_is_refused(spark, where):
    b = Bench(spark, where)
    refused = []

    def again(_):
        with pytest.raises(TaskBusy):
            b.run(frame(spark, [(1, 1, "b")]))
        refused.append(True)
    b.run(frame(spark, [(1, 1, "a")]), on_progress=again)
    assert refused == [True] and rows(b.table.read()) == [(1, 1, "a")]
    b.run(frame(spark, [(2, 2, "a")]))  # it is free again
    assert b.table.read().count() == 2


def test_an_expired_claim_is_void_and_its_owner_finds_out(spark, where):
    states = StateTable(spark, where("s"))
    dead = Claim(states.files, "task-x.claim", -1)
    assert states.files.create(dead.name, dead._text())
    with states.claim("x", 60) as claim:
        assert claim.held() and not dead.held()
        with pytest.raises(TaskBusy):
            states.claim("x").__enter__()
        with states.claim("y"):
            pass
    assert not [n for n in states.files.names() if n.endswith("claim")]


def test_a_claim_is_renewed_while_it_is_held(spark, where):
    states = StateTable(spark, where("s"))
    with states.claim("x", 0.6):
        time.sleep(1.2)
        with pytest.raises(TaskBusy):
            states.claim("x").__enter__()


def test_a_run_lost_to_another_saves_nothing(spark, where):
    b = Bench(spark, where)

    def robbed(_):
        b.state.files.replace("task-task.claim", json.dumps({"owner": "other", "until": time.time() + 60}))
    with pytest.raises(TaskBusy):
        b.run(frame(spark, [(1, 1, "a")]), on_progress=robbed)
    assert b.latest().seq == 0


def test_the_state_does_not_grow_with_runs(spark, where):
    b = Bench(spark, where)
    for i in range(4):
        b.run(frame(spark, [(i, i, "a")]))
        assert b.latest().last_marker == str(i)
    assert b.state.files.names() == ["task-task.json"] and b.latest().seq == 4
    assert jobs_of(spark, lambda: b.state.save("task", NOW, "stopped", "9")) == jobs_of(spark, b.latest) == 0
    for day in (1, 2, 3):
        b.state.advance(spark.createDataFrame([("other", day), ("task", 7 + day)], "task_id string, last_marker bigint"), NOW)
    assert len([n for n in SmallFiles(spark, b.state.path).names() if n.startswith("moved-")]) == 2
    assert b.latest().last_marker == "10" and b.state.latest("other").last_marker == "3"
    assert {r["task_id"]: r["last_marker"] for r in b.state.newest().collect()} == {"task": "10", "other": "3"}
    b.state.save("task", NOW, "stopped", "11")
    assert b.latest().last_marker == "11"


def test_a_running_window_is_broken_off_and_taken_up_again(spark, where):
    """The second of two windows never ends by itself; it is broken off from another thread, and the next run does it."""
    b = Bench(spark, where)
    source = spark.range(1, 41).select(F.col("id").alias("k"), F.col("id").alias("m"), F.lit("a").alias("v"))
    stuck = where("stuck")

    @F.udf("string")
    def wait(v, m):
        import os
        import time
        while m > 20 and os.path.exists(stuck):
            time.sleep(0.05)
        return v
    Path(stuck).write_text("")
    slow, found = source.withColumn("v", wait("v", "m")), []
    thread = InheritableThread(target=lambda: found.append(b.run(slow, parts=2)), session=spark)
    thread.start()
    for _ in range(600):
        if len(b.latest().gaps) == 1:  # the first window is done
            break
        time.sleep(0.1)
    time.sleep(1)
    assert job.interrupt(spark, "task")
    thread.join(60)
    Path(stuck).unlink()
    assert not thread.is_alive() and found[0].status == "paused" and found[0].open_ranges == 1
    assert b.latest().run_status == "paused" and b.table.read().count() == 20
    result = b.run(slow)
    assert result.status == "success" and result.read == 20 and b.table.read().count() == 40
    assert not job.interrupt(spark, "task")


def test_tables_run_side_by_side(spark, where):
    """Two items meet inside their runs, which they can only if neither waits for the other."""
    met = threading.Barrier(2, timeout=60)
    real = job.write_changes
    jobs = {n: (frame(spark, [(1, 1, n)]), table_of(spark, where(n)), SyncSpec(n, keys=("k",))) for n in ("a", "b")}
    try:
        job.write_changes = lambda table, *a, **k: (met.wait(), real(table, *a, **k))[1]
        done = job.run_tables(jobs, StateTable(spark, where("s")), NOW)
    finally:
        job.write_changes = real
    assert [done[n].inserted for n in "ab"] == [1, 1]
    # two items of one task: one of them is refused
    same = {n: (frame(spark, [(i, 5, n)]), table_of(spark, where(n)), SyncSpec("one", keys=("k",))) for i, n in enumerate("cd")}
    done = job.run_tables(same, StateTable(spark, where("s")), NOW)
    assert any(not isinstance(r, Exception) for r in done.values()) and all(isinstance(r, TaskBusy) for r in done.values() if isinstance(r, Exception))


def test_a_run_is_a_few_jobs_whatever_was_done_before(spark, where):
    b = Bench(spark, where)
    source = spark.range(1, 1001).select(F.col("id").alias("k"), F.col("id").alias("m"), F.lit("a").alias("v"))
    first = jobs_of(spark, lambda: job.run_sync(source, b.table, b.spec, b.state, NOW, parts=20))
    assert first <= 140, first
    more = source.union(source.withColumn("k", F.col("k") + 1000).withColumn("m", F.col("m") + 1000))
    again = jobs_of(spark, lambda: job.run_sync(more, b.table, b.spec, b.state, NOW))
    assert again <= 12 and b.table.read().count() == 2000, again


@pytest.mark.parametrize("guard", [(), ("v",)])
def test_a_large_merge_does_in_one_pass_what_a_small_one_does(spark, where, monkeypatch, guard):
    schema = "k int, j string, v int, kept string"
    old = [(i, f"j{i % 3}", i, "old") for i in range(60)] + [(7, "j1", 99, "again"), (None, "j0", 1, "no key"), (None, "j0", 1, "no key"), (3, None, 2, "half a key")]
    new = [(i, f"j{i % 3}", i if i % 4 else (None if i == 8 else i + (-1) ** i * 5), "new") for i in range(50, 80)] + [(7, "j1", 50, "x"), (4, "j1", 4, "x"), (8, "j2", None, "x"), (None, "j0", 5, "x")]
    source = spark.createDataFrame(new, schema).drop("kept")
    spec, found = SyncSpec("t", keys=("k", "j"), marker=None, order=("v",)), []
    for limit in (1 << 30, -1):
        monkeypatch.setattr(job, "BROADCAST_LIMIT_BYTES", limit)
        table = VersionedTable(spark, where(f"merge-{limit}"), T.StructType.fromDDL(schema), ("k", "j"), 8)
        table.write(spark.createDataFrame(old, schema))
        wide = job.shape(source, spec, T.StructType.fromDDL("k int, j string, v int"))
        result = job.write_changes(table, wide, spec, "run.1", guard)
        before = table.manifest()["folders"]
        again = job.write_changes(table, wide.where("k = 4 or k = 51"), spec, "run.2", guard)
        assert table.manifest()["folders"] == before and again.updated == again.inserted == 0
        found.append((result, sorted(map(repr, table.read().collect()))))
        # buckets without an update keep what they had
        added = job.write_changes(table, job.shape(spark.createDataFrame([(1000, "n", 1)], "k int, j string, v int"), spec, T.StructType.fromDDL("k int, j string, v int")), spec, "run.3", guard)
        assert added.inserted == 1 and sum(len(p) for p in table.manifest()["folders"].values()) == sum(map(len, before.values())) + 1
        assert table.read().count() == len(found[-1][1]) + 1
    assert found[0] == found[1] and found[0][0].updated and found[0][0].inserted and found[0][0].unchanged
