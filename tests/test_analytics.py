import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows, ts
from tidemark.operators import dashboard, runlog

LOG = ("id bigint, task_id bigint, task_name string, status int, total_count bigint, success_count bigint, "
       "fail_count bigint, error_msg string, start_time timestamp_ntz, end_time timestamp_ntz")
NOW = "2024-01-15 12:00:00"


def log_of(spark, items):
    full = [(i, t, f"task {t}", s, n, ok, bad, None, ts(a), ts(b) if b else None) for i, t, s, n, ok, bad, a, b in items]
    return spark.createDataFrame(full, LOG)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], LOG)


def test_trailing_rows_against_brute_force(spark):
    """One task has most runs, ends tie, and the window crosses bucket borders."""
    rng = random.Random(5)
    base = ts("2024-01-01 23:50:00")
    data = []
    for i in range(1500):
        task = 0 if i % 3 else i % 7
        end = base + dt.timedelta(seconds=rng.randrange(0, 4000), microseconds=rng.choice([0, 0, 1, 999999]))
        data.append((i, task, rng.randrange(0, 50), end))
    log = spark.createDataFrame([(i, t, f"t{t}", 2, n, n, 0, None, e, e) for i, t, n, e in data], LOG)
    for window, bucket in ((600, 600), (600, 900), (600, 86400), (3600, 3600)):
        got = {r["id"]: r["trailing_rows"] for r in runlog.trailing_rows(log, window, bucket).collect()}
        span = dt.timedelta(seconds=window)
        want = {i: sum(n2 for _, t2, n2, e2 in data if t2 == t and e - span <= e2 <= e) for i, t, n, e in data}
        assert got == want
    with pytest.raises(ValueError):
        runlog.trailing_rows(log, 600, 60)


def test_figures_of_an_empty_log(spark, empty):
    assert dashboard.rps_current(empty, NOW).first()[0] == 0
    assert dashboard.rps_trend(empty, NOW).first()["rps_trend"] == "N/A"
    assert tuple(dashboard.latency_per_1k(empty, NOW).first()) == (0, 0.0, "stable")
    assert dashboard.full_progress(empty).first()["full_sync_progress"] == -1
    assert dashboard.activity_state(empty, NOW).first()[0] == "idle"
    tasks = spark.createDataFrame([], "id bigint, source_table string")
    assert rows(dashboard.sync_distribution(empty, tasks)) == [("no_data", 0)]
    assert dashboard.last_event(empty, tasks, NOW).count() == 0
    assert tuple(dashboard.overview(empty, tasks, NOW, "2024-01-15").first()) == (
        0, "N/A", 0.0, "stable", 0, 0, 0.0, 0, -1, "idle", None, None, None)
    assert tuple(runlog.log_summary(empty).first()) == (0, 0.0, 0)
    day = runlog.day_summary(empty, "2024-01-15").first()
    assert day["total_executions"] == 0 and day["success_rate"] == 0 and day["avg_duration_minutes"] == 0
    assert dashboard.throughput(empty, "2024-01-15").first()["throughput_mbps"] == 0
    frame = dashboard.perf_windows(empty, NOW).collect()
    assert len(frame) == 7 and all(r["rps"] == 0 and r["latency_s"] == 0 for r in frame)


def test_rate_falls_back_to_the_newest_running_run(spark):
    log = log_of(spark, [(1, 1, 1, 100, 500, 0, "2024-01-15 11:59:50", None),
                         (2, 1, 1, 100, 900, 0, "2024-01-15 11:00:00", None),
                         (3, 1, 1, 100, 9000, 0, "2024-01-13 11:00:00", None)])
    assert dashboard.rps_current(log, NOW).first()[0] == 50
    assert dashboard.rps_trend(log, NOW).first()["rps_trend"] == "+100%"
    assert dashboard.latency_per_1k(log, NOW).first()["latency_ms"] == 20000.0
    assert dashboard.activity_state(log, NOW).first()[0] == "active"


def test_trend_and_latency_words(spark):
    log = log_of(spark, [(1, 1, 2, 10, 1000, 0, "2024-01-15 11:59:45", "2024-01-15 11:59:55"),
                         (2, 1, 2, 10, 1000, 0, "2024-01-15 11:59:40", "2024-01-15 11:59:45"),
                         (3, 1, 3, 10, 0, 5, "2024-01-15 11:59:40", "2024-01-15 11:59:56")])
    row = dashboard.rps_trend(log, NOW).first()
    assert (row["current_rps"], row["previous_rps"], row["rps_trend"]) == (100, 200, "-50%")
    assert tuple(dashboard.latency_per_1k(log, NOW).first()) == (2, 7500.0, "critical")
    assert dashboard.activity_state(log, NOW).first()[0] == "error"


def test_progress_is_capped(spark):
    log = log_of(spark, [(1, 1, 1, 100, 100, 20, "2024-01-15 11:00:00", None)])
    assert dashboard.full_progress(log).first()["full_sync_progress"] == 99
    none = log_of(spark, [(1, 1, 1, 0, 0, 0, "2024-01-15 11:00:00", None)])
    assert dashboard.full_progress(none).first()["full_sync_progress"] == 0
    done = spark.range(1).select(runlog.completion(F.lit(1), F.lit(3)).alias("a"), runlog.completion(F.lit(9), F.lit(3)).alias("b"),
                                 runlog.completion(F.lit(0), F.lit(0)).alias("c")).first()
    assert tuple(done) == (33, 100, 0)


def test_distribution_names_unknown_tasks_and_the_rest(spark):
    items = [(i, i, 2, n, n, 0, NOW, NOW) for i, n in enumerate([500, 300, 100, 50, 30, 15, 5])]
    tasks = spark.createDataFrame([(i, f"T{i}") for i in range(6)], "id bigint, source_table string")
    got = dict(rows(dashboard.sync_distribution(log_of(spark, items), tasks)))
    assert got == {"T0": 50, "T1": 30, "T2": 10, "T3": 5, "T4": 3, "other": 2}
    few = dict(rows(dashboard.sync_distribution(log_of(spark, items[:2]), tasks.where("id = 0"))))
    assert few == {"T0": 62, "unknown": 37}


def test_durations_and_labels(spark):
    log = log_of(spark, [(1, 1, 2, 1, 1, 0, "2024-01-01 00:00:00", "2024-01-01 00:02:05"),
                         (2, 1, 3, 1, 1, 0, "2024-01-01 00:00:00.9", "2024-01-01 00:00:01.1"),
                         (3, 1, 1, 1, 1, 0, "2024-01-01 00:00:00", None), (4, 1, 9, 1, 1, 0, "2024-01-01 00:00:00", None)])
    got = rows(runlog.log_display(log).select("id", "status", "duration_seconds", "duration_display"))
    assert got == [(1, "success", 125, "2m 5s"), (2, "fail", 0, "0s"), (3, "running", None, "-"), (4, "unknown", None, "-")]
    assert runlog.log_timeline(log).count() == 6


def test_filters_and_pages(spark):
    items = [(i, i % 4, 1 + i % 3, 1, 1, 0, f"2024-01-{1 + i % 28:02d} 00:00:00", f"2024-01-{1 + i % 28:02d} 01:00:00")
             for i in range(250)]
    log = log_of(spark, items)
    assert runlog.filter_runs(log, status="all").count() == 250
    assert runlog.filter_runs(log, status="warning").count() == runlog.filter_runs(log, status="running").count() == 84
    assert runlog.filter_runs(log, task_id=2).count() == runlog.filter_runs(log, keyword="TASK 2").count()
    assert runlog.filter_runs(log, day="2024-01-03").count() == 9
    assert runlog.filter_runs(log, end_to="2024-01-01 01:00:00").count() == 9
    with pytest.raises(ValueError):
        runlog.log_page(log, 1, 500)
    assert len(runlog.log_page(log, 1, 500, max_size=500).collect()) == log.count()
    seen = [r["id"] for n in range(1, 4) for r in runlog.log_page(log, n, 100).collect()]
    assert len(seen) == len(set(seen)) == 250
    assert runlog.log_page(log, 4, 100).count() == 0


def test_tasks_and_schedules(spark):
    tasks = spark.createDataFrame([(1, "a", 1, "running", 1), (2, "b", 1, "paused", 1), (3, "c", 1, "stopped", 1),
                                   (4, "d", 1, "error", 0), (5, "e", 2, "error", 1), (6, "f", None, "error", 1)],
                                  "id bigint, name string, schedule_id bigint, run_status string, status int")
    schedules = spark.createDataFrame([(1, "one", True, False), (2, "two", True, True), (3, "none", False, False)],
                                      "id bigint, name string, enabled boolean, once boolean")
    assert [r["id"] for r in runlog.runnable_tasks(schedules, tasks).collect()] == [1]
    assert sorted(r["id"] for r in runlog.runnable_tasks(schedules, tasks, manual=True).collect()) == [1, 3, 5]
    assert rows(runlog.schedule_task_count(schedules, tasks).select("schedule_id", "task_count")) == [(1, 3), (2, 1), (3, 0)]
    empty = spark.createDataFrame([], LOG)
    stats = runlog.with_stats(runlog.active(tasks), empty)
    assert runlog.global_success_rate(stats).first()["success_rate"] == 100.0


def test_run_detail_has_counts_events_and_errors(spark):
    log = log_of(spark, [(1, 7, 2, 10, 9, 1, "2024-01-15 10:00:00", "2024-01-15 10:01:05"), (2, 7, 1, 0, 0, 0, "2024-01-15 11:00:00", None)])
    full = log.withColumns({"insert_count": F.lit(4), "update_count": F.when(F.col("id") == 1, 5), "skip_count": F.lit(2).cast("bigint"),
                            "error_msg": F.when(F.col("id") == 1, "lost")})
    got = {r["id"]: r for r in runlog.log_detail(full).collect()}
    assert (got[1].insert_count, got[1].update_count, got[1].error_count, got[1].skip_count, got[1].errors) == (4, 5, 1, 2, ["lost"])
    assert got[1].timeline == ["10:00:00 任务 1 开始执行", "10:01:05 任务已完成，总耗时 1m 5s"] and got[1].rows_total == "10 rows"
    assert (got[2].update_count, got[2].errors, got[2].timeline, got[2].duration) == (0, [], ["11:00:00 任务 2 开始执行"], "-")
    assert runlog.log_detail(log).agg(F.sum("insert_count")).first()[0] == 0  # a log without these columns
