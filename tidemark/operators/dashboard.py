"""Dashboard figures over the run log. ``now`` is always an argument."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timing import elapsed_ms, exact_seconds, ntz, shift, whole_seconds
from tidemark.operators.runlog import _is, day_summary
from tidemark.session import staged
from tidemark.spec import RunStatus

# Thresholds and constants of the reproduced figures.
DAY_SECONDS = 24 * 3600
BYTES_PER_ROW = 500
BANDWIDTH_MBPS = 100
WARNING_LATENCY_MS = 2000
CRITICAL_LATENCY_MS = 5000
MAX_RUNNING_PERCENT = 99
TOP_TABLES = 5
METRIC_SAMPLES = 72


def half_up(value: Column, digits: int = 2) -> Column:
    scale = 10 ** digits
    return F.floor(value * scale + 0.5).cast("double") / scale


def run_rate() -> Column:
    """Rows per second of one run, whole seconds (at least 1), integer quotient."""
    seconds = F.greatest(F.lit(1), whole_seconds(F.col("start_time"), F.col("end_time")))
    return F.floor(F.col("success_count") / seconds).cast("bigint")


def _ended(now: Any, seconds: int, until: int = 0) -> Column:
    end = F.col("end_time")
    return (end >= shift(ntz(now), -seconds)) & (end <= shift(ntz(now), -until))


# Every figure is a set of conditional aggregates (functions ending in ``_parts``) and result columns over them, so one figure
# or the whole overview is a single pass over the log.

def _running(now: Any) -> Column:
    """Running runs started within the last day."""
    return _is(RunStatus.RUNNING) & (F.col("start_time") >= shift(ntz(now), -DAY_SECONDS)) \
        & (F.col("start_time") <= ntz(now))


def _done() -> Column:
    return F.col("success_count") + F.col("fail_count")


def _newest_part(now: Any) -> Column:
    return F.max(F.when(_running(now), F.struct("start_time", "id", "success_count", "total_count", _done().alias("done")))
                 ).alias("newest")


def _rate_parts(now: Any, window: int) -> list[Column]:
    moved = F.col("success_count") > 0
    current, previous = _ended(now, window), _ended(now, 2 * window, window)
    return [F.coalesce(F.sum(F.when(current & moved, run_rate())), F.lit(0)).alias("ended_rps"),
            F.coalesce(F.sum(F.when(previous & moved, run_rate())), F.lit(0)).alias("previous_rps")]


def _current(now: Any) -> Column:
    n = F.col("newest")
    seconds = F.greatest(F.lit(1), whole_seconds(n["start_time"], ntz(now)))
    live = F.when(n["success_count"] > 0, F.floor(n["success_count"] / seconds).cast("bigint"))
    return F.when(F.col("ended_rps") > 0, F.col("ended_rps")).otherwise(F.coalesce(live, F.lit(0)))


def _trend(now: Any) -> Column:
    change = (_current(now) - F.col("previous_rps")) * 100.0 / F.nullif(F.col("previous_rps"), F.lit(0))
    percent = F.round(change, 0).cast("bigint").cast("string")
    return (F.when(F.col("previous_rps") > 0, F.concat(F.when(change >= 0, "+").otherwise(""), percent, F.lit("%")))
            .when(_current(now) > 0, "+100%").otherwise("N/A"))


def rps_current(log: DataFrame, now: Any, window_seconds: int = 10) -> DataFrame:
    """Sum of the rates of runs ended in the window; if that is 0, the rate of the newest running run of the last day."""
    near = log.where(_ended(now, window_seconds) | _running(now))
    return near.agg(*_rate_parts(now, window_seconds), _newest_part(now)).select(_current(now).alias("current_rps"))


def rps_trend(log: DataFrame, now: Any, window_seconds: int = 10) -> DataFrame:
    """Change against the previous window in whole percent; ``+100%`` from zero, ``N/A`` if both are zero."""
    near = log.where(_ended(now, 2 * window_seconds) | _running(now))
    return near.agg(*_rate_parts(now, window_seconds), _newest_part(now)).select(
        _current(now).alias("current_rps"), "previous_rps", _trend(now).alias("rps_trend"))


def _latency_parts(now: Any, window: int) -> list[Column]:
    ended = _is(RunStatus.SUCCESS) & _ended(now, window) & (_done() > 0)
    # milliseconds times 1000 over rows, summed as exact decimals: the result does not depend on the order
    per_1k = (elapsed_ms(F.col("start_time"), F.col("end_time")).cast("decimal(20,0)") * 1000
              / F.nullif(_done(), F.lit(0)).cast("decimal(10,0)")).cast("decimal(28,6)")
    return [F.sum(F.when(ended, per_1k)).alias("latency_sum"), F.count_if(ended).alias("latency_runs")]


def _latency(now: Any) -> Column:
    n = F.col("newest")
    live = F.when((n["total_count"] > 0) & (n["done"] > 0),
                  half_up(elapsed_ms(n["start_time"], ntz(now)) * 1000.0 / n["done"], 0))
    return F.when(F.col("latency_runs") > 0,
                  half_up(F.col("latency_sum").cast("double") / F.nullif(F.col("latency_runs"), F.lit(0)))
                  ).otherwise(F.coalesce(live, F.lit(0.0)))


def _latency_word(latency: Column) -> Column:
    return (F.when(latency > CRITICAL_LATENCY_MS, "critical").when(latency > WARNING_LATENCY_MS, "warning")
            .otherwise("stable"))


def latency_per_1k(log: DataFrame, now: Any, window_seconds: int = 30) -> DataFrame:
    """Mean milliseconds per 1000 rows of the successful runs ended in the window, with its status word. Without
    any, the newest running run of the last day counts with its elapsed time."""
    near = log.where(_ended(now, window_seconds) | _running(now))
    return near.agg(*_latency_parts(now, window_seconds), _newest_part(now)).select(
        F.col("latency_runs").alias("runs"), _latency(now).alias("latency_ms"),
        _latency_word(_latency(now)).alias("latency_status"))


def _mbps(rows: Column, ms: Column) -> Column:
    seconds = F.nullif(ms, F.lit(0)) / 1000.0
    return F.coalesce(half_up(rows * float(BYTES_PER_ROW) / seconds / 1024 / 1024), F.lit(0.0))


def _bandwidth(mbps: Column) -> Column:
    return F.least(F.lit(100), F.floor(mbps / BANDWIDTH_MBPS * 100)).cast("int")


def _hours(ms: Column) -> Column:
    return F.floor(ms / 3600000).cast("bigint")


def throughput(log: DataFrame, day: str) -> DataFrame:
    """MB/s of a day at a fixed row size, run hours and integer bandwidth percent (at most 100)."""
    row = day_summary(log, day).select("total_rows_synced", "total_duration_ms")
    rows, ms = F.col("total_rows_synced"), F.col("total_duration_ms")
    return row.select(rows, _hours(ms).alias("duration_hours"), _mbps(rows, ms).alias("throughput_mbps"),
                      _bandwidth(_mbps(rows, ms)).alias("bandwidth_pct"))


def _progress_parts() -> list[Column]:
    running, sized = _is(RunStatus.RUNNING), F.col("total_count") > 0
    return [F.count_if(running).alias("running_runs"),
            F.sum(F.when(running & sized, F.col("total_count"))).alias("running_total"),
            F.sum(F.when(running & sized, _done())).alias("running_done")]


def _progress() -> Column:
    percent = F.floor(F.col("running_done") * 100.0 / F.nullif(F.col("running_total"), F.lit(0)))
    return (F.when(F.col("running_runs") == 0, -1)
            .when(F.col("running_total") > 0, F.least(F.lit(MAX_RUNNING_PERCENT), percent)).otherwise(0).cast("int"))


def full_progress(log: DataFrame) -> DataFrame:
    """Integer percent over all running runs: at most 99, 0 if they have no rows, -1 if nothing runs."""
    return log.where(_is(RunStatus.RUNNING)).agg(*_progress_parts()).select(
        "running_runs", _progress().alias("full_sync_progress"))


def _activity_parts(now: Any, window: int) -> list[Column]:
    return [F.coalesce(F.bool_or(_is(RunStatus.RUNNING)), F.lit(False)).alias("any_running"),
            F.coalesce(F.bool_or(_is(RunStatus.FAILED) & _ended(now, window)), F.lit(False)).alias("any_failed")]


def _activity() -> Column:
    return F.when(F.col("any_failed"), "error").when(F.col("any_running"), "active").otherwise("idle")


def activity_state(log: DataFrame, now: Any, window_seconds: int = 10) -> DataFrame:
    """``error`` after a recent failure, else ``active`` while something runs, else ``idle``."""
    return log.agg(*_activity_parts(now, window_seconds)).select(_activity().alias("activity_state"))


def overview(log: DataFrame, tasks: DataFrame, now: Any, day: str, window_seconds: int = 10,
             latency_seconds: int = 30) -> DataFrame:
    """All figures in one row from one pass over the runs that can count: running, ended within a day, or of ``day``."""
    of_day = (F.col("start_time") >= ntz(day)) & (F.col("start_time") < ntz(day) + F.expr("interval '1' day"))
    reach = max(DAY_SECONDS, 2 * window_seconds, latency_seconds)
    near = log.where(_is(RunStatus.RUNNING) | _ended(now, reach) | of_day)
    seconds = F.coalesce(whole_seconds(F.col("start_time"), F.col("end_time")), F.lit(0))
    row = near.agg(
        *_rate_parts(now, window_seconds), *_latency_parts(now, latency_seconds), *_progress_parts(),
        *_activity_parts(now, window_seconds), _newest_part(now),
        F.coalesce(F.sum(F.when(of_day, F.col("success_count"))), F.lit(0)).alias("rows"),
        (F.coalesce(F.sum(F.when(of_day, seconds)), F.lit(0)) * 1000).alias("ms"))
    last = last_event(log, tasks, now)
    mbps = _mbps(F.col("rows"), F.col("ms"))
    event = last.select(F.struct(*last.columns)).scalar()
    return row.select(
        _current(now).alias("current_rps"), _trend(now).alias("rps_trend"), _latency(now).alias("latency_ms"),
        _latency_word(_latency(now)).alias("latency_status"), F.col("rows").alias("today_rows_synced"),
        _hours(F.col("ms")).alias("task_duration_hours"), mbps.alias("throughput_mbps"),
        _bandwidth(mbps).alias("bandwidth_usage_pct"), _progress().alias("full_sync_progress"),
        _activity().alias("activity_state"), *[event[c].alias(f"last_{c}") for c in last.columns])


def last_event(log: DataFrame, tasks: DataFrame, now: Any) -> DataFrame:
    """Source table, operation and time of the newest run ended within the last day whose task exists."""
    # one run per task meets the tasks
    newest = F.max(F.struct("start_time", "id", "status")).alias("r")
    recent = log.where(_ended(now, DAY_SECONDS)).groupBy("task_id").agg(newest).select("task_id", "r.*")
    named = recent.join(tasks.select(F.col("id").alias("task_id"), "source_table"), "task_id")
    operation = F.when(_is(RunStatus.SUCCESS), "SYNC_COMPLETE").otherwise("SYNC_RUNNING")
    return (named.orderBy(F.desc("start_time"), F.desc("id")).limit(1)
            .select("source_table", operation.alias("operation"), F.col("start_time").alias("event_time")))


def perf_windows(log: DataFrame, now: Any, minutes: int = 30, interval_seconds: int = 300) -> DataFrame:
    """Per window of the last ``minutes``: rows per second (integer) and mean duration in seconds, zero-filled."""
    start = shift(ntz(now), -minutes * 60)
    width = f"{interval_seconds} seconds"
    rows = log.where((F.col("end_time") >= start) & (F.col("end_time") <= ntz(now)))
    seconds = elapsed_ms(F.col("start_time"), F.col("end_time"))
    facts = rows.groupBy(F.window("end_time", width)["start"].alias("window_start")).agg(
        F.sum("success_count").alias("rows"), F.sum(seconds).alias("ms"), F.count(F.lit(1)).alias("runs"))
    # the frame has minutes * 60 / interval + 1 rows, a number given by the caller
    aligned = log.sparkSession.range(1).select(
        F.window(start, width)["start"].alias("first"), ntz(now).alias("last"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(interval_seconds))
    frame = aligned.select(F.explode(F.sequence("first", "last", step)).alias("window_start"))
    return frame.join(facts, "window_start", "left").select(
        "window_start", F.coalesce(F.floor(F.col("rows") / interval_seconds), F.lit(0)).cast("bigint").alias("rps"),
        F.coalesce(half_up(F.col("ms") / F.col("runs") / 1000), F.lit(0.0)).alias("latency_s"))


def sync_distribution(log: DataFrame, tasks: DataFrame, top: int = TOP_TABLES) -> DataFrame:
    """Integer percent of the moved rows by source table: the ``top`` largest, the rest as ``other``.

    Runs are summed per task before the join, then per table. That small result (one row per table) is checkpointed:
    the top list, the total and the rest are taken from it, so the log is scanned once and no global window is needed.
    """
    per_task = log.groupBy("task_id").agg(F.sum("total_count").alias("rows"))
    named = per_task.join(tasks.select(F.col("id").alias("task_id"), "source_table"), "task_id", "left")
    per_table = staged(named.groupBy(F.coalesce("source_table", F.lit("unknown")).alias("label")).agg(
        F.sum("rows").alias("rows")))
    leaders = per_table.orderBy(F.desc("rows"), "label").limit(top)
    whole = per_table.agg(F.struct(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("n")).alias("s")).scalar()
    rest = leaders.agg((whole["rows"] - F.sum("rows")).alias("rows"))
    other = rest.where((whole["n"] > top) & (F.col("rows") > 0)).select(F.lit("other").alias("label"), "rows")
    empty = log.sparkSession.range(1).where(whole["n"] == 0).select(F.lit("no_data").alias("label"),
                                                                    F.lit(0).cast("bigint").alias("rows"))
    percent = F.when(whole["rows"] > 0, F.floor(F.col("rows") * 100 / whole["rows"])).otherwise(0).cast("int")
    return leaders.unionByName(other).unionByName(empty).select("label", percent.alias("percent"))


def metric_tail(log: DataFrame, samples: int = METRIC_SAMPLES) -> DataFrame:
    """The newest samples: rate and duration of the last ended runs."""
    return (log.where(F.col("end_time").isNotNull()).orderBy(F.desc("end_time"), F.desc("id")).limit(samples)
            .select("id", "end_time", run_rate().alias("rps"),
                    half_up(exact_seconds(F.col("start_time"), F.col("end_time")).cast("double")).alias("duration_s")))
