"""Analytics over the run log and the task table.

The run log is a fact table; tasks, connections and schedules are dimensions. Joins carry no broadcast hint: Spark broadcasts a
side when its own size estimate is below the session threshold and shuffles it otherwise. Facts are reduced per key before
they are joined, so a task with most of the runs sends one row per input partition.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timing import clock_text, epoch_micros, ntz, shift, whole_seconds
from tidemark.operators.merge import last_wins
from tidemark.operators.sizing import broadcast_if_small
from tidemark.session import staged
from tidemark.sources.scan import with_total
from tidemark.spec import RunStatus

# Texts and limits of the reproduced reports.
STATUS_LABELS = {RunStatus.RUNNING: "running", RunStatus.SUCCESS: "success", RunStatus.FAILED: "fail"}
UNKNOWN_STATUS = "unknown"
NO_ERROR_TEXT = "无异常上报"
START_EVENT = ("任务 ", " 开始执行")
DONE_EVENT = "任务已完成"
FAILED_EVENT = "任务执行失败"
DURATION_EVENT = "，总耗时 "
RESTART_MESSAGE = "系统异常重启, 任务中断"
RESUME_MESSAGE = "任务重新启动, 从断点续传"
TIMEOUT_MESSAGE = "任务执行超过12小时, 已被系统强制终止"
MAX_RUN_SECONDS = 12 * 3600
LOG_PAGE_SIZE = 20
MAX_LOG_PAGE_SIZE = 100
STATUS_FILTERS = {"success": RunStatus.SUCCESS, "fail": RunStatus.FAILED, "running": RunStatus.RUNNING,
                  "warning": RunStatus.RUNNING}


def _is(status: RunStatus) -> Column:
    return F.col("status") == F.lit(int(status))


def filter_runs(log: DataFrame, status: str | None = None, task_id: Any = None, keyword: str | None = None,
                start_from: Any = None, start_to: Any = None, end_from: Any = None, end_to: Any = None,
                day: str | None = None) -> DataFrame:
    """Runs by status name, task, keyword in name or id, start in [from, to), end in [from, to], start day."""
    rows = log
    if status and status.lower() in STATUS_FILTERS:
        rows = rows.where(_is(STATUS_FILTERS[status.lower()]))
    if task_id is not None:
        rows = rows.where(F.col("task_id") == F.lit(task_id))
    if keyword and keyword.strip():
        word = F.lit(keyword.strip().lower())
        rows = rows.where(F.lower("task_name").contains(word) | F.lower(F.col("task_id").cast("string")).contains(word))
    if day is not None:
        start_from, start_to = ntz(day), ntz(day) + F.expr("interval '1' day")
    for name, low, high, closed in (("start_time", start_from, start_to, False), ("end_time", end_from, end_to, True)):
        if low is not None:
            rows = rows.where(F.col(name) >= ntz(low))
        if high is not None:
            rows = rows.where(F.col(name) <= ntz(high) if closed else F.col(name) < ntz(high))
    return rows


def log_page(log: DataFrame, number: int = 1, size: int = LOG_PAGE_SIZE, max_size: int = MAX_LOG_PAGE_SIZE) -> DataFrame:
    """A page of at most ``max_size`` runs, newest first, with the total; a larger size is refused."""
    if size > max_size:
        raise ValueError(f"a page has at most {max_size} runs, {size} were asked for")
    paged = log.orderBy(F.desc("start_time"), "id").offset((max(number, 1) - 1) * size).limit(size)
    return with_total(paged, log)


def log_summary(log: DataFrame) -> DataFrame:
    """Executions, success percentage (one decimal, 0 when empty) and failures."""
    n, ok = F.count(F.lit(1)), F.count_if(_is(RunStatus.SUCCESS))
    return log.agg(n.alias("total_exec"),
                   F.when(n > 0, F.round(ok * 100.0 / n, 1)).otherwise(0.0).cast("double").alias("success_rate"),
                   F.count_if(_is(RunStatus.FAILED)).alias("error_count"))


def status_label() -> Column:
    label = F.lit(UNKNOWN_STATUS)
    for status, text in STATUS_LABELS.items():
        label = F.when(_is(status), text).otherwise(label)
    return label


def duration_seconds() -> Column:
    return whole_seconds(F.col("start_time"), F.col("end_time"))


def duration_text() -> Column:
    """``Xm Ys``, below a minute ``Ys``, ``-`` while the run is open."""
    s = duration_seconds()
    minutes, rest = F.floor(s / 60).cast("bigint"), s % 60
    return (F.when(s.isNull(), "-")
            .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
            .otherwise(F.concat(s.cast("string"), F.lit("s"))))


def _counted(log: DataFrame, name: str, alias: str | None = None) -> Column:
    """A count of the run, 0 where it was not taken or the log has no such column."""
    count = F.coalesce(name, F.lit(0)) if name in log.columns else F.lit(0)
    return count.cast("bigint").alias(alias or name)


def log_display(log: DataFrame) -> DataFrame:
    return log.select("id", F.col("start_time").alias("exec_time"), status_label().alias("status"),
                      F.col("total_count").alias("rows_total"), duration_seconds().alias("duration_seconds"),
                      duration_text().alias("duration_display"), _counted(log, "insert_count"), _counted(log, "update_count"),
                      _counted(log, "skip_count"), _counted(log, "fail_count", "error_count"),
                      F.coalesce("error_msg", F.lit(NO_ERROR_TEXT)).alias("detail_summary"))


def log_detail(log: DataFrame) -> DataFrame:
    """Run detail, a row per run: what it did, its counts, its events in order and its errors as lists."""
    events = log_timeline(log).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "clock", "event"))).alias("e"))  # two at most
    timeline = events.select(F.col("id").alias("_id"), F.transform("e", lambda x: F.concat_ws(" ", x["clock"], x["event"])).alias("timeline"))
    errors = F.when(F.col("error_msg").isNull(), F.array().cast("array<string>")).otherwise(F.array("error_msg"))
    shown = log.select("id", status_label().alias("status"), duration_text().alias("duration"), F.concat(F.col("total_count").cast("string"), F.lit(" rows")).alias("rows_total"),
                       _counted(log, "insert_count"), _counted(log, "update_count"), _counted(log, "fail_count", "error_count"), _counted(log, "skip_count"), errors.alias("errors"))
    return shown.join(timeline, F.col("id") == F.col("_id"), "left").drop("_id")


def log_timeline(log: DataFrame) -> DataFrame:
    """One row per event of a run: its start, and its end once it has one."""
    start = F.concat(F.lit(START_EVENT[0]), F.col("id").cast("string"), F.lit(START_EVENT[1]))
    done = F.when(_is(RunStatus.SUCCESS), DONE_EVENT).otherwise(FAILED_EVENT)
    end = F.concat(done, F.lit(DURATION_EVENT), duration_text())
    events = F.array(
        F.struct(F.lit(1).alias("seq"), F.col("start_time").alias("event_time"), start.alias("event")),
        F.struct(F.lit(2).alias("seq"), F.col("end_time").alias("event_time"), end.alias("event")))
    return (log.select("id", F.explode(events).alias("e")).where(F.col("e.event_time").isNotNull())
            .select("id", "e.seq", "e.event_time", clock_text(F.col("e.event_time")).alias("clock"), "e.event"))


def day_summary(log: DataFrame, day: str) -> DataFrame:
    """Totals of the runs started on ``day``; rates are 0 when there was none."""
    rows = filter_runs(log, day=day)
    n, ok = F.count(F.lit(1)), F.count_if(_is(RunStatus.SUCCESS))
    # durations count whole seconds, an open run counts 0
    ms = F.coalesce(F.sum(F.coalesce(duration_seconds(), F.lit(0))), F.lit(0)) * 1000
    return rows.agg(
        n.alias("total_executions"), ok.alias("success_count"),
        F.count_if(_is(RunStatus.FAILED)).alias("fail_count"), F.count_if(_is(RunStatus.RUNNING)).alias("running_count"),
        F.coalesce(F.sum("success_count"), F.lit(0)).alias("total_rows_synced"),
        F.coalesce(F.sum("fail_count"), F.lit(0)).alias("total_error_rows"), ms.alias("total_duration_ms"),
        F.when(n > 0, F.round(ok / n, 4)).otherwise(0.0).alias("success_rate"),
        F.when(n > 0, F.floor(ms / 60000.0 / n * 10 + 0.5).cast("double") / 10).otherwise(0.0)
        .alias("avg_duration_minutes"))


def task_stats(log: DataFrame, task_ids: DataFrame | None = None) -> DataFrame:
    """Runs, successes, failures and last start per task; ``task_ids`` (column ``task_id``) restricts the tasks.
    Statistics are built per task first, the id list filters the small result."""
    stats = log.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("sync_count"), F.count_if(_is(RunStatus.SUCCESS)).alias("success_count"),
        F.count_if(_is(RunStatus.FAILED)).alias("fail_count"), F.max("start_time").alias("last_sync_time"))
    return stats if task_ids is None else stats.join(task_ids.select("task_id"), "task_id", "left_semi")


def latest_running(log: DataFrame) -> DataFrame:
    """The newest run still marked running, per task."""
    return last_wins(log.where(_is(RunStatus.RUNNING)), ["task_id"], ["start_time", "id"])


def active(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col("status") == 1)


def task_enriched(tasks: DataFrame, conns: DataFrame, schedules: DataFrame, log: DataFrame) -> DataFrame:
    """Tasks with connection and schedule names and run statistics; counts are 0 for tasks that never ran."""
    def conn(side):
        return conns.select(F.col("id").alias(f"{side}_conn_id"), F.col("name").alias(f"{side}_conn_name"),
                            F.col("db_type").alias(f"{side}_db_type"))
    names = schedules.select(F.col("id").alias("schedule_id"), F.col("name").alias("schedule_name"))
    stats = task_stats(log).withColumnRenamed("task_id", "id")
    joined = (tasks.join(conn("source"), "source_conn_id", "left").join(conn("target"), "target_conn_id", "left")
              .join(names, "schedule_id", "left").join(stats, "id", "left"))
    return joined.fillna(0, subset=["sync_count", "success_count", "fail_count"])


def with_stats(tasks: DataFrame, log: DataFrame) -> DataFrame:
    stats = task_stats(log).withColumnRenamed("task_id", "id")
    return tasks.join(stats, "id", "left").fillna(0, subset=["sync_count", "success_count", "fail_count"])


def group_rollup(tasks: DataFrame) -> DataFrame:
    """Folders: tasks, running tasks, successes and failures per group; a blank group is NULL. Needs run statistics."""
    group = F.nullif(F.trim(F.col("task_group")), F.lit("")).alias("task_group")
    return tasks.groupBy(group).agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("run_status") == "running").alias("running"),
        F.sum("success_count").alias("success"), F.sum("fail_count").alias("fail"))


def task_search(tasks: DataFrame, keyword: str) -> DataFrame:
    """Keyword in source table, target table, name or group, ignoring case."""
    word = F.lit(keyword.lower())
    hit = F.lit(False)
    for c in ("source_table", "target_table", "name", "task_group"):
        hit = hit | F.coalesce(F.lower(c).contains(word), F.lit(False))
    return tasks.where(hit)


def task_status_filter(tasks: DataFrame, which: str) -> DataFrame:
    """``fail``: tasks with failures; ``success``: tasks that ran without any; anything else: all."""
    if which == "fail":
        return tasks.where(F.col("fail_count") > 0)
    if which == "success":
        return tasks.where((F.col("fail_count") == 0) & (F.col("sync_count") > 0))
    return tasks


def global_success_rate(tasks: DataFrame) -> DataFrame:
    ok, bad = F.sum("success_count"), F.sum("fail_count")
    rate = F.when(ok + bad > 0, F.round(ok * 100.0 / (ok + bad), 1)).otherwise(100.0)
    return tasks.agg(F.count(F.lit(1)).alias("tasks"), F.coalesce(ok, F.lit(0)).alias("success"),
                     F.coalesce(bad, F.lit(0)).alias("fail"), rate.cast("double").alias("success_rate"))


def schedule_task_count(schedules: DataFrame, tasks: DataFrame) -> DataFrame:
    """Active tasks per schedule, 0 included."""
    used = active(tasks).groupBy("schedule_id").agg(F.count(F.lit(1)).alias("task_count"))
    return (schedules.select(F.col("id").alias("schedule_id"), "name").join(used, "schedule_id", "left")
            .fillna(0, subset=["task_count"]))


def runnable_tasks(schedules: DataFrame, tasks: DataFrame, manual: bool = False) -> DataFrame:
    """Active tasks a schedule would start. The timer needs an enabled, repeating schedule and skips paused and
    stopped tasks; a manual trigger skips paused ones only."""
    skipped = ["paused"] if manual else ["paused", "stopped"]
    usable = schedules if manual else schedules.where(F.col("enabled") & ~F.col("once"))
    names = usable.select(F.col("id").alias("schedule_id"), F.col("name").alias("schedule_name"))
    return (active(tasks).where(~F.col("run_status").isin(skipped)).join(names, "schedule_id")
            .select("id", "name", "schedule_id", "schedule_name", "run_status"))


def _close(log: DataFrame, closing: DataFrame, now: Any, message: str, status: RunStatus = RunStatus.FAILED) -> DataFrame:
    """The log with the runs in ``closing`` (column ``id``) ended at ``now`` with a status and message."""
    # one run per task; measured, because a broadcast spares the log its shuffle
    marks = staged(closing.select("id", F.lit(True).alias("_close")))
    rows = log.join(broadcast_if_small(marks), "id", "left")
    hit = F.coalesce(F.col("_close"), F.lit(False))
    changed = {"status": F.lit(int(status)), "end_time": ntz(now), "error_msg": F.lit(message)}
    return rows.select(*[(F.when(hit, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c)
                         for c in log.columns])


def stale_repair(log: DataFrame, tasks: DataFrame, now: Any, message: str = RESTART_MESSAGE) -> DataFrame:
    """After a restart: the newest running run of every task in state ``running`` becomes a failure."""
    interrupted = tasks.where(F.col("run_status") == "running").select(F.col("id").alias("task_id"))
    return _close(log, latest_running(log).join(interrupted, "task_id", "left_semi"), now, message)


def close_resumed(log: DataFrame, task_ids: DataFrame, now: Any, message: str = RESUME_MESSAGE) -> DataFrame:
    """When tasks (column ``task_id``) resume, their interrupted run ends as a success and a new run takes over."""
    return _close(log, latest_running(log).join(task_ids.select("task_id"), "task_id", "left_semi"), now, message,
                  RunStatus.SUCCESS)


def timeout_repair(log: DataFrame, now: Any, message: str = TIMEOUT_MESSAGE) -> DataFrame:
    """The newest running run of a task becomes a failure once it has been open for too long."""
    return _close(log, timed_out_runs(latest_running(log), now), now, message)


def timed_out_runs(log: DataFrame, now: Any, limit_seconds: int = MAX_RUN_SECONDS) -> DataFrame:
    """Open runs started more than ``limit_seconds`` before ``now``."""
    return log.where(_is(RunStatus.RUNNING) & F.col("end_time").isNull()
                     & (F.col("start_time") < shift(ntz(now), -limit_seconds)))


def trailing_rows(log: DataFrame, seconds: int, bucket_seconds: int = 86400) -> DataFrame:
    """Per ended run: rows its task moved in the trailing ``seconds`` up to and including its end.

    Every run is an arrival (+rows) at its end and an expiry (-rows) just after it leaves the trailing window, so the
    figure is a running sum: linear work, no frame is summed again per row. A running sum per task would be one group per
    task; it restarts in every time bucket instead, and a run that outlives its bucket arrives again at the start of
    the next. Group size then depends on the rate of a task, not on its history.
    """
    if bucket_seconds < seconds:
        raise ValueError("a bucket must be at least as long as the trailing window")
    width, bucket = seconds * 1000000, bucket_seconds * 1000000
    own = (log.where(F.col("end_time").isNotNull()).withColumn("_t", epoch_micros(F.col("end_time")))
           .withColumn("_b", F.floor(F.col("_t") / bucket).cast("bigint")))
    rows, gone, following = F.col("success_count"), F.col("_t") + (width + 1), F.col("_b") + 1

    def event(b, at, delta, is_run=False):
        return F.struct(b.alias("b"), at.alias("at"), delta.alias("delta"), F.lit(is_run).alias("is_run"))

    arrival = event(F.col("_b"), F.col("_t"), rows, True)
    events = F.when(gone < following * bucket, F.array(arrival, event(F.col("_b"), gone, -rows))).otherwise(
        F.array(arrival, event(following, following * bucket, rows), event(following, gone, -rows)))
    w = Window.partitionBy("task_id", "e.b").orderBy("e.at").rangeBetween(Window.unboundedPreceding, 0)
    return (own.select("id", "task_id", "end_time", "success_count", F.explode(events).alias("e"))
            .withColumn("trailing_rows", F.sum("e.delta").over(w)).where("e.is_run")
            .select("id", "task_id", "end_time", "success_count", "trailing_rows",
                    (F.col("trailing_rows") / seconds).alias("rows_per_second")))


def completion(done: Column, total: Column) -> Column:
    """Integer percent, at most 100, 0 for an empty total."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total + 0.5))).otherwise(0).cast("int")


def run_progress(log: DataFrame) -> DataFrame:
    """Progress of every running run: total, done and failed rows and the percentage done."""
    return log.where(_is(RunStatus.RUNNING)).select(
        "id", "task_id", F.col("total_count").alias("total_rows"), F.col("success_count").alias("success_rows"),
        F.col("fail_count").alias("fail_rows"), completion(F.col("success_count"), F.col("total_count")).alias("percent"))
