"""Registered queries: run log, task and dashboard analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dashboard, runlog
from tidemark.plans.fixtures import DAY, NOW
from tidemark.plans.registry import ORACLE, query

START, STOP = "2024-01-10", "2024-01-20"
FILTER = (f"status = 3 and (lower(task_name) like '%t3%' or cast(task_id as varchar) like '%t3%') "
          f"and start_time >= timestamp '{START} 00:00:00' and start_time < timestamp '{STOP} 00:00:00'")
SECONDS = "cast(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000000) as bigint)"
MILLIS = "cast(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000) as bigint)"
DURATION_TEXT = (f"case when end_time is null then '-' when {SECONDS} >= 60 "
                 f"then concat({SECONDS} // 60, 'm ', {SECONDS} % 60, 's') else concat({SECONDS}, 's') end")


def filtered(t):
    return runlog.filter_runs(t.run_log, status="fail", keyword="T3", start_from=START, start_to=STOP)


@query("log_filter", f"select * from run_log where {FILTER}")
def log_filter(t):
    return filtered(t)


@query("log_page", f"""
with hits as (select * from run_log where {FILTER})
select *, (select count(*) from hits) as total from hits order by start_time desc, id limit 20 offset 20""")
def log_page(t):
    return runlog.log_page(filtered(t), number=2)


@query("log_summary", f"""
select count(*) as total_exec,
       case when count(*) > 0 then round(count(*) filter (where status = 2) * 100.0 / count(*), 1) else 0 end::double
         as success_rate,
       count(*) filter (where status = 3) as error_count
from run_log where start_time >= timestamp '{START} 00:00:00' and start_time < timestamp '{STOP} 00:00:00'""")
def log_summary(t):
    return runlog.log_summary(runlog.filter_runs(t.run_log, start_from=START, start_to=STOP))


@query("log_display", f"""
select id, start_time as exec_time,
       case status when 1 then 'running' when 2 then 'success' when 3 then 'fail' else 'unknown' end as status,
       total_count as rows_total, {SECONDS} as duration_seconds, {DURATION_TEXT} as duration_display,
       coalesce(insert_count, 0) as insert_count, coalesce(update_count, 0) as update_count, coalesce(skip_count, 0) as skip_count,
       coalesce(fail_count, 0) as error_count, coalesce(error_msg, '无异常上报') as detail_summary
from run_log_counts""")
def log_display(t):
    return runlog.log_display(t.run_log_counts)


@query("log_timeline", f"""
select id, 1 as seq, start_time as event_time, strftime(start_time, '%H:%M:%S') as clock,
       concat('任务 ', id, ' 开始执行') as event from run_log
union all
select id, 2, end_time, strftime(end_time, '%H:%M:%S'),
       concat(case when status = 2 then '任务已完成' else '任务执行失败' end, '，总耗时 ', {DURATION_TEXT})
from run_log where end_time is not null""")
def log_timeline(t):
    return runlog.log_timeline(t.run_log)


@query("log_detail", f"""
select id, case status when 1 then 'running' when 2 then 'success' when 3 then 'fail' else 'unknown' end as status, {DURATION_TEXT} as duration,
       concat(total_count, ' rows') as rows_total, coalesce(insert_count, 0) as insert_count, coalesce(update_count, 0) as update_count,
       coalesce(fail_count, 0) as error_count, coalesce(skip_count, 0) as skip_count, coalesce(error_msg, '') as errors, case when error_msg is null then 0 else 1 end as n_errors,
       concat_ws('; ', case when start_time is not null then concat(strftime(start_time, '%H:%M:%S'), ' 任务 ', id, ' 开始执行') end,
                 case when end_time is not null then concat(strftime(end_time, '%H:%M:%S'), ' ', case when status = 2 then '任务已完成' else '任务执行失败' end,
                                                            '，总耗时 ', {DURATION_TEXT}) end) as timeline
from run_log_counts""")
def log_detail(t):
    d = runlog.log_detail(t.run_log_counts)
    return d.withColumns({"n_errors": F.size("errors"), "errors": F.concat_ws("; ", "errors"), "timeline": F.concat_ws("; ", "timeline")})


@query("day_summary", f"""
with d as (select *, coalesce({SECONDS}, 0) as seconds from run_log where cast(start_time as date) = date '{DAY}')
select count(*) as total_executions, count(*) filter (where status = 2) as success_count,
       count(*) filter (where status = 3) as fail_count, count(*) filter (where status = 1) as running_count,
       cast(coalesce(sum(success_count), 0) as bigint) as total_rows_synced,
       cast(coalesce(sum(fail_count), 0) as bigint) as total_error_rows,
       cast(coalesce(sum(seconds), 0) * 1000 as bigint) as total_duration_ms,
       round(count(*) filter (where status = 2) / count(*), 4) as success_rate,
       floor(sum(seconds) * 1000 / 60000.0::double / count(*) * 10 + 0.5) / 10 as avg_duration_minutes
from d""")
def day_summary(t):
    return runlog.day_summary(t.run_log, DAY)


STATS = """
select task_id, count(*) as sync_count, count(*) filter (where status = 2) as success_count,
       count(*) filter (where status = 3) as fail_count, max(start_time) as last_sync_time
from run_log group by task_id"""


@query("task_stats", f"with stats as ({STATS}) select * from stats where task_id in (select id from sync_task where status = 1)")
def task_stats(t):
    return runlog.task_stats(t.run_log, runlog.active(t.sync_task).select(F.col("id").alias("task_id")))


@query("latest_running", """
select * from run_log where status = 1 qualify row_number() over (partition by task_id order by start_time desc, id desc) = 1""")
def latest_running(t):
    return runlog.latest_running(t.run_log)


ENRICHED = f"""
with stats as ({STATS})
select s.*, a.name as source_conn_name, a.db_type as source_db_type, b.name as target_conn_name,
       b.db_type as target_db_type, c.name as schedule_name, coalesce(x.sync_count, 0) as sync_count,
       coalesce(x.success_count, 0) as success_count, coalesce(x.fail_count, 0) as fail_count, x.last_sync_time
from sync_task s left join db_conn a on s.source_conn_id = a.id left join db_conn b on s.target_conn_id = b.id
left join schedule c on s.schedule_id = c.id left join stats x on s.id = x.task_id where s.status = 1"""


@query("task_enriched", ENRICHED)
def task_enriched(t):
    return runlog.task_enriched(runlog.active(t.sync_task), t.db_conn, t.schedule, t.run_log)


WITH_STATS = f"""
with stats as ({STATS}), tasks as (
  select s.*, coalesce(x.sync_count, 0) as sync_count, coalesce(x.success_count, 0) as success_count,
         coalesce(x.fail_count, 0) as fail_count, x.last_sync_time
  from sync_task s left join stats x on s.id = x.task_id where s.status = 1) """


def tasks_with_stats(t):
    return runlog.with_stats(runlog.active(t.sync_task), t.run_log)


@query("group_rollup", WITH_STATS + """
select nullif(trim(task_group), '') as task_group, count(*) as tasks,
       count(*) filter (where run_status = 'running') as running, cast(sum(success_count) as bigint) as success,
       cast(sum(fail_count) as bigint) as fail
from tasks group by 1""")
def group_rollup(t):
    return runlog.group_rollup(tasks_with_stats(t))


@query("task_search", """
select * from sync_task where lower(source_table) like '%t3%' or lower(target_table) like '%t3%'
   or lower(name) like '%t3%' or lower(task_group) like '%t3%'""")
def task_search(t):
    return runlog.task_search(t.sync_task, "T3")


@query("task_status_filter", WITH_STATS + """
select 'fail' as filter, * from tasks where fail_count > 0
union all select 'success', * from tasks where fail_count = 0 and sync_count > 0""")
def task_status_filter(t):
    tasks = tasks_with_stats(t)
    fail, success = (runlog.task_status_filter(tasks, w).withColumn("filter", F.lit(w)) for w in ("fail", "success"))
    return fail.unionByName(success)


@query("global_success_rate", WITH_STATS + """
select count(*) as tasks, cast(sum(success_count) as bigint) as success, cast(sum(fail_count) as bigint) as fail,
       case when sum(success_count + fail_count) > 0
            then round(sum(success_count) * 100.0 / sum(success_count + fail_count), 1) else 100 end::double as success_rate
from tasks""")
def global_success_rate(t):
    return runlog.global_success_rate(tasks_with_stats(t))


@query("schedule_task_count", """
select c.id as schedule_id, c.name, count(s.id) as task_count
from schedule c left join sync_task s on s.schedule_id = c.id and s.status = 1 group by c.id, c.name""")
def schedule_task_count(t):
    return runlog.schedule_task_count(t.schedule, t.sync_task)


@query("runnable_tasks", """
select s.id, s.name, s.schedule_id, c.name as schedule_name, s.run_status
from sync_task s join schedule c on s.schedule_id = c.id
where s.status = 1 and c.enabled and not c.once and s.run_status not in ('paused', 'stopped')""")
def runnable_tasks(t):
    return runlog.runnable_tasks(t.schedule, t.sync_task)


@query("active_tasks", "select * from sync_task where status = 1")
def active_tasks(t):
    return runlog.active(t.sync_task)


def _closed_oracle(closing: str, status: int, message: str) -> str:
    """The whole log with the runs of ``closing`` (ids) rewritten."""
    return f"""
with latest as (select * from run_log where status = 1
                qualify row_number() over (partition by task_id order by start_time desc, id desc) = 1),
     closing as ({closing})
select id, task_id, task_name, case when id in (select id from closing) then {status} else status end as status, total_count,
       success_count, fail_count, case when id in (select id from closing) then '{message}' else error_msg end as error_msg,
       start_time, case when id in (select id from closing) then timestamp '{NOW}' else end_time end as end_time
from run_log"""


@query("stale_repair", _closed_oracle(
    "select id from latest where task_id in (select id from sync_task where run_status = 'running')", 3,
    "系统异常重启, 任务中断"))
def stale_repair(t):
    return runlog.stale_repair(t.run_log, t.sync_task, NOW)


@query("resume_close", _closed_oracle(
    "select id from latest where task_id in (select id from sync_task where run_status = 'paused')", 2,
    "任务重新启动, 从断点续传"))
def resume_close(t):
    paused = t.sync_task.where("run_status = 'paused'").select(F.col("id").alias("task_id"))
    return runlog.close_resumed(t.run_log, paused, NOW)


@query("timeout_repair", _closed_oracle(
    f"select id from latest where start_time < timestamp '{NOW}' - interval 12 hour", 3, "任务执行超过12小时, 已被系统强制终止"))
def timeout_repair(t):
    return runlog.timeout_repair(t.run_log, NOW)


@query("run_progress", """
select id, task_id, total_count as total_rows, success_count as success_rows, fail_count as fail_rows,
       cast(case when total_count > 0 then least(100, floor(success_count * 100 / total_count + 0.5)) else 0 end as int)
         as percent
from run_log where status = 1""")
def run_progress(t):
    return runlog.run_progress(t.run_log)


@query("runnable_manually", """
select s.id, s.name, s.schedule_id, c.name as schedule_name, s.run_status
from sync_task s join schedule c on s.schedule_id = c.id where s.status = 1 and s.run_status <> 'paused'""")
def runnable_manually(t):
    return runlog.runnable_tasks(t.schedule, t.sync_task, manual=True)


@query("timed_out_runs", f"""
select * from run_log where status = 1 and end_time is null and start_time < timestamp '{NOW}' - interval 12 hour""")
def timed_out_runs(t):
    return runlog.timed_out_runs(t.run_log, NOW)


@query("progress_speed", """
with r as (select *, epoch_us(end_time) as us from run_log where end_time is not null)
select id, task_id, end_time, success_count, cast(sum(success_count) over (
         partition by task_id order by us range between 3600000000 preceding and current row) as bigint) as trailing_rows,
       sum(success_count) over (
         partition by task_id order by us range between 3600000000 preceding and current row) / 3600.0::double
         as rows_per_second
from r""")
def progress_speed(t):
    return runlog.trailing_rows(t.run_log, 3600)


# ---- dashboard

WINDOW = 3600
RATE = f"cast(floor(success_count / greatest(1, {SECONDS})) as bigint)"


def _between(hours_from: int, hours_to: int) -> str:
    return (f"end_time >= timestamp '{NOW}' - interval {hours_from} hour "
            f"and end_time <= timestamp '{NOW}' - interval {hours_to} hour")


RATES = f"""
newest as (select * from run_log where status = 1 and start_time >= timestamp '{NOW}' - interval 24 hour
             and start_time <= timestamp '{NOW}' order by start_time desc, id desc limit 1),
rates as (
  select cast(coalesce(sum({RATE}) filter (where {_between(1, 0)} and success_count > 0), 0) as bigint) as ended_rps,
         cast(coalesce(sum({RATE}) filter (where {_between(2, 1)} and success_count > 0), 0) as bigint) as previous_rps
  from run_log),
live as (
  select case when ended_rps > 0 then ended_rps else coalesce((select cast(floor(success_count / greatest(1,
           floor((epoch_us(timestamp '{NOW}') - epoch_us(start_time)) / 1000000))) as bigint)
           from newest where success_count > 0), 0) end as current_rps, previous_rps from rates)"""


@query("rps_current", f"with {RATES} select current_rps from live")
def rps_current(t):
    return dashboard.rps_current(t.run_log, NOW, WINDOW)


@query("rps_trend", f"""
with {RATES}
select current_rps, previous_rps,
       case when previous_rps > 0 then concat(case when current_rps >= previous_rps then '+' else '' end,
              cast(cast(round((current_rps - previous_rps) * 100.0 / previous_rps) as bigint) as varchar), '%')
            when current_rps > 0 then '+100%' else 'N/A' end as rps_trend from live""")
def rps_trend(t):
    return dashboard.rps_trend(t.run_log, NOW, WINDOW)


@query("latency_per_1k", f"""
with done as (select {MILLIS} / ((success_count + fail_count) / 1000.0::double) as per_1k from run_log
              where status = 2 and {_between(1, 0)} and success_count + fail_count > 0),
     newest as (select * from run_log where status = 1 and start_time >= timestamp '{NOW}' - interval 24 hour
                  and start_time <= timestamp '{NOW}' order by start_time desc, id desc limit 1),
     live as (select floor((epoch_us(timestamp '{NOW}') - epoch_us(start_time)) // 1000
                           / ((success_count + fail_count) / 1000.0::double) + 0.5) as latency_ms
              from newest where total_count > 0 and success_count + fail_count > 0),
     mean as (select count(*) as runs, coalesce(floor(avg(per_1k) * 100 + 0.5) / 100, (select latency_ms from live), 0)
                       as latency_ms from done)
select runs, latency_ms, case when latency_ms > 5000 then 'critical' when latency_ms > 2000 then 'warning'
                              else 'stable' end as latency_status from mean""")
def latency_per_1k(t):
    return dashboard.latency_per_1k(t.run_log, NOW, WINDOW)


@query("throughput", f"""
with d as (select cast(sum(success_count) as bigint) as total_rows_synced,
                  cast(sum(coalesce({SECONDS}, 0)) * 1000 as bigint) as ms
           from run_log where cast(start_time as date) = date '{DAY}'),
     m as (select total_rows_synced, ms // 3600000 as duration_hours, floor(
             total_rows_synced * 500.0::double / (ms / 1000.0::double) / 1024 / 1024 * 100 + 0.5) / 100 as throughput_mbps
           from d)
select *, cast(least(100, floor(throughput_mbps / 100 * 100)) as int) as bandwidth_pct from m""")
def throughput(t):
    return dashboard.throughput(t.run_log, DAY)


@query("full_progress", """
select count(*) as running_runs, cast(case when count(*) = 0 then -1 when sum(total_count) > 0
  then least(99, floor(sum(success_count + fail_count) * 100.0::double / sum(total_count))) else 0 end as int)
  as full_sync_progress
from run_log where status = 1""")
def full_progress(t):
    return dashboard.full_progress(t.run_log)


@query("activity_state", f"""
select case when count(*) filter (where status = 3 and {_between(1, 0)}) > 0 then 'error'
            when count(*) filter (where status = 1) > 0 then 'active' else 'idle' end as activity_state from run_log""")
def activity_state(t):
    return dashboard.activity_state(t.run_log, NOW, WINDOW)


@query("last_event", f"""
select s.source_table, case when r.status = 2 then 'SYNC_COMPLETE' else 'SYNC_RUNNING' end as operation,
       r.start_time as event_time
from run_log r join sync_task s on r.task_id = s.id where {_between(24, 0)}
order by r.start_time desc, r.id desc limit 1""")
def last_event(t):
    return dashboard.last_event(t.run_log, t.sync_task, NOW)


def _nested(name: str) -> str:
    return f"({ORACLE[name]})"


@query("overview", f"""
select r.current_rps, r.rps_trend, l.latency_ms, l.latency_status, t.total_rows_synced as today_rows_synced,
       t.duration_hours as task_duration_hours, t.throughput_mbps, t.bandwidth_pct as bandwidth_usage_pct,
       p.full_sync_progress, a.activity_state, e.source_table as last_source_table, e.operation as last_operation,
       e.event_time as last_event_time
from {_nested('rps_trend')} r, {_nested('latency_per_1k')} l, {_nested('throughput')} t, {_nested('full_progress')} p,
     {_nested('activity_state')} a left join {_nested('last_event')} e on true""")
def overview(t):
    return dashboard.overview(t.run_log, t.sync_task, NOW, DAY, WINDOW, WINDOW)


@query("perf_windows", f"""
with facts as (select time_bucket(interval 30 minute, end_time) as window_start, sum(success_count) as moved,
                      sum({MILLIS}) as ms, count(*) as runs from run_log where {_between(24, 0)} group by 1),
     frame as (select unnest(generate_series(time_bucket(interval 30 minute, timestamp '{NOW}' - interval 24 hour),
                                             timestamp '{NOW}', interval 30 minute)) as window_start)
select f.window_start, cast(coalesce(floor(moved / 1800), 0) as bigint) as rps,
       coalesce(floor(ms / runs / 1000 * 100 + 0.5) / 100, 0.0)::double as latency_s
from frame f left join facts x on f.window_start = x.window_start""")
def perf_windows(t):
    return dashboard.perf_windows(t.run_log, NOW, minutes=24 * 60, interval_seconds=1800)


@query("sync_distribution", """
with per_table as (
  select coalesce(s.source_table, 'unknown') as label, sum(r.total_count) as n
  from run_log r left join (select * from sync_task where status = 1) s on r.task_id = s.id group by 1),
ranked as (select *, row_number() over (order by n desc, label) as rk, sum(n) over () as total from per_table),
grouped as (select case when rk <= 5 then label else 'other' end as label, rk <= 5 as top, sum(n) as n, max(total) as total
            from ranked group by 1, 2)
select label, cast(floor(n * 100 / total) as int) as percent from grouped where top or n > 0""")
def sync_distribution(t):
    return dashboard.sync_distribution(t.run_log, runlog.active(t.sync_task))


@query("metric_tail", f"""
select id, end_time, {RATE} as rps,
       floor((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0::double * 100 + 0.5) / 100 as duration_s
from run_log where end_time is not null order by end_time desc, id desc limit 72""")
def metric_tail(t):
    return dashboard.metric_tail(t.run_log)
