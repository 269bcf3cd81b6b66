"""Synchronisation jobs: select the increment, map, coerce, de-duplicate, merge, advance the state."""

from __future__ import annotations

import dataclasses
import datetime as dt
import functools
import operator
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tidemark.functions import coerce, predicates
from tidemark.operators import merge, ranges
from tidemark.operators.mapping import apply_mapping, known_columns
from tidemark.operators.runlog import close_resumed, latest_running
from tidemark.operators.sizing import BROADCAST_LIMIT_BYTES, row_bytes
from tidemark.plans.state import BACKFILL, RUN_LOG_SCHEMA, StateTable
from tidemark.session import written
from tidemark.sinks.versioned import VersionedTable
from tidemark.spec import MappedField, RunStatus, SyncMode, SyncSpec


def shape(rows: DataFrame, spec: SyncSpec, target: T.StructType) -> DataFrame:
    """Rows in the target's names and types, plus ``_bad`` (a value does not convert or a key is NULL) and, for
    ordering, ``_marker``, which need not be a target column."""
    mapping, wanted = list(spec.mapping), T.StructType(list(target.fields))
    if spec.marker:
        rows = rows.withColumn("_marker", F.col(spec.marker))
        wanted = wanted.add("_marker", rows.schema["_marker"].dataType)
        mapping += [MappedField("_marker", "_marker")] if mapping else []
    mapped = known_columns(apply_mapping(rows, mapping), wanted)
    converted = coerce.columns(mapped, wanted)
    by_name = {name.lower(): c for name, c in converted.items()}
    bad = functools.reduce(operator.or_, [by_name[k.lower()].isNull() for k in spec.keys],
                           coerce.any_reject(mapped, wanted))
    return mapped.select(*[c.alias(name) for name, c in converted.items()], bad.alias("_bad"))


def good(shaped: DataFrame) -> DataFrame:
    return shaped.where(~F.col("_bad")).drop("_bad")


def deduplicate(shaped: DataFrame, spec: SyncSpec) -> DataFrame:
    """The last good row per key by marker and the task's tie-break columns; bad rows all stay, so that they can be
    counted without reading the source again."""
    if spec.mode == SyncMode.INSERT_ONLY or not spec.keys:
        return shaped.drop("_marker")
    order = [*(["_marker"] if spec.marker else []), *spec.order] or merge.default_order(shaped.drop("_bad"), spec.keys)
    # every bad row is its own group; a NULL key with many rows is spread, too
    alone = shaped.withColumn("_alone", F.when(F.col("_bad"), F.monotonically_increasing_id()))
    return merge.last_wins(alone, [*spec.keys, "_alone"], order).drop("_alone", "_marker")


@dataclass
class RunResult:
    status: str
    total: int = 0
    read: int = 0
    inserted: int = 0
    updated: int = 0
    unchanged: int = 0
    rejected: int = 0
    open_ranges: int = 0


def _counted(shaped: DataFrame, spec: SyncSpec) -> tuple[DataFrame, Observation]:
    """The good rows, and an observation that counts them and the rejected ones while they are written."""
    seen = Observation()
    rows = deduplicate(shaped, spec).observe(seen, F.count_if(F.col("_bad")).alias("bad"), F.count_if(~F.col("_bad")).alias("n"))
    return good(rows), seen


def write_changes(table: VersionedTable, shaped: DataFrame, spec: SyncSpec, tag: str, guard: Sequence[str] = ()) -> RunResult:
    """Apply shaped rows to the table and count what changed.

    Rows that become the whole table, and plain inserts, are written and counted in one pass. A merge writes its
    de-duplicated rows once and classifies them against the buckets holding one of their keys. Buckets with an update are
    rewritten, the others only get the new rows added. The lists of buckets have at most as many elements as the
    table has buckets. With ``guard`` a row updates only target rows that are not beyond it in these columns.
    """
    base = table.current()
    if spec.mode == SyncMode.INSERT_ONLY or spec.mode == SyncMode.CLEAN_INSERT or base == 0:
        rows, seen = _counted(shaped, spec)
        if spec.mode == SyncMode.INSERT_ONLY:
            table.change(None, rows, tag, base)
        else:
            table.write(rows, tag, base)
        n = seen.get
        return RunResult("success", read=n["n"], inserted=n["n"], rejected=n["bad"])
    kept, fine, facts = deduplicate(shaped, spec), ~F.col("_bad"), Observation()
    kept = kept.withColumn("_b", table.bucket(kept)).observe(
        facts, F.count_if(F.col("_bad")).alias("bad"), F.count_if(fine).alias("n"), F.sum(F.when(fine, row_bytes(kept))).alias("bytes"),
        F.collect_set(F.when(fine, F.col("_b"))).alias("buckets"))
    with written(kept) as rows:
        return _merge(table, rows, facts.get, spec, tag, base, guard)


def _merge(table: VersionedTable, kept: DataFrame, facts: dict, spec: SyncSpec, tag: str, base: int, guard: Sequence[str]) -> RunResult:
    rows = good(kept).drop("_b")
    out = RunResult("success", read=facts["n"], rejected=facts["bad"])
    if out.read == 0:
        return out
    small, seen = facts["bytes"] <= BROADCAST_LIMIT_BYTES, Observation()
    if not small and not spec.no_update and len(rows.columns) > len(spec.keys):
        return _merge_large(table, rows, facts["buckets"], spec, tag, base, guard, out)
    classified = merge.classify(table.read(facts["buckets"], base), rows, spec.keys, small, guard)
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("insert", "update", "unchanged", "stale")]
    classified = classified.withColumn("_b", table.bucket(rows)).observe(
        seen, *kinds, F.collect_set(F.when(F.col("kind") == "update", F.col("_b"))).alias("updated"))
    with written(classified) as changes:
        counts = seen.get
        out.inserted, out.updated, out.unchanged = counts["insert"], counts["update"], counts["unchanged"] + counts["stale"]
        rewritten = [] if spec.no_update else counts["updated"]
        if spec.no_update:
            out.unchanged, out.updated = out.unchanged + out.updated, 0
        replaced = added = None
        if rewritten:
            inside = changes.where(F.col("_b").isin(rewritten)).drop("_b")
            replaced = merge.apply_classified(table.read(rewritten, base), inside, spec.keys, small)
        if out.inserted:
            added = changes.where((F.col("kind") == "insert") & ~F.col("_b").isin(rewritten)).drop("kind", "_b")
            added = merge.replace(table.read([]), added)
        if replaced is not None or added is not None:
            table.change(replaced, added, tag, base)
    return out


def _merge_large(table: VersionedTable, rows: DataFrame, buckets: list[int], spec: SyncSpec, tag: str, base: int, guard: Sequence[str],
                 out: RunResult) -> RunResult:
    """Many rows update most buckets they touch: source and touched buckets are shuffled once, compared and written in the same pass. Which buckets
    had no update is known at its end; their old rows stay where they were."""
    target, seen = table.read(buckets, base), Observation()
    slices = max(1, 4 * int(table.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(buckets)))
    # rows without a full key meet nothing: any place will do, so they are spread by their plain columns
    plain = [f.name for f in target.schema if isinstance(f.dataType, (T.AtomicType, T.NullType))]
    place = F.when(merge.has_key(spec.keys), F.hash(*spec.keys)).otherwise(F.hash(*plain))
    marked = merge.merge_marked(target, rows, spec.keys, [table.bucket(target).alias("_bucket"), F.pmod(place, F.lit(slices)).alias("_slice")], guard)
    source = ~F.col("_old")
    kinds = [F.count_if(source & (F.col("kind") == k)).alias(k) for k in ("insert", "update", "unchanged", "stale")]
    marked = marked.observe(seen, *kinds, F.collect_set(F.when(source & (F.col("kind") == "update"), F.col("_bucket"))).alias("updated"))
    left = marked.where(F.col("_old") | (F.col("kind") == "insert")).withColumn("_how", F.when(F.col("_old"), "replace").otherwise("add"))
    table.overlay(left.drop("_old", "_slice", "kind"), lambda: seen.get["updated"], tag, base)
    counts = seen.get
    out.inserted, out.updated, out.unchanged = counts["insert"], counts["update"], counts["unchanged"] + counts["stale"]
    return out


Bounds = tuple[str | None, str | None]


def _bound(text: str | None) -> predicates.Stored | None:
    return None if text is None else predicates.Stored(text)


def in_window(source: DataFrame, marker: str, window: Bounds) -> Column:
    """Rows of one window ``(lo, hi]`` of stored markers; rows without a marker are a window of their own."""
    if window == BACKFILL:
        return predicates.missing(marker)
    lo, hi = map(_bound, window)
    return predicates.all_of([F.col(marker).isNotNull(), predicates.after(source, marker, lo) if lo else None,
                              predicates.up_to(source, marker, hi) if hi else None])


def _windows(source: DataFrame, marker: str, lo: str | None, hi: str, n_rows: int, parts: int) -> list[Bounds]:
    """At most about ``parts`` equally loaded windows between two markers; the bounds become text inside Spark."""
    if parts <= 1 or not n_rows:
        return [(lo, hi)]
    kind = predicates.marker_type(source, marker)
    inside = source.where(in_window(source, marker, (lo, hi)))
    plan = ranges.sketch_ranges(inside, marker, min(parts, n_rows)).orderBy("batch_no")
    cuts = [r["hi"] for r in plan.select("batch_no", predicates.stored_text(F.col("hi"), kind).alias("hi")).collect()]
    return list(zip([lo, *cuts[:-1]], cuts))


_RUNNING: dict[tuple[str, str], tuple[str, threading.Event]] = {}


@contextmanager
def _interruptible(spark: SparkSession, task_id: str) -> Iterator[threading.Event]:
    """The jobs of a run carry a tag, under which another thread of this application finds them."""
    tag, asked = f"tidemark-{uuid.uuid4().hex}", threading.Event()
    key = (spark.sparkContext.applicationId, task_id)
    _RUNNING[key] = tag, asked
    spark.sparkContext.addJobTag(tag)
    try:
        yield asked
    finally:
        spark.sparkContext.removeJobTag(tag)
        if _RUNNING.get(key, (None,))[0] == tag:
            del _RUNNING[key]


def interrupt(spark: SparkSession, task_id: str) -> bool:
    """Break off the run of a task in the middle of its window; False if this application runs none. The window stays open in the task's
    state: the next run takes it up, :meth:`StateTable.stop` gives it up."""
    tag, asked = _RUNNING.get((spark.sparkContext.applicationId, task_id), (None, None))
    if tag is None:
        return False
    asked.set()
    spark.sparkContext.cancelJobsWithTag(tag)
    return True


def run_sync(source: DataFrame, table: VersionedTable, spec: SyncSpec, state: StateTable, now: dt.datetime | None = None,
             log_path: str | None = None, parts: int = 1, should_stop: Callable[[], bool] = lambda: False,
             on_progress: Callable[[RunResult], None] = lambda result: None, claim_seconds: float = 600) -> RunResult:
    """One run of a task, which is claimed first: of two runs of a task the second fails with TaskBusy and changes nothing. With ``parts`` > 1 the marker axis is processed in that many windows, each committed on
    its own. Rows without a marker are one window more, read in the first run only. After each window the ones still
    open are saved, so a failed, paused or killed run is taken up where it was: saved windows stay as they are, and what
    has come beyond them is cut into ``parts``, too.

    ``should_stop`` is asked before every window, ``on_progress`` is told the figures after it. :func:`interrupt` breaks off the window that
    is running: it is left open and taken up by the next run, or given up, as any other.

    Inserts without key check are not repeatable, so an insert-only run is one commit whose intent is saved first: if
    its commit succeeded but the state was lost, the next run finds the commit and goes on behind it.
    """
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    with state.claim(spec.task_id, claim_seconds) as claim, _interruptible(source.sparkSession, spec.task_id) as asked:
        return _run(source, table, spec, state, now, log_path, parts, should_stop, on_progress, claim, asked)


def _run(source, table, spec, state, now, log_path, parts, should_stop, on_progress, claim, asked) -> RunResult:
    spark = source.sparkSession
    base = source.where(predicates.all_of([spec.where]))
    saved = state.latest(spec.task_id)
    seq = saved.seq
    uses_marker = spec.marker is not None and spec.mode != SyncMode.CLEAN_INSERT
    inserting = spec.mode == SyncMode.INSERT_ONLY
    last, backfilled = (saved.last_marker if uses_marker else None), saved.backfill_done
    if inserting and saved.resuming and table.has_tag(_insert_tag(spec, saved.seq)):
        last, backfilled = saved.completed or last, True
    result, open_windows, end = RunResult("success"), [], last
    run = uuid.uuid4().hex
    tag = f"run.{run[:12]}"
    if log_path:
        close_interrupted(spark, log_path, spec.task_id, now)
        append_run_log(spark, log_path, run, spec, dataclasses.replace(result, status="running"), now)

    def apply(rows: DataFrame, tag: str = tag) -> None:
        step = write_changes(table, shape(rows, spec, table.schema), spec, tag)
        for name in ("read", "inserted", "updated", "unchanged", "rejected"):
            setattr(result, name, getattr(result, name) + getattr(step, name))
        on_progress(dataclasses.replace(result))

    def save(*facts, **more) -> int:
        nonlocal seq
        claim.check()
        seq = state.save(spec.task_id, now, *facts, seq=seq, **more)
        return seq

    def save_open(status: str) -> None:
        reach = next((hi for _, hi in reversed(open_windows) if hi is not None), end)
        save(status, saved.last_marker, open_windows, reach, True)

    error = None
    try:
        if not uses_marker:
            apply(base)
        else:
            kind = predicates.marker_type(base, spec.marker)
            beyond = in_window(base, spec.marker, (last, None)) if last is not None else F.col(spec.marker).isNotNull()
            facts = base.where(beyond if backfilled else beyond | predicates.missing(spec.marker)).agg(
                F.count("*").alias("n"), F.count(spec.marker).alias("marked"),
                predicates.stored_text(F.max(spec.marker), kind).alias("end")).first()
            result.total, end = facts["n"], facts["end"] or last
            backfill = [BACKFILL] if not backfilled and facts["n"] > facts["marked"] else []
            if inserting:
                if facts["n"]:
                    intent = backfill + ([(last, end)] if facts["marked"] else [])
                    number = save("running", saved.last_marker, intent, end, True)
                    chosen = [in_window(base, spec.marker, w) for w in intent]
                    apply(base.where(functools.reduce(operator.or_, chosen)), _insert_tag(spec, number))
            elif saved.resuming and not spec.no_update:
                open_windows = list(saved.gaps)
                tail = base.where(in_window(base, spec.marker, (saved.completed, None))) if saved.completed else base.where(F.col(spec.marker).isNotNull())
                n = tail.count() if end != saved.completed else 0
                if n:
                    open_windows += _windows(tail, spec.marker, saved.completed, end, n, parts)
            else:
                open_windows = backfill + (_windows(base, spec.marker, last, end, facts["marked"], parts) if facts["marked"] else [])
            while open_windows:
                if should_stop() or asked.is_set():
                    result.status = "paused"
                    break
                apply(base.where(in_window(base, spec.marker, open_windows[0])))
                open_windows.pop(0)
                if open_windows:
                    save_open("running")
    except Exception as e:
        if asked.is_set() and uses_marker and not inserting:  # broken off on request: what was running stays open
            result.status = "paused"
        else:  # the run is recorded as failed, then the error goes on to the caller
            result.status, error = "failed", e

    result.open_ranges = len(open_windows)
    if open_windows:
        save_open(result.status)
    elif result.status == "success":
        save("stopped", end if end is not None else saved.last_marker, backfilled=uses_marker or backfilled)
    if log_path:
        append_run_log(spark, log_path, run, spec, result, now, error)
    if error is not None:
        raise error
    return result


def _insert_tag(spec: SyncSpec, seq: int) -> str:
    return f"insert/{spec.task_id}.{seq}"


def run_tables(jobs: Mapping[str, tuple[DataFrame, VersionedTable, SyncSpec]], state: StateTable, now: dt.datetime | None = None,
               log_path: str | None = None, parts: int = 1, at_once: int = 4) -> dict[str, RunResult | Exception]:
    """One run per mapping item, ``at_once`` of them side by side. An item that fails is reported and the others still run.

    Each item has a thread with the caller's job properties and a scheduler pool of its own, so that under a fair scheduler a small
    item does not wait for the tasks of a large one.
    """
    if not jobs:
        return {}
    spark = next(iter(jobs.values()))[0].sparkSession

    def run(name: str) -> RunResult | Exception:
        source, table, spec = jobs[name]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sync-{name}")
        try:
            return run_sync(source, table, spec, state, now, log_path, parts)
        except Exception as e:
            return e

    with ThreadPoolExecutor(min(at_once, len(jobs))) as pool:
        # one wrapper per item: it carries the caller's properties into the thread
        waiting = {name: pool.submit(inheritable_thread_target(spark)(run), name) for name in jobs}
        return {name: w.result() for name, w in waiting.items()}


def read_run_log(spark: SparkSession, path: str, task_id: str | None = None) -> DataFrame:
    """The run log, or that of one task (only its folder is read), with one row per run: a run is written when it starts and again
    when it ends, and its end counts."""
    newest = Window.partitionBy("id").orderBy(F.col("end_time").desc_nulls_last(), F.col("total_count").desc())
    rows = spark.read.schema(RUN_LOG_SCHEMA).parquet(path)
    rows = rows if task_id is None else rows.where(F.col("task_id") == task_id)
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def close_interrupted(spark: SparkSession, path: str, task_id: str, now: dt.datetime) -> None:
    """Runs of the task that were left open (paused or killed) get their end row."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return
    mine = read_run_log(spark, path, task_id)
    task = spark.createDataFrame([(task_id,)], "task_id string")
    closed = close_resumed(mine, task, now).join(latest_running(mine).select("id"), "id", "left_semi")
    with written(closed.select(*T.StructType.fromDDL(RUN_LOG_SCHEMA).names)) as rows:
        if not rows.isEmpty():
            rows.coalesce(1).write.mode("append").partitionBy("task_id").parquet(path)


def append_run_log(spark, path: str, run: str, spec: SyncSpec, result: RunResult, now: dt.datetime,
                   error: Exception | None = None) -> None:
    status = {"success": RunStatus.SUCCESS, "failed": RunStatus.FAILED}.get(result.status, RunStatus.RUNNING)
    message = None if error is None else str(error)
    done = result.inserted + result.updated + result.unchanged
    ended = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = (run, spec.task_id, spec.task_name, int(spec.mode), int(status), result.read + result.rejected, done,
           result.rejected, result.inserted, result.updated, result.unchanged, message, now,
           ended if status != RunStatus.RUNNING else None)
    spark.createDataFrame([row], RUN_LOG_SCHEMA).coalesce(1).write.mode("append").partitionBy("task_id").parquet(path)
