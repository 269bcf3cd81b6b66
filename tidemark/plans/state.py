"""Task state: stored marker, checkpoint and the claim of the run that may change them."""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import predicates
from tidemark.sinks.files import SmallFiles

STATE_SCHEMA = ("task_id string, seq bigint, run_status string, last_marker string, completed string, "
                "gaps array<struct<lo:string,hi:string>>, updated_at string, backfilled boolean")
RUN_LOG_SCHEMA = ("id string, task_id string, task_name string, sync_mode int, status int, total_count bigint, "
                  "success_count bigint, fail_count bigint, insert_count bigint, update_count bigint, "
                  "skip_count bigint, error_msg string, start_time timestamp_ntz, end_time timestamp_ntz")


def advance(log: DataFrame) -> DataFrame:
    """Stored marker of each task after its runs: the latest end of a successful one."""
    return log.where(F.col("status") == 2).groupBy("task_id").agg(F.max("end_time").alias("last_marker"))


def replayed(df: DataFrame, marker: str, override: Any) -> DataFrame:
    """What the next run reads after the stored marker was set by hand."""
    from tidemark.functions.predicates import after
    return df.where(after(df, marker, override))


# The window of the rows that have no marker.
BACKFILL = (None, None)


@dataclass(frozen=True)
class TaskState:
    """Markers are texts of :func:`tidemark.functions.predicates.stored_text`. ``gaps`` are the windows still open, in
    order. ``backfilled``: the rows without a marker are done, or open as a window of their own."""
    seq: int = 0
    run_status: str | None = None
    last_marker: str | None = None
    completed: str | None = None
    gaps: tuple[tuple[str | None, str | None], ...] = ()
    backfilled: bool = False

    @property
    def resuming(self) -> bool:
        return bool(self.gaps)

    @property
    def backfill_done(self) -> bool:
        return self.backfilled and BACKFILL not in self.gaps


class TaskBusy(RuntimeError):
    """Another run of the task holds its claim."""


class StateTable:
    """States of tasks below one folder: a small file per task, replaced as a whole, so neither the number of files nor the cost of a
    save grows with the number of runs. Reading or saving one state starts no Spark job.

    States that are moved for many tasks at once (:meth:`advance`) are one parquet table beside the files; the higher ``seq`` counts.
    A run claims its task first: a file that only one writer can make, renewed while the run lives, void when it has expired.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = SmallFiles(spark, f"{self.path}/tasks")
        self._schema = T.StructType.fromDDL(STATE_SCHEMA)

    def _moved(self) -> DataFrame | None:
        numbers = [int(n[6:]) for n in SmallFiles(self.spark, self.path).names() if n.startswith("moved-")]
        return self.spark.read.schema(self._schema).parquet(f"{self.path}/moved-{max(numbers)}") if numbers else None

    def newest(self) -> DataFrame:
        """The state of every task as one row; ``gaps`` is NULL if no window is open."""
        rows = self.spark.createDataFrame([], self._schema)
        if any(n.endswith(".json") for n in self.files.names()):
            rows = self.spark.read.schema(self._schema).option("pathGlobFilter", "*.json").json(f"{self.path}/tasks")
        moved = self._moved()
        if moved is None:
            return rows
        newest = F.max_by(F.struct(*self._schema.names), "seq").alias("s")
        return rows.unionByName(moved).groupBy("task_id").agg(newest).select("s.*")

    def latest(self, task_id: str) -> TaskState:
        """State of one task. Its open windows are as many as the ranges of one run, a number the run bounds."""
        text = self.files.read(_file(task_id))
        found = json.loads(text) if text else {"seq": 0}
        moved = self._moved()
        if moved is not None:
            row = moved.where((F.col("task_id") == task_id) & (F.col("seq") > found["seq"])).first()
            found = row.asDict(recursive=True) if row else found
        gaps = tuple((g.get("lo"), g.get("hi")) for g in found.get("gaps") or ())
        return TaskState(found["seq"], found.get("run_status"), found.get("last_marker"), found.get("completed"), gaps, bool(found.get("backfilled")))

    def save(self, task_id: str, now: Any, run_status: str, last_marker: Any, gaps: Sequence[tuple[str | None, str | None]] = (),
             completed: str | None = None, backfilled: bool = False, seq: int | None = None) -> int:
        """Replace the state and return its number. Without ``gaps`` the checkpoint is cleared: marker and checkpoint change together.
        ``seq`` is the number of the state before, if the caller holds the claim and knows it."""
        seq = (self.latest(task_id).seq if seq is None else seq) + 1
        state = {"task_id": task_id, "seq": seq, "run_status": run_status, "last_marker": None if last_marker is None else _text(last_marker),
                 "completed": completed if gaps else None, "gaps": [{"lo": lo, "hi": hi} for lo, hi in gaps] or None,
                 "updated_at": str(now), "backfilled": backfilled}
        self.files.replace(_file(task_id), json.dumps(state))
        return seq

    def advance(self, reached: DataFrame, now: Any) -> None:
        """Move the stored markers of all tasks of ``reached`` (task_id, last_marker) forward. A task with open windows keeps its marker,
        and no marker goes back. One table with a row per task replaces the one before."""
        kind = predicates.marker_type(reached, "last_marker")
        old, new = self.newest().alias("o"), reached.where(F.col("last_marker").isNotNull()).alias("n")
        text, micros = F.col("o.last_marker"), isinstance(kind, T.TimestampType)
        stored = F.timestamp_micros(text.cast("bigint")) if micros else text.cast(kind)
        ahead = F.col("o.gaps").isNull() & (stored.isNull() | (F.col("n.last_marker") > stored))
        moved = new.join(old, "task_id", "left").where(ahead).select(
            "task_id", (F.coalesce("o.seq", F.lit(0)) + 1).cast("bigint").alias("seq"), F.lit("stopped").alias("run_status"),
            predicates.stored_text(F.col("n.last_marker"), kind).alias("last_marker"), F.lit(None).cast("string").alias("completed"),
            F.lit(None).cast(self._schema["gaps"].dataType).alias("gaps"), F.lit(str(now)).alias("updated_at"),
            F.coalesce("o.backfilled", F.lit(False)).alias("backfilled"))
        before, folder = self._moved(), SmallFiles(self.spark, self.path)
        if before is not None:
            newest = F.max_by(F.struct(*self._schema.names), "seq").alias("s")
            moved = before.unionByName(moved).groupBy("task_id").agg(newest).select("s.*")
        numbers = [int(n[6:]) for n in folder.names() if n.startswith("moved-")]
        draft = f".moved-{uuid.uuid4().hex}"
        moved.write.parquet(f"{self.path}/{draft}")
        if not folder._rename(draft, f"moved-{max(numbers, default=0) + 1}", False):
            folder.take(draft)
            raise TaskBusy(f"another writer moved the markers below {self.path}")
        for n in numbers[:-1]:  # the one before stays for those who read it
            folder.take(f"moved-{n}")

    def stop(self, task_id: str, now: Any) -> None:
        """Stopping gives up the checkpoint; pausing just leaves it."""
        saved = self.latest(task_id)
        self.save(task_id, now, "stopped", saved.last_marker, backfilled=saved.backfill_done)

    def override_marker(self, task_id: str, now: Any, marker: Any) -> None:
        """Set the stored marker by hand. A time with a zone is that instant; other values are read in the marker's type."""
        self.save(task_id, now, "stopped", marker, backfilled=self.latest(task_id).backfill_done)

    @contextmanager
    def claim(self, task_id: str, seconds: float = 600) -> Iterator[Claim]:
        """Hold the task for one run; TaskBusy if another run holds it. A claim not renewed for ``seconds`` is void."""
        claim = Claim(self.files, _file(task_id, "claim"), seconds)
        claim.acquire()
        try:
            yield claim
        finally:
            claim.release()


class Claim:
    """A file with its owner and the time it ends, renewed by a thread of its own while it is held."""

    def __init__(self, files: SmallFiles, name: str, seconds: float):
        self.files, self.name, self.seconds, self.owner = files, name, seconds, uuid.uuid4().hex
        self._end, self._renewing = threading.Event(), None

    def _text(self) -> str:
        return json.dumps({"owner": self.owner, "until": time.time() + self.seconds})

    def acquire(self) -> None:
        for _ in range(3):
            if self.files.create(self.name, self._text()):
                self._renewing = threading.Thread(target=self._renew, daemon=True)
                self._renewing.start()
                return
            held = self.files.read(self.name)
            if held is not None and json.loads(held)["until"] > time.time():
                break
            if held is not None and self.files.read(self.name) == held:
                self.files.take(self.name)  # it has expired; one of those who see that removes it
        raise TaskBusy(f"{self.name} is held by another run")

    def held(self) -> bool:
        text = self.files.read(self.name)
        return text is not None and json.loads(text)["owner"] == self.owner

    def check(self) -> None:
        if not self.held():
            raise TaskBusy(f"{self.name} was lost to another run")

    def _renew(self) -> None:
        while not self._end.wait(self.seconds / 3):
            if not self.held():
                return
            self.files.replace(self.name, self._text())

    def release(self) -> None:
        self._end.set()
        if self._renewing is not None:
            self._renewing.join()
        if self.held():
            self.files.take(self.name)


def _file(task_id: str, ending: str = "json") -> str:
    return f"task-{quote(task_id, safe='')}.{ending}"


def _text(marker: Any) -> str:
    if isinstance(marker, dt.datetime) and marker.tzinfo is not None:
        return str((marker - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1))
    return str(marker)
