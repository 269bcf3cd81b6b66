"""A table read as a stream in the order of its marker.

The source of the stream delivers windows ``(lo, hi]`` of the marker, one per micro-batch, and its offset is the marker reached. The rows of
a window are read by Spark's own reader, filtered and pruned as any scan, and merged like those of a file stream. Windows are planned
from the data: at the start, beyond the last one planned before, about ``rows_per_batch`` rows each. The plan is a small file
beside the stream's checkpoint, so a restart goes on behind the stored offset, with what has arrived since.
"""

from __future__ import annotations

import datetime as dt
import json
import sys
import threading
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import predicates
from tidemark.operators import ranges
from tidemark.plans.job import in_window, shape, write_changes
from tidemark.plans.state import StateTable
from tidemark.sinks.files import SmallFiles
from tidemark.sinks.versioned import VersionedTable
from tidemark.spec import SyncSpec

#: Windows that one plan holds at most; more rows make larger windows.
MAX_WINDOWS = 10_000


def _source() -> type[DataSource]:
    class Windows(SimpleDataSourceStreamReader):
        def __init__(self, start: str, cuts: list[str]):
            self.start, self.cuts = start, cuts

        def initialOffset(self) -> dict:
            return {"marker": self.start}

        def _after(self, marker: str) -> int:
            # an offset is a cut of the plan, or the marker the plan starts from
            return self.cuts.index(marker) + 1 if marker in self.cuts else 0

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            at = self._after(start["marker"])
            if at == len(self.cuts):
                return iter([]), start
            return iter([(start["marker"] or None, self.cuts[at])]), {"marker": self.cuts[at]}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            bounds = [start["marker"] or None, *self.cuts[self._after(start["marker"]):self._after(end["marker"])]]
            return iter(list(zip(bounds, bounds[1:])))

    class MarkerWindows(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_marker_windows"

        def schema(self) -> str:
            return "lo string, hi string"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Windows(self.options["start"], json.loads(self.options["cuts"]))

    return MarkerWindows


def _planned(source: DataFrame, marker: str, files: SmallFiles, done: str | None, rows_per_batch: int) -> list[str]:
    """The cuts from the window done last on: those planned before, then new ones for rows beyond them."""
    cuts: list[str] = json.loads(files.read("cuts.json") or "[]")
    if done is not None and done in cuts:
        cuts = cuts[cuts.index(done):]
    end = cuts[-1] if cuts else done
    kind = predicates.marker_type(source, marker)
    beyond = source.where(in_window(source, marker, (end, None)) if end is not None else F.col(marker).isNotNull())
    n = beyond.agg(F.count(F.lit(1))).first()[0]
    if n:
        plan = ranges.sketch_ranges(beyond, marker, min(-(-n // rows_per_batch), MAX_WINDOWS)).orderBy("batch_no")
        cuts += [r[0] for r in plan.select(predicates.stored_text(F.col("hi"), kind)).collect()]
        files.replace("cuts.json", json.dumps(cuts))
    return cuts


def start(source: DataFrame, table: VersionedTable, spec: SyncSpec, state: StateTable, progress: str, rows_per_batch: int = 100_000,
          trigger: dict | None = None, on_batch=lambda n: None) -> StreamingQuery:
    """Start the stream of a task. Every batch merges one window, last row per key by the marker and the task's order, and stores the marker
    reached. ``stop()`` on the query leaves a resume point; a batch that Spark repeats finds its own commit and does nothing.

    Rows without a marker never arrive. ``on_batch`` is told the number of batches done since the start.
    """
    spark, count = source.sparkSession, iter(range(1, sys.maxsize))
    done = state.latest(spec.task_id).last_marker
    base = source.where(predicates.all_of([spec.where]))
    cuts = _planned(base, spec.marker, SmallFiles(spark, f"{progress}-plan"), done, rows_per_batch)
    made = _source()
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    try:
        spark.dataSource.register(made)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    windows = spark.readStream.format(made.name()).options(start=done or "", cuts=json.dumps(cuts)).load()
    order = [c for c in (spec.marker, *spec.order) if c in table.schema.names]

    def write(batch: DataFrame, batch_id: int) -> None:
        tag = f"{spec.task_id}.{batch_id}"
        found = batch.collect()  # one window, or those of a repeated batch
        if found and not table.has_tag(tag):
            rows = base.where(in_window(base, spec.marker, (found[0]["lo"], found[-1]["hi"])))
            write_changes(table, shape(rows, spec, table.schema), spec, tag, guard=order)
        if found:
            state.save(spec.task_id, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), "running", found[-1]["hi"], backfilled=True)
            on_batch(next(count))

    writer = windows.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    return writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def run(source: DataFrame, table: VersionedTable, spec: SyncSpec, state: StateTable, progress: str, rows_per_batch: int = 100_000,
        max_batches: int | None = None) -> int:
    """Claim the task, process what lies beyond its stored marker, or ``max_batches`` windows of it, then stop. Returns the number of batches done."""
    enough, done = threading.Event(), [0]

    def on_batch(n: int) -> None:
        done[0] = n
        if n == max_batches:
            enough.set()

    with state.claim(spec.task_id):
        query = start(source, table, spec, state, progress, rows_per_batch, on_batch=on_batch)
        try:
            if max_batches is None:
                query.processAllAvailable()
            else:
                while query.isActive and not enough.wait(0.05) and (query.lastProgress or {}).get("numInputRows", 1) != 0:
                    pass
        finally:
            query.stop()
    if query.exception() is not None:
        raise query.exception()
    return done[0]
