"""Continuous upsert: every micro-batch is de-duplicated and merged into a versioned table.

Spark keeps the read position in the query's checkpoint folder, which takes the place of marker and gap list. A batch that
Spark repeats after a crash finds its own commit and does nothing, so every batch takes effect once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.job import shape, write_changes
from tidemark.sinks.versioned import VersionedTable
from tidemark.spec import SyncSpec


def target(spark: SparkSession, path: str, schema: T.StructType, keys: Iterable[str], buckets: int = 64) -> VersionedTable:
    return VersionedTable(spark, path, schema, keys, buckets)


def read_files(spark: SparkSession, folder: str, pattern: str, schema: T.StructType,
               files_per_batch: int | None = None) -> DataFrame:
    """Files arriving in a folder as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def batch_writer(table: VersionedTable, order: Sequence[str], stream_name: str = "stream"):
    """The ``foreachBatch`` function: last row per key, then upsert, unless this batch is already committed. A row that
    is older than the one in the table, by those of the ``order`` columns that the table has, changes nothing."""
    spec = SyncSpec(stream_name, keys=table.keys, order=tuple(order))

    def write(rows: DataFrame, batch_id: int) -> None:
        tag = f"{stream_name}.{batch_id}"
        if table.has_tag(tag):
            return
        write_changes(table, shape(rows, spec, table.schema), spec, tag, guard=order)

    return write


def start(source: DataFrame, table: VersionedTable, order: Sequence[str], progress: str,
          stream_name: str = "stream", trigger: dict | None = None) -> StreamingQuery:
    """Start the query; ``stop()`` on it leaves a resume point in ``progress``."""
    writer = source.writeStream.foreachBatch(batch_writer(table, order, stream_name))
    return writer.option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start()


def run_available(source: DataFrame, table: VersionedTable, order: Sequence[str], progress: str,
                  stream_name: str = "stream") -> None:
    """Process everything that has arrived, then return."""
    start(source, table, order, progress, stream_name).awaitTermination()
