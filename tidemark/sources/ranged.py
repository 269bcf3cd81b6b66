"""A parquet table read by marker ranges: one partition per planned range, and ranges a filter excludes are not read."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from tidemark.functions import predicates
from tidemark.operators import ranges


def _source() -> type[DataSource]:
    class Range(InputPartition):
        def __init__(self, lo: str | None, hi: str | None, unmarked: bool = False):
            self.lo, self.hi, self.unmarked = lo, hi, unmarked

    class Reader(DataSourceReader):
        def __init__(self, schema: T.StructType, options: dict):
            self.columns, self.path, self.marker = schema.names, options["path"], options["marker"]
            self.cuts, self.tests = json.loads(options["cuts"]), []

        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            """Filters on the marker choose ranges. All are returned: inside a range Spark still applies them."""
            for f in filters:
                if getattr(f, "attribute", None) == (self.marker,):
                    self.tests.append((type(f).__name__, getattr(f, "value", None)))
            return filters

        def _dataset(self):
            import pyarrow.dataset as ds
            from pyarrow import fs

            path = self.path if "://" in self.path or not self.path.startswith("file:") else "file://" + self.path[5:]
            store, inside = fs.FileSystem.from_uri(path)
            return ds.dataset(inside, filesystem=store, format="parquet")

        def _bounds(self, part: Range, kind):
            import pyarrow as pa

            def value(text: str | None):
                if text is None:
                    return None
                if pa.types.is_timestamp(kind) and text.lstrip("-").isdigit():
                    return pa.scalar(int(text), pa.int64()).cast(pa.timestamp("us", kind.tz))
                return pa.scalar(text).cast(pa.timestamp("us") if pa.types.is_timestamp(kind) else kind)

            return value(part.lo), value(part.hi)

        def partitions(self) -> Sequence[InputPartition]:
            import pyarrow as pa

            bounds = [None, *self.cuts]
            every = [Range(None, None, True), *(Range(lo, hi) for lo, hi in zip(bounds, bounds[1:])), Range(bounds[-1], None)]
            if not self.tests:
                return every
            kind = self._dataset().schema.field(self.marker).type

            def wanted(part: Range) -> bool:
                if part.unmarked:
                    return all(name == "IsNull" for name, _ in self.tests)
                lo, hi = (None if v is None else v.as_py() for v in self._bounds(part, kind))
                for name, v in self.tests:
                    if name == "IsNull":
                        return False
                    if name in ("GreaterThan", "GreaterThanOrEqual", "EqualTo") and hi is not None and (v > hi or v == hi and name == "GreaterThan"):
                        return False
                    if name in ("LessThan", "LessThanOrEqual", "EqualTo") and lo is not None and v <= lo:
                        return False
                return True

            return [p for p in every if wanted(p)] or [Range(None, None, True)]

        def read(self, part: Range) -> Iterator:
            import pyarrow.dataset as ds

            data = self._dataset()
            field = ds.field(self.marker)
            lo, hi = self._bounds(part, data.schema.field(self.marker).type)
            if part.unmarked:
                keep = field.is_null()
            else:
                keep = field.is_valid()
                keep = keep if lo is None else keep & (field > lo)
                keep = keep if hi is None else keep & (field <= hi)
            # row groups outside the range are skipped by their statistics; batches are bounded
            yield from data.to_batches(columns=self.columns, filter=keep, batch_size=8192)

    class RangedParquet(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_ranges"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(schema, dict(self.options))

    return RangedParquet


def read_by_ranges(spark: SparkSession, path: str, marker: str, parts: int) -> DataFrame:
    """The table at ``path`` with a partition for each of at most ``parts`` planned ranges ``(lo, hi]`` of its marker, one for what lies behind
    the last and one for rows without a marker.

    The plan comes from a sketch of the marker. A filter on the marker reaches the source, which then plans the ranges it can hold in only.
    Tasks read through Arrow, so the store must be one that Arrow knows. Turns on filter pushdown for Python sources in the session.
    """
    table = spark.read.parquet(path)
    kind = predicates.marker_type(table, marker)
    plan = ranges.sketch_ranges(table, marker, parts).orderBy("batch_no")
    cuts = [r[0] for r in plan.select(predicates.stored_text(F.col("hi"), kind)).collect()]
    made = _source()
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    try:
        spark.dataSource.register(made)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    where = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return spark.read.format(made.name()).schema(table.schema).options(path=where, marker=marker, cuts=json.dumps(cuts)).load()
