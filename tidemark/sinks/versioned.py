"""A keyed parquet table that is replaced, partly rewritten or extended in atomic versions.

Layout: data folders ``<path>/data-<id>/_how=<replace|add>/_bucket=<k>/*.parquet``, and one small file per version,
``<path>/_versions/<number>.json``, that names the live folders of every bucket. A key always falls into the same bucket. A change
replaces the buckets holding an update and adds folders to buckets that only receive new rows; all others are taken over by
reference. A version exists once its file has its name, which only one writer can give it: a second writer that began
from the same version fails and changes nothing. Reading lists one folder and opens one file, however old the table is.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ConcurrentChange(RuntimeError):
    """Another writer has committed the version that this change would have made."""


class VersionedTable:
    """``buckets`` counts for a new table only: an existing one keeps its own until :meth:`rebucket`, and its keys and key types must be the same."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Iterable[str], buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.buckets = tuple(keys), buckets
        self.manifest()

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list:
        path, fs = self._fs(name)
        return list(fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of the committed versions, oldest first."""
        names = [s.getPath().getName() for s in self._list("_versions")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def current(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What a version consists of; checked against the keys this table was opened with."""
        version = self.current() if version is None else version
        if not version:
            return {"folders": {}, "tags": {}}
        path, fs = self._fs(f"_versions/{version:010d}.json")
        stream = fs.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if found["keys"] != self._keys():
            raise ValueError(f"the table at {self.path} has the keys {found['keys']}, not {self._keys()}")
        self.buckets = found["buckets"]
        return found

    def _keys(self) -> list[list[str]]:
        types = {f.name: f.dataType.simpleString() for f in self.schema}
        return [[k, types[k]] for k in self.keys]

    @staticmethod
    def _family(tag: str) -> str:
        return tag.rsplit(".", 1)[0]

    def has_tag(self, tag: str) -> bool:
        """Whether the newest change of this tag's family (the text before the last dot) is the one with this tag."""
        return self.manifest()["tags"].get(self._family(tag)) == tag

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or only some of its buckets (the files of the others are not listed)."""
        folders = self.manifest(version)["folders"]
        wanted = folders.keys() if buckets is None else {str(b) for b in buckets}
        chosen = [f"{self.path}/{p}" for b, paths in folders.items() if b in wanted for p in paths]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def bucket(self, df: DataFrame) -> Column:
        types = {f.name: f.dataType for f in self.schema}
        return F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets the keys of ``rows`` fall into: at most ``buckets`` integers reach the driver."""
        return sorted(rows.agg(F.collect_set(self.bucket(rows))).first()[0])

    def _placed(self, df: DataFrame, how: str) -> DataFrame:
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        return rows.withColumns({"_how": F.lit(how), "_bucket": self.bucket(df)}).hint("rebalance", "_bucket")

    def _commit(self, rows: DataFrame, whole: bool, tag: str, base: int | None, buckets: int | None = None) -> int:
        base = self.current() if base is None else base
        old = self.manifest(base)
        data = f"data-{uuid.uuid4().hex}"
        rows.write.partitionBy("_how", "_bucket").parquet(f"{self.path}/{data}")
        folders = {} if whole else dict(old["folders"])
        for how in ("replace", "add"):
            for status in self._list(f"{data}/_how={how}"):
                name = status.getPath().getName()
                bucket, folder = name.partition("=")[2], f"{data}/_how={how}/{name}"
                folders[bucket] = [folder] if how == "replace" else [*folders.get(bucket, []), folder]
        self._publish(base + 1, {"keys": self._keys(), "buckets": buckets or self.buckets, "tag": tag,
                                 "tags": {**old["tags"], self._family(tag): tag}, "folders": folders})
        return base + 1

    def _publish(self, number: int, manifest: dict) -> None:
        """Write the version's file under another name, then rename it, which fails if the name is taken."""
        jvm = self.spark._jvm
        draft, fs = self._fs(f"_versions/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        final, _ = self._fs(f"_versions/{number:010d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(draft), context.makeQualified(final), options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise ConcurrentChange(f"version {number} of {self.path} exists") from None
            raise

    def write(self, df: DataFrame, tag: str = "run", base: int | None = None) -> int:
        """Commit ``df`` as the whole table on top of version ``base`` (default: the newest). Rows are gathered by bucket;
        adaptive execution splits large buckets and joins small ones."""
        return self._commit(self._placed(df, "replace"), True, tag, base)

    def change(self, replaced: DataFrame | None, added: DataFrame | None, tag: str = "run", base: int | None = None) -> int:
        """Commit a change: ``replaced`` holds all rows of every bucket it contains, ``added`` new rows for other buckets."""
        parts = [self._placed(df, how) for df, how in ((replaced, "replace"), (added, "add")) if df is not None]
        return self._commit(functools.reduce(DataFrame.unionByName, parts), False, tag, base)

    def overlay(self, rows: DataFrame, updated: Callable[[], Iterable[int]], tag: str = "run", base: int | None = None) -> int:
        """Commit ``rows`` that have ``_bucket`` and ``_how``: 'replace' for all rows a bucket had, as they are now, 'add' for new ones.

        Only the buckets that ``updated`` names when all is written are replaced. The others keep their folders, and what was written of
        their old rows is deleted. Without any change there is no new version.
        """
        base = self.current() if base is None else base
        old = self.manifest(base)
        data, replaced, folders = f"data-{uuid.uuid4().hex}", set(), dict(old["folders"])
        rows.write.partitionBy("_how", "_bucket").parquet(f"{self.path}/{data}")
        wanted = {str(b) for b in updated()}
        for how in ("replace", "add"):
            for status in self._list(f"{data}/_how={how}"):
                name = status.getPath().getName()
                bucket, folder = name.partition("=")[2], f"{data}/_how={how}/{name}"
                if how == "add":
                    folders[bucket] = [*folders.get(bucket, []), folder]
                elif bucket in wanted:
                    folders[bucket] = [folder]
                    replaced.add(bucket)
                else:
                    path, fs = self._fs(folder)
                    fs.delete(path, True)
        if wanted - replaced:
            raise ValueError(f"updated buckets without rows: {sorted(wanted - replaced)}")
        if folders == old["folders"]:
            path, fs = self._fs(data)
            fs.delete(path, True)
            return base
        self._publish(base + 1, {"keys": self._keys(), "buckets": self.buckets, "tag": tag,
                                 "tags": {**old["tags"], self._family(tag): tag}, "folders": folders})
        return base + 1

    def compact(self, folders: int = 1) -> int:
        """Rewrite the buckets that lie in more than ``folders`` folders."""
        base = self.current()
        many = [int(b) for b, paths in self.manifest(base)["folders"].items() if len(paths) > folders]
        return self.change(self.read(many, base), None, "compact", base) if many else base

    def size(self) -> int:
        """Bytes of the newest version's files."""
        folders = {p for paths in self.manifest()["folders"].values() for p in paths}
        return sum(s.getLen() for p in folders for s in self._list(p))

    def rebucket(self, buckets: int | None = None, bucket_bytes: int = 256 << 20) -> int:
        """Rewrite the table with another number of buckets, by default as many as make them about ``bucket_bytes`` large. A change rewrites
        whole buckets, so a table that has grown is given more. A writer that began before fails, as after any other commit."""
        base = self.current()
        buckets = buckets or max(1, -(-self.size() // bucket_bytes))
        rows = self.read(version=base)
        if buckets == self.buckets or not base:
            return base
        number = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(buckets)).cast("int")
        placed = rows.withColumns({"_how": F.lit("replace"), "_bucket": number}).hint("rebalance", "_bucket")
        version = self._commit(placed, True, "rebucket", base, buckets)
        self.buckets = buckets
        return version

    def expire(self, keep: int = 1, seconds: float = 7 * 86400) -> int:
        """Delete all versions but the newest ``keep``, and data folders that none of those names and that are older than
        ``seconds``, which leaves the folders of running writers and readers alone. Returns the number of folders deleted."""
        numbers = self.versions()
        live = {p.split("/")[0] for n in numbers[-keep:] for paths in self.manifest(n)["folders"].values() for p in paths}
        for n in numbers[:-keep]:
            path, fs = self._fs(f"_versions/{n:010d}.json")
            fs.delete(path, False)
        gone = 0
        for status in self._list(""):
            path = status.getPath()
            if path.getName().startswith("data-") and path.getName() not in live and status.getModificationTime() < (time.time() - seconds) * 1000:
                gone += bool(self._fs("")[1].delete(path, True))
        return gone
