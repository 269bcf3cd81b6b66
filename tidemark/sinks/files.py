"""Small files in any store that Spark reaches: created by one writer only, or replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SmallFiles:
    """Texts below one folder. Nobody ever sees half a file: it is written under another name and then renamed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        path, fs = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def read(self, name: str) -> str | None:
        path, fs = self._fs(name)
        try:
            stream = fs.open(path)
        except Exception as e:
            if "FileNotFoundException" in str(e):
                return None
            raise
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _rename(self, source: str, target: str, overwrite: bool) -> bool:
        jvm = self.spark._jvm
        kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, int(overwrite))
        if overwrite:
            options[0] = kind.OVERWRITE
        (a, _), (b, _) = self._fs(source), self._fs(target)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(b.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(a), context.makeQualified(b), options)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e) or "FileNotFoundException" in str(e):
                return False
            raise
        return True

    def _write(self, name: str, text: str, overwrite: bool) -> bool:
        draft = f".{uuid.uuid4().hex}"
        path, fs = self._fs(draft)
        out = fs.create(path)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        done = self._rename(draft, name, overwrite)
        if not done:
            fs.delete(path, False)
        return done

    def create(self, name: str, text: str) -> bool:
        """Whether the file was made; False if there is one of this name already."""
        return self._write(name, text, False)

    def replace(self, name: str, text: str) -> None:
        self._write(name, text, True)

    def take(self, name: str) -> bool:
        """Remove a file; of several that try, one gets True."""
        gone = f".{uuid.uuid4().hex}"
        if not self._rename(name, gone, False):
            return False
        path, fs = self._fs(gone)
        fs.delete(path, True)
        return True
