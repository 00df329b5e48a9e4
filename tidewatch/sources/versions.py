"""A table of versions: each is written whole beside the others, and becomes the current one by a single atomic rename.

A version's files are below ``data``, in a folder no other writer has. Committing it renames a finished pointer file to the
version's number below ``log``; that fails if another writer has taken the number. So readers see whole versions only, and
a writer that dies before the rename leaves the table as it was.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version in the meantime."""


@dataclass(frozen=True)
class Version:
    number: int
    data: str
    run: str


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._file(path).getFileSystem(self._conf)

    def _file(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path(os.path.join(*parts))

    def versions(self) -> list[Version]:
        """All committed versions, oldest first."""
        log = self._file(self.path, "log")
        if not self._fs.exists(log):
            return []
        numbers = sorted(int(s.getPath().getName()) for s in self._fs.listStatus(log) if s.getPath().getName().isdigit())
        return [self._pointer(n) for n in numbers]

    def _pointer(self, number: int) -> Version:
        stream = self._fs.open(self._file(self.path, "log", f"{number:020d}"))
        try:
            held = json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
        return Version(number, held["data"], held["run"])

    def current(self) -> Version | None:
        return next(iter(reversed(self.versions())), None)

    def read(self, number: int | None = None) -> DataFrame:
        """The current version, or an older one by its number."""
        found = self.current() if number is None else next((v for v in self.versions() if v.number == number), None)
        if found is None:
            raise FileNotFoundError(f"no such version below {self.path}")
        return self.spark.read.parquet(os.path.join(self.path, "data", found.data))

    def stage(self, df: DataFrame) -> str:
        """Writes a version's files, which nobody sees before ``commit``."""
        data = self._jvm.java.util.UUID.randomUUID().toString()
        df.write.parquet(os.path.join(self.path, "data", data))
        return data

    def commit(self, data: str, run: str, after: int) -> Version:
        """Makes ``data`` the version after number ``after`` (-1 for the first)."""
        number = after + 1
        finished = self._file(self.path, "log", f".{data}")
        out = self._fs.create(finished, True)
        try:
            out.write(json.dumps({"data": data, "run": run}).encode())
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        no_options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(finished, self._file(self.path, "log", f"{number:020d}"), no_options)
        except Py4JJavaError as e:
            self._fs.delete(finished, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise Conflict(f"version {number} of {self.path} is taken") from None
            raise
        return Version(number, data, run)

    def write(self, df: DataFrame, run: str) -> Version:
        """A new version; a run that is already the current version's is not written again."""
        now = self.current()
        if now is not None and now.run == run:
            return now
        return self.commit(self.stage(df), run, now.number if now else -1)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` versions."""
        for v in self.versions()[:-keep]:
            self._fs.delete(self._file(self.path, "log", f"{v.number:020d}"), False)
            self._fs.delete(self._file(self.path, "data", v.data), True)
