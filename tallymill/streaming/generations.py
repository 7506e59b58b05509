"""Numbered folders that a stream's store consists of: deltas, and bases that stand for all up to a number.

A folder counts once its marker is there, so half-written ones are never read. A marker is made only where there is none:
of two writers of one number the second fails. One listing of the markers tells what to read.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer has published this number."""


class Generations:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _whole(self, kind: str) -> list[int]:
        files, top = self._files(), self._path("_done")
        names = [f.getPath().getName() for f in files.listStatus(top)] if files.exists(top) else []
        return sorted(int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"{kind}-"))

    def active(self) -> int:
        """The newest number that is whole, -1 for none."""
        return max([*self._whole("delta"), *self._whole("base")], default=-1)

    def parts(self) -> list[str]:
        """The folders that make up the store: the newest base, and the deltas after it."""
        base = max(self._whole("base"), default=-1)
        return [f"base-{base}"] * (base >= 0) + [f"delta-{d}" for d in self._whole("delta") if d > base]

    def commit(self, name: str) -> None:
        """Publish a folder that is written to its end."""
        try:
            self._files().create(self._path(f"_done/{name}"), False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Taken(name) from e
            raise

    def drop(self, name: str) -> None:
        """Remove a folder that was of use to its writer alone."""
        self._files().delete(self._path(name), True)

    def prune(self) -> None:
        """Remove what only generations before the last base but one are made of; readers of the last one are not disturbed."""
        bases = self._whole("base")
        if len(bases) < 2:
            return
        old = [f"base-{b}" for b in bases[:-2]] + [f"delta-{d}" for d in self._whole("delta") if d <= bases[-2]]
        for name in old:
            self._files().delete(self._path(f"_done/{name}"), False)
            self._files().delete(self._path(name), True)
