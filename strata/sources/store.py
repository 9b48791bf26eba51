"""Versioned Parquet snapshots: immutable version folders and one pointer.

Parquet has no MERGE, so a change writes a new version and then moves the
pointer. Moving is a rename of a small file, through the Hadoop file system the
path belongs to, so it works the same on a laptop and on a shared store.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p(self.path))

    def _pointer(self) -> int:
        marks = [s.getPath().getName() for s in self._fs.listStatus(self._p(self.path))]
        numbers = [int(m[8:]) for m in marks if m.startswith("_CURRENT")]
        return max(numbers, default=0)

    def current(self) -> str:
        n = self._pointer()
        if not n:
            raise FileNotFoundError(f"{self.path} has no committed version")
        stream = self._fs.open(self._p(f"{self.path}/_CURRENT{n}"))
        try:
            return f"{self.path}/{stream.readUTF()}"
        finally:
            stream.close()

    def exists(self) -> bool:
        return self._pointer() > 0

    def subfolders(self, path: str, prefix: str) -> list[int]:
        """The numbers of the folders ``prefix``N below a path."""
        if not self._fs.exists(self._p(path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(path)) if s.isDirectory()]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    @contextmanager
    def next(self) -> Iterator[str]:
        """A folder to write the next version to; committed on leaving without an error.

        The commit creates the pointer with the next number and fails if a
        second writer has created it first. A failed writer leaves nothing that
        a reader could see, and its folder is deleted.
        """
        n = self._pointer() + 1
        name = f"v{n}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.path}/{name}"
        try:
            yield folder
            tmp = self._p(f"{self.path}/.tmp-{name}")
            out = self._fs.create(tmp, False)
            out.writeUTF(name)
            out.close()
            if self._fs.exists(self._p(f"{self.path}/_CURRENT{n}")) or not self._fs.rename(tmp, self._p(f"{self.path}/_CURRENT{n}")):
                self._fs.delete(tmp, False)
                raise RuntimeError(f"another writer committed version {n} first")
        except BaseException:
            self._fs.delete(self._p(folder), True)
            raise

    def reset(self) -> None:
        self._fs.delete(self._p(self.path), True)
        self._fs.mkdirs(self._p(self.path))


class GraphStore:
    """Named tables (one per label or edge set) under one version pointer.

    A version is a small manifest of the folders each table consists of. A commit writes what changed and names all
    other folders as they are, so it costs what it changes; an appended batch is one more folder of its table.
    """

    MANIFEST = "name string, path string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def manifest(self) -> dict[str, list[str]]:
        if not self.versions.exists():
            return {}
        parts: dict[str, list[str]] = {}
        for r in self.spark.read.schema(self.MANIFEST).parquet(f"{self.versions.current()}/manifest").collect():
            parts.setdefault(r.name, []).append(r.path)
        return parts

    def tables(self) -> list[str]:
        return sorted(self.manifest())

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*self.manifest()[name])

    def commit(self, changed: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None) -> None:
        """All changed (replaced) and appended tables become visible together; the others stay what they are."""
        parts = self.manifest()
        with self.versions.next() as folder:
            for name, df in (changed or {}).items():
                df.write.parquet(f"{folder}/{name}")
                parts[name] = [f"{folder}/{name}"]
            for name, df in (appended or {}).items():
                df.write.parquet(f"{folder}/{name}-more")
                parts[name] = [*parts.get(name, []), f"{folder}/{name}-more"]
            rows = [(n, p) for n, paths in sorted(parts.items()) for p in paths]
            self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")

    def verify(self) -> bool:
        """True if every table of the current version can be read."""
        return all(self.read(n).limit(1).count() >= 0 for n in self.tables())

    def reset(self) -> None:
        self.versions.reset()
