"""A keyed result store: every write makes a new snapshot, and a reader sees one whole snapshot.

A snapshot is a Parquet folder; it counts once a commit file names it. Commit files are numbered and are
created only where none of that number exists, so of two writers that build on one snapshot one wins, and the other
merges again with what the winner wrote. A write that fails leaves a folder that no commit names.
Files go through Hadoop's file systems, so a store can be wherever Spark reads and writes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.select import latest


class Conflict(RuntimeError):
    """Another writer has committed the snapshot's number."""


class ResultStore:
    """Rows of one schema, at most one for each value of keys."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        """The committed versions, oldest first."""
        folder = self._at("commits")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _snapshot(self, version: int) -> str:
        stream = self._fs.open(self._at("commits", f"{version:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last one; none where nothing is committed."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/snapshots/{self._snapshot(known[-1] if version is None else version)}")

    def _commit(self, version: int, name: str) -> None:
        self._fs.mkdirs(self._at("commits"))
        try:
            stream = self._fs.create(self._at("commits", f"{version:012d}"), False)
        except Exception as e:
            if version in self.versions():
                raise Conflict(f"version {version} is another writer's") from e
            raise
        stream.write(name.encode())
        stream.close()

    def _write(self, rows: DataFrame, version: int) -> None:
        name = uuid.uuid4().hex
        rows.select(*self.schema.fieldNames()).write.parquet(f"{self.path}/snapshots/{name}")
        self._commit(version, name)

    def upsert(self, rows: DataFrame, *order: Column, attempts: int = 5) -> int:
        """Puts rows in place of those of the same keys, and gives the new version. Of new rows that share keys the first in `order` stays."""
        for _ in range(attempts):
            known = self.versions()
            version = known[-1] if known else 0
            try:
                self._write(latest(self.read(version or None), rows.select(*self.schema.fieldNames()), self.keys, *order), version + 1)
                return version + 1
            except Conflict:
                continue
        raise Conflict(f"{attempts} attempts met other writers")

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys the store lacks."""
        return rows.join(self.read().select(*self.keys), self.keys, "left_anti")

    def prune(self, keep: int = 2) -> None:
        """Deletes all but the last versions, and snapshots that none of them names. Not while others write."""
        known = self.versions()
        for v in known[: max(0, len(known) - keep)]:
            self._fs.delete(self._at("commits", f"{v:012d}"), False)
        named = {self._snapshot(v) for v in self.versions()}
        folder = self._at("snapshots")
        for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if f.getPath().getName() not in named:
                self._fs.delete(f.getPath(), True)
