"""Versioned Parquet tables: append, insert if absent, upsert and stale marks without ``MERGE``.

A table is a folder of versions and a numbered pointer to each. A write makes a new version of the number
after the one that it has read; only one writer can create a pointer of a number. One that comes too late
takes its change up again from the new current version, or is told so. What is being read is never overwritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def number(self) -> int:
        """The number of the current version; 0 before the first write."""
        folder = self._path(f"{self.path}/current")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder)), default=0) if self._fs.exists(folder) else 0

    def read(self, number: int | None = None) -> DataFrame | None:
        """The current version, or that of a number; None before the first write."""
        number = self.number() if number is None else number
        return self.spark.read.parquet(f"{self.path}/{self._folder(number)}") if number else None

    def _folder(self, number: int) -> str:
        stream = self._fs.open(self._path(f"{self.path}/current/{number:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, rows: DataFrame, after: int | None = None) -> bool:
        """Make ``rows`` the version behind number ``after`` (the current one); False if another writer was first."""
        number = (self.number() if after is None else after) + 1
        folder = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        try:
            stream = self._fs.create(self._path(f"{self.path}/current/{number:012d}"), False)
        except Exception as e:
            if not self._fs.exists(self._path(f"{self.path}/current/{number:012d}")):
                raise e
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            return False
        stream.write(bytearray(folder.encode()))
        stream.close()
        return True

    def _change(self, make) -> None:
        """Write what ``make`` makes of the current version, again if that has changed meanwhile."""
        while True:
            number = self.number()
            if self.write(make(self.read(number)), number):
                return

    def expire(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions."""
        for number in range(1, self.number() - keep + 1):
            pointer = self._path(f"{self.path}/current/{number:012d}")
            if self._fs.exists(pointer):
                self._fs.delete(self._path(f"{self.path}/{self._folder(number)}"), True)
                self._fs.delete(pointer, False)

    def insert_if_absent(self, rows: DataFrame, keys: list[str], order: str) -> None:
        """Keep what is there; of new rows with one key the first in ``order``."""
        fresh = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
        self._change(lambda old: fresh if old is None else old.unionByName(fresh.join(old.select(*keys), keys, "left_anti")))

    def upsert(self, rows: DataFrame, keys: list[str], order: str) -> None:
        """New rows replace those of their keys; of several the last in ``order``."""
        fresh = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        self._change(lambda old: fresh if old is None else old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh))

    def compare_and_set(self, rows: DataFrame, keys: list[str], version: str = "document_version") -> None:
        """Rows replace those of their keys that carry the same version, which then rises by one; stale rows change nothing."""

        def make(old: DataFrame) -> DataFrame:
            hit = rows.join(old.select(*keys, version), [*keys, version], "left_semi")
            return old.join(hit.select(*keys), keys, "left_anti").unionByName(hit.withColumn(version, F.col(version) + 1).select(old.columns))

        self._change(make)

    def mark(self, keys: DataFrame, on: list[str], column: str, value: str) -> None:
        """Set a column where a row's key is in ``keys``."""
        hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
        self._change(lambda old: old.join(hit, on, "left").withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).drop("_hit").select(old.columns))
