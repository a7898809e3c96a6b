"""Several tables that are replaced at once.

New tables are written beside the old ones; then one row, which names the path
of every table, makes them the current ones together. A reader holds on to the
snapshot that it opened: what is published later, or fails before it is, doesn't
change what it reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version int, paths map<string,string>"


class Snapshot:
    """The tables of one version."""

    def __init__(self, spark: SparkSession, version: int, paths: dict[str, str]):
        self.spark, self.version, self.paths = spark, version, paths

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.paths[name])


class Snapshots:
    """Versions of a set of tables under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], _POINTER).write.mode("ignore").parquet(f"{path}/versions")

    def latest(self) -> Snapshot | None:
        last = self.spark.read.schema(_POINTER).parquet(f"{self.path}/versions").orderBy(F.desc("version")).first()
        return last and Snapshot(self.spark, last.version, last.paths)

    def published(self, tables: dict[str, DataFrame]) -> Snapshot:
        """Writes tables and makes them, with those that they don't replace, the current ones. Until all are written none is."""
        before, paths = self.latest(), {}
        for name, df in tables.items():
            paths[name] = f"{self.path}/tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
        version = before.version + 1 if before else 0
        row = (version, (before.paths if before else {}) | paths)
        self.spark.createDataFrame([row], _POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        return Snapshot(self.spark, *row)
