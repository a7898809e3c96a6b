"""Tables between steps, in the folder that the cluster shares, which cut lineage and survive lost executors.

A step is written as Parquet and read again: a lost executor costs the tasks of
one step, never the steps before it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to all tasks at most.
FEW = 100_000
_own: dict[str, str] = {}
_once: dict[tuple, Any] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this application's in that of ``spark.checkpoint.dir``.

    Where that is unset a temporary folder of this machine serves, on a local
    master only (tests): on a cluster executors would each write to their own.
    """
    application = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/quern-{application}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir isn't set: on {master} it has to name a folder that all executors share")
    if application not in _own:
        _own[application] = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _own[application], ignore_errors=True)
    return f"file://{_own[application]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    return kept_at(df, name)[0]


def kept_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``kept``, with the table's path, for ``dropped``."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def few(written: DataFrame, most: int = FEW) -> DataFrame:
    """A written table, sent to all tasks of a join with it if it has ``most`` rows or fewer."""
    return F.broadcast(written) if written.count() <= most else written


def once(spark: SparkSession, key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made when first wanted by this application and then held under ``key`` until ``cleared``."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _once:
        _once[key] = make()
    return _once[key]


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cleared(spark: SparkSession) -> None:
    """Removes all that this application has kept, so that it is made anew when wanted. Call it when results that read such tables have been written."""
    for key in [k for k in _once if k[0] == spark.sparkContext.applicationId]:
        del _once[key]
    dropped(spark, folder(spark))
