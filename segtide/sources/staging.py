"""Intermediate results written once, for queries that need one from several sides."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Blocks nest within a thread; what is written outside any block is listed until ``drop_staged``.
_own = threading.local()
_loose: list[str] = []


def _scopes() -> list[list[str]]:
    if not hasattr(_own, "scopes"):
        _own.scopes = []
    return _own.scopes


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where the session names none, as in tests, a temporary one is set.

    That is done on a local master only: on a cluster each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="segtide-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def place(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared folder.

    Inside ``staging`` it goes with the block, or with the block around it if it ``outlives`` the inner one. Outside any block a result may be read
    at any time, so whoever has used it up calls ``drop_staged``.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes()[:-1] if outlives else _scopes()
    (scopes[-1] if scopes else _loose).append(path)
    return path


def written(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and lost executors take nothing along."""
    path = place(df.sparkSession, name, outlives)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        found = hadoop(path)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that are written inside once the block ends; what leaves it must be written to outlive it."""
    _scopes().append([])
    try:
        yield
    finally:
        _delete(spark, _scopes().pop())


def drop_staged(spark: SparkSession) -> None:
    """Drop every table that was written outside a block; results that read one can't be used any more."""
    gone, _loose[:] = list(_loose), []
    _delete(spark, gone)
