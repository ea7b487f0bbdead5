"""Folders that the driver and every executor can reach, and tables written there."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("tables", default=None)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset, as in tests, a local folder is set as the checkpoint folder, once."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Tables:
    """The tables stored within one scope; those that aren't kept go when it ends."""

    def __init__(self, outer: Tables | None):
        self.outer, self.paths = outer, set()

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        """df stored as a table that outlives this scope: it belongs to the scope around it, if there is one."""
        df = stored(df, name)
        path = df._stored_path
        self.paths.discard(path)
        if self.outer is not None:
            self.outer.paths.add(path)
        return df


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def tables(spark: SparkSession):
    """A scope of stored tables: at its end, or when it fails, all go but those kept. A caller that has written a query's result can wrap the whole of it."""
    own = Tables(_OPEN.get())
    token = _OPEN.set(own)
    try:
        yield own
    finally:
        _OPEN.reset(token)
        for path in own.paths:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs nothing. It goes with the innermost scope of tables()."""
    path = work_dir(df.sparkSession, name)
    if (scope := _OPEN.get()) is not None:
        scope.paths.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out
