"""Folders that the driver and every executor can reach, and small plan helpers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What a broadcast table may hold, counted before: rows, and bytes of all its values. Beyond either, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 16_000_000
#: Bytes of text for which one group of a two-sided exchange (a home, or a bucket and its likes) is meant.
GROUP_TEXT = 10_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, as in tests, a new local folder is set as the checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, and a lost executor costs nothing."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    c = F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType):
        each = F.octet_length(F.array_join(c, "")) if isinstance(kind.elementType, T.StringType) else F.lit(0)
        size = 8 * F.size(c) + each
    else:
        size = F.lit(8)
    return F.coalesce(size, F.lit(0)).cast("long")


def small(df: DataFrame) -> DataFrame:
    """df (a stored table), marked for broadcast if its rows and bytes, counted first, are within bounds; else as it is, so that joins with it shuffle."""
    width = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(spark: SparkSession, text_bytes: int) -> int:
    """How many groups the rows of a corpus of that size are dealt to: no fewer than the shuffle partitions, and more where a group would outgrow GROUP_TEXT."""
    return max(partitions(spark), -(-text_bytes // GROUP_TEXT))


def lower_ascii(text: Column) -> Column:
    """text with A-Z, and no other letter, in lower case. Texts of ASCII alone take the cheaper function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def first_copies(docs: DataFrame, slim: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose doc_id is the smallest with their key; of rows without doc_id, one for each key that no other row has.

    slim has (doc_id, key) of every row and should be stored. The texts are not shuffled: the ids of the other copies are
    few enough to broadcast (counted first), or else an anti join by doc_id shuffles. Rows that repeat a doc_id and key
    stay. Only texts of rows without doc_id are shuffled, one of each key from each task.
    """
    # the keys are stored before the join, and nothing is grouped after it, so that a join by a hot key can be split
    firsts = stored(slim.groupBy(key).agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "firsts")
    copies = slim.join(small(firsts), key).filter("doc_id <> _first").select("doc_id", key)
    out = docs.join(small(stored(copies, "copies")), ["doc_id", key], "left_anti").select(*docs.columns)
    if not slim.filter("doc_id is null").limit(1).count():
        return out
    named = small(stored(slim.filter("doc_id is null").select(key).distinct().join(slim.filter("doc_id is not null").select(key), key, "left_semi"), "named"))
    nameless = docs.filter("doc_id is null").dropDuplicates([key]).join(named, key, "left_anti").select(*docs.columns)
    return out.filter("doc_id is not null").unionByName(nameless)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Within it, at most n rows go to Python workers in one Arrow batch (the caller runs its job inside): bounds the buffers for whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Gives freed memory back to the system, so that a reused Python worker does not hold the peak of its earlier work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(work):
    """work, a generator function over batches, with trim() when it ends."""

    def run(rows):
        try:
            yield from work(rows)
        finally:
            trim()

    return run
