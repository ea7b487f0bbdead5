"""Structured Streaming jobs over an event log. Each returns a started query; outputs are tables in a folder."""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
#: Quiet time after which a session is over, and how late events may come.
GAP, LATE = "2 hours", "1 hour"


def stream_events(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The events under path as a stream, with ts as an instant (session time zone)."""
    return spark.readStream.schema(SCHEMA).format(kind).load(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _start(df: DataFrame, out: str, mode: str, sink, name: str = "rows") -> StreamingQuery:
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint-{name}").trigger(availableNow=True)
    return (w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{out}/{name}")).start()


def _append_batch(out: str):
    """Each batch's rows in a folder of its own, so that a repeated batch replaces itself."""

    def sink(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/rows/b={k}")

    return sink


def stream_counts(events: DataFrame, out: str, window: str = "1 day", late: str = LATE) -> StreamingQuery:
    """start, event_type, n, total of tumbling windows, each written once, when the watermark has passed it; state holds open windows alone.

    A window stays open until an event comes that is late after its end; close_stream() ends the input.
    """
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return _start(agg.select(F.col("window.start").alias("start"), "event_type", "n", "total"), out, "append", None)


def stream_sessions(events: DataFrame, out: str, gap: str = GAP, late: str = LATE) -> StreamingQuery:
    """user_id, start, n of sessions that end after a quiet gap, each written once, when the watermark has passed its end."""
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return _start(agg.select("user_id", F.col("session_window.start").alias("start"), "n"), out, "append", None)


def stream_append(events: DataFrame, out: str) -> StreamingQuery:
    """Every event as one JSON line, once, in files below out."""
    w = events.writeStream.outputMode("append").option("checkpointLocation", f"{out}/_checkpoint-rows").trigger(availableNow=True)
    return w.format("json").option("path", f"{out}/rows").start()


#: The user and kind of the event that ends an input: its time lies after all windows, and its own is never written.
END = "_end"


def close_stream(events: DataFrame, folder: str) -> None:
    """Writes to folder, as one more file of the stream's input, an event a year after the last of events: the next run writes all windows still open."""
    last = events.agg((F.max("ts") + F.expr("interval 365 days")).alias("ts"))
    row = {"event_id": F.lit(-1).cast("long"), "ts": F.col("ts"), "user_id": F.lit(-1).cast("long"), "event_type": F.lit(END), "value": F.lit(None).cast("double"), "props": F.lit(None).cast("string")}
    last.select(*(v.alias(k) for k, v in row.items())).coalesce(1).write.mode("append").parquet(folder)


def stream_manifest(events: DataFrame, out: str, late: str = "3 days") -> StreamingQuery:
    """A running manifest of each session (user and day): counts and value so far, upserted by latest_manifest(). State of a day is dropped once the watermark has passed it."""
    day = F.window("ts", "1 day")
    agg = events.withWatermark("ts", late).groupBy(day, "user_id").agg(F.count("*").alias("n_actions"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.sum("value").alias("total"))
    return _start(agg.select("user_id", F.to_date("window.start").alias("day"), "n_actions", "started", "ended", "total"), out, "update", _append_batch(out))


def latest_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each session that stream_manifest wrote."""
    rows = spark.read.parquet(f"{out}/rows")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("user_id", "day").orderBy(F.desc("batch")))).filter("k = 1").drop("k", "batch", "b")


def stream_activity_distinct(events: DataFrame, out: str, late: str = LATE) -> StreamingQuery:
    """user_id, day, event_type: each kind of event once in a session (user and day). Days that the watermark has passed leave the state; events later than that are dropped."""
    rows = events.withWatermark("ts", late).select(F.window("ts", "1 day"), "user_id", "event_type").dropDuplicates(["window", "user_id", "event_type"])
    return _start(rows.select("user_id", F.to_date("window.start").alias("day"), "event_type"), out, "append", None)


#: Quiet time after which a user's work cycle is over without an event that ends it.
QUIET = "7 days"
#: The state store that keyed state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cycles(StatefulProcessor):
    """A user's open cycle: the time of its last event, while it is open. An event that ends the cycle clears it, and so does a timer once the watermark is past the quiet time."""

    def __init__(self, cycle_end: str, quiet_us: int):
        self.cycle_end, self.quiet = cycle_end, quiet_us

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_us long")

    def handleInputRows(self, key, rows, timerValues):
        # a user's events of one micro-batch as three arrays: 17 bytes an event
        parts = [(r["ts_us"].to_numpy(), r["event_id"].to_numpy(), (r["event_type"] == self.cycle_end).to_numpy(bool)) for r in rows]
        ts, ids, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, ts))
        ts, ids, ends = ts[order], ids[order], ends[order]
        first = np.empty(len(ts), bool)
        first[1:] = ends[:-1] | (np.diff(ts) > self.quiet)
        before = self.last.get() if self.last.exists() else None
        first[0] = before is None or int(ts[0]) - before[0] > self.quiet
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ends[-1]:
            self.last.clear()
        else:
            self.last.update((int(ts[-1]),))
            self.handle.registerTimer((int(ts[-1]) + self.quiet) // 1000 + 1)
        if first.any():
            yield pd.DataFrame({"user_id": np.full(int(first.sum()), key[0]), "event_id": ids[first]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_debounce(events: DataFrame, out: str, cycle_end: str = "purchase", quiet: str = QUIET, late: str = LATE) -> StreamingQuery:
    """user_id, event_id of the first event of each user's work cycle.

    A cycle ends with an event of type cycle_end, or when the user's next event comes more than quiet later. State is one
    time for each user with an open cycle, touched only for the users of a batch, and goes by a timer once the watermark has
    passed it by quiet: no event still let in could go on with that cycle, so rows don't depend on when the timer fires.
    Events come in order from batch to batch; those later than late are dropped, and so are those without user_id, ts or
    event_id. A task holds one user's events of one micro-batch (17 bytes each): maxFilesPerTrigger bounds the batch.
    """
    quiet_us = int(events.sparkSession.sql(f"SELECT unix_micros(TIMESTAMP_SECONDS(0) + INTERVAL {quiet})").head()[0])
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("ts", "user_id", "event_id", F.unix_micros("ts").alias("ts_us"), F.coalesce("event_type", F.lit("")).alias("event_type"))
    firsts = rows.groupBy("user_id").transformWithStateInPandas(_Cycles(cycle_end, quiet_us), "user_id long, event_id long", "append", "EventTime")
    with _setting(events.sparkSession, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        return _start(firsts, out, "append", None)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    """A setting while a stream is started, which takes a copy of the session's."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def stream_profile_checks(events: DataFrame, out: str) -> StreamingQuery:
    """Null and range checks of every batch."""
    from lorespan.operators.checks import null_audit, range_check

    def sink(batch: DataFrame, k: int) -> None:
        rows = null_audit(batch, ["value", "event_type"]).unionByName(range_check(batch, "value", 0.0, 50.0))
        rows.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/rows/b={k}")

    return _start(events, out, "append", sink)


def due_jobs(jobs: DataFrame, now, hours: int = 24) -> DataFrame:
    """jobs(job, last_run) that never ran or ran at least hours ago."""
    return jobs.filter(F.col("last_run").isNull() | (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_run").cast("timestamp")) >= hours * 3600))
