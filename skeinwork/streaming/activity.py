"""Streams of events: running activity, idle keys, windowed counts with a watermark, and cleanups that act.

``watch`` keeps each key's last activity as a value, with a timer; ``replay`` runs it over a log that has ended.  ``Cleanup``
is a sink for what it gives: each idle key is removed, a failure is counted, and a batch that is played again does nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import state
from ..runtime import scratch, ship, written

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = 3_600_000


def last_seen(events: DataFrame) -> DataFrame:
    """(key, last_seen), kept up to date: run with output mode ``complete`` or ``update``."""
    return events.groupBy("key").agg(F.max("ts").alias("last_seen"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(started, kind, n) of tumbling windows; events later than the watermark are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("started"), "kind", "n")


def idle_alerts(events: DataFrame, hours: int = 3, late: str = "10 minutes") -> DataFrame:
    """(key, last_seen, idle): a row a key and batch of its events; one with idle set when its event-time timer runs out."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (seen,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "last_seen": [pd.Timestamp(seen, unit="us")], "idle": [True]})
            return
        seen = state.get[0] if state.exists else 0
        for part in parts:
            seen = max(seen, int(part["ts"].max().value // 1000))
        state.update((seen,))
        state.setTimeoutTimestamp(max(seen // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "last_seen": [pd.Timestamp(seen, unit="us")], "idle": [False]})

    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(run, "key long, last_seen timestamp, idle boolean", "seen long", "update", GroupStateTimeout.EventTimeTimeout)


class Activity(StatefulProcessor):
    """A key's last activity as a value, and one timer that runs out when the key has been idle for more than so many hours.

    By event time the timer follows the watermark; by processing time, the clock, and a value that is never cleared goes
    after the time to live."""

    def __init__(self, hours: int, by_event_time: bool, ttl_hours: int | None) -> None:
        self.hours, self.by_event_time, self.ttl = hours, by_event_time, None if ttl_hours is None else ttl_hours * HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "micros long", self.ttl)

    def _note(self, micros: int, times) -> int:
        newest = max(micros, self.seen.get()[0]) if self.seen.exists() else micros
        self.seen.update((newest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        since = newest // 1000 if self.by_event_time else times.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(since + self.hours * HOUR_MS + 1)
        return newest

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._note(initialState.micros, timerValues)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield Row(key=key[0], micros=self._note(max(r.micros for r in rows), timerValues), idle=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.seen.exists():
            micros = self.seen.get()[0]
            self.seen.clear()
            yield Row(key=key[0], micros=micros, idle=True)

    def close(self) -> None:
        pass


def watch(events: DataFrame, hours: int = 3, late: str | None = "0 seconds", initial: DataFrame | None = None, ttl_hours: int | None = None) -> DataFrame:
    """(key, last_seen, idle) of a stream of events (key, ts): a row a key and batch of its events, and one with idle set
    when the key has been idle for more than so many hours, which ends its state.

    By event time up to the watermark ``late``; without one, by the clock, and then with a time to live, if given.  initial:
    (key, last_seen) of a log before the stream.  State is in RocksDB (``with_rocks``)."""
    ship(events.sparkSession)
    rows = events.where("key is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs one with a zone
    rows = rows if late is None else rows.withWatermark("ts", late)
    before = None if initial is None else initial.select("key", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("micros")).groupBy("key")
    processor = Activity(hours, late is not None, ttl_hours if late is None else None)
    kind, time = dict(events.dtypes)["key"], events.schema["ts"].dataType
    out = rows.select("key", "ts", F.unix_micros("ts").alias("micros")).groupBy("key").transformWithState(
        processor, f"key {kind}, micros long, idle boolean", "append", "processingTime" if late is None else "eventTime", before
    )
    return out.select("key", F.timestamp_micros("micros").cast(time).alias("last_seen"), "idle")


def with_rocks(spark: SparkSession, start: Callable):
    """What start gives, which starts a stream, with RocksDB as the session's state store meanwhile."""
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return start()
    finally:
        spark.conf.set(STORE, old)


def replay(spark: SparkSession, path: str, columns: list, hours: int = 3, files: int = 1000) -> DataFrame:
    """watch's rows over the events of a Parquet table that has ended, read as a stream of so many files a batch; columns:
    its columns as key and ts.  They are written to the shared folder."""
    head, _, name = path.rpartition("/")
    pattern = f"{head}/[{name[0]}]{name[1:]}"  # a single file is only taken as a pattern
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(pattern).select(*columns)
    to, states = scratch(spark, "replay"), scratch(spark, "replay-states")
    sink = watch(stream, hours).writeStream.format("parquet").option("path", to).option("checkpointLocation", states).trigger(availableNow=True)
    with_rocks(spark, sink.start).awaitTermination()
    kinds = dict(stream.dtypes)
    return spark.read.schema(f"key {kinds['key']}, last_seen {kinds['ts']}, idle boolean").parquet(to)


def last_of(watched: DataFrame) -> DataFrame:
    """(key, last_seen) of watch's rows."""
    return watched.where("not idle").groupBy("key").agg(F.max("last_seen").alias("last_seen"))


def idle_of(watched: DataFrame) -> DataFrame:
    """(key, last_seen) of the keys that are idle at the end of watch's rows."""
    found = watched.groupBy("key").agg(F.max("last_seen").alias("last_seen"), F.max(F.when(F.col("idle"), F.col("last_seen"))).alias("idle_since"))
    return found.where("idle_since = last_seen").select("key", "last_seen")


def marks(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the batches that a sink has finished below root."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/done")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p)) if fs.exists(p) else []


class Cleanup:
    """A foreachBatch sink for watch's rows: each idle key is removed; failures are a table below ``root``.

    remove(key) says whether the key is gone now, None if it wasn't there; an exception counts as False.  It runs in tasks,
    a key at a time, and may run again for a key when a task or an unfinished batch is run again.  A batch's results and the
    failures after it are written under its number, with a mark at the end; a batch that has its mark does nothing.  New
    activity forgets a key's failures.  Keys that failed before are tried after all others and again in every batch, so
    one that always fails holds up no other."""

    def __init__(self, root: str, remove: Callable) -> None:
        self.root, self.remove = root.rstrip("/"), remove

    def failures(self, spark: SparkSession, schema: str) -> DataFrame:
        """(key, failures, last_seen) after the last whole batch."""
        done = marks(spark, self.root)
        return spark.read.schema(schema).parquet(f"{self.root}/failures/{done[-1]}") if done else spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, remove = batch.sparkSession, self.remove
        if number in marks(spark, self.root):
            return
        ship(spark)
        kind, time = (dict(batch.dtypes)[c] for c in ("key", "last_seen"))
        shape = f"key {kind}, failures long, last_seen {time}"
        batch = written(batch.select("key", "last_seen", "idle"), "cleanup")
        active = batch.where("not idle").select("key").distinct()
        before = self.failures(spark, shape).join(active, "key", "left_anti")
        idle = batch.where("idle").join(active, "key", "left_anti").groupBy("key").agg(F.max("last_seen").alias("last_seen"))
        wanted = idle.join(before.select("key", "failures", F.col("last_seen").alias("failed_since")), "key", "full").select("key", F.coalesce("last_seen", "failed_since").alias("last_seen"), F.coalesce("failures", F.lit(0)).alias("failures"))

        def act(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                gone = []
                for key in part["key"]:
                    try:
                        gone.append(remove(key))
                    except Exception:  # whatever a removal raises, the key is still there
                        gone.append(False)
                yield pd.DataFrame({"key": part["key"], "removed": pd.array(gone, dtype="boolean"), "last_seen": part["last_seen"]})

        results = f"{self.root}/results/{number}"
        ordered = wanted.repartitionByRange("failures", "last_seen").sortWithinPartitions("failures", "last_seen")
        ordered.select("key", "last_seen").mapInPandas(act, f"key {kind}, removed boolean, last_seen {time}").write.mode("overwrite").parquet(results)
        tried = spark.read.schema(f"key {kind}, removed boolean, last_seen {time}").parquet(results)
        after = state.after_cleanup(before, tried).join(wanted.select("key", "last_seen"), "key")
        after.select("key", "failures", "last_seen").write.mode("overwrite").parquet(f"{self.root}/failures/{number}")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/{number}")
