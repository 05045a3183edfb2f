"""Streams of activity against batches, and cleanups that are played twice."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import state
from skeinwork.streaming import activity as A
from skeinwork.streaming.activity import marks
from skeinwork.streaming.order import Ordered, arrive

T0 = datetime.datetime(2024, 1, 1)


def at(hours):
    return T0 + datetime.timedelta(hours=hours)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_replay_equals_batch(spark, tmp_path, kind):
    rows = [(k % 7, at(0.31 * k if k % 7 else 0.01 * k)) for k in range(80)] + [(None, at(1)), (3, None)]
    log = spark.createDataFrame(rows, "user long, ts timestamp").withColumn("ts", F.col("ts").cast(kind))
    log.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/log")
    watched = A.replay(spark, f"{tmp_path}/log", [F.col("user").alias("key"), "ts"])
    batch = log.select(F.col("user").alias("key"), "ts").where("key is not null")
    assert sorted(A.last_of(watched).collect()) == sorted(state.last_activity(batch.where("ts is not null")).collect())
    assert sorted(A.idle_of(watched).collect()) == sorted(state.inactive(batch, 3).collect()) != []
    assert spark.conf.get(A.STORE) != A.ROCKS


def test_replay_in_batches_forgets_and_remembers(spark, tmp_path):
    """A key that was idle between two files of the log is idle then, and not at the end if it comes back."""
    import time

    for i, rows in enumerate([[(1, at(0)), (3, at(0.5))], [(2, at(5))], [(2, at(9.5))], [(3, at(12))]]):
        spark.createDataFrame(rows, "key long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        time.sleep(1.1)  # files come in the order of their times
    watched = A.replay(spark, f"{tmp_path}/log", ["key", "ts"], files=1).cache()
    assert {(r.key, r.last_seen) for r in watched.where("idle").collect()} == {(1, at(0)), (3, at(0.5))}
    assert [tuple(r) for r in A.idle_of(watched).collect()] == [(1, at(0))]  # 2 is idle for less than three hours
    assert {(r.key, r.last_seen) for r in A.last_of(watched).collect()} == {(1, at(0)), (2, at(9.5)), (3, at(12))}


def test_by_the_clock_with_an_initial_state(spark, tmp_path):
    log = spark.createDataFrame([(1, at(3)), (2, at(1))], "key long, ts timestamp")
    log.write.parquet(f"{tmp_path}/log")
    initial = spark.createDataFrame([(1, at(5)), (9, at(0))], "key long, last_seen timestamp")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    sink = A.watch(stream, 1, None, initial, ttl_hours=48).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/states").outputMode("append").trigger(processingTime="1 second")
    query = A.with_rocks(spark, sink.start)
    for _ in range(60):  # by the clock it never has all there is
        query.awaitTermination(1)
        if any(p.numInputRows for p in query.recentProgress):
            break
    query.stop()
    got = {(r.key, r.last_seen, r.idle) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, at(5), False), (2, at(1), False)}  # the later of the log before and this one


def removal():
    """A removal that tasks get by value."""

    def remove(key):
        if key == 13:
            raise OSError("busy")
        return None if key == 7 else key != 4

    return remove


def test_cleanups(spark, tmp_path):
    sink = A.Cleanup(f"file://{tmp_path}/cleanup", removal())
    shape = "key long, failures long, last_seen timestamp"
    known = lambda: {(r.key, r.failures) for r in sink.failures(spark, shape).collect()}
    batch = lambda *rows: spark.createDataFrame([(k, at(t), i) for k, t, i in rows], "key long, last_seen timestamp, idle boolean")
    sink(batch((1, 0, True), (4, 1, True), (7, 2, True), (13, 0, True), (5, 3, False)), 0)
    assert known() == {(4, 1), (13, 1)}
    sink(batch((2, 4, True)), 1)
    assert known() == {(4, 2), (13, 2)}
    tried = spark.read.parquet(f"{tmp_path}/cleanup/results/1")
    assert {(r.key, r.removed) for r in tried.collect()} == {(2, True), (4, False), (13, False)}
    sink(batch((2, 4, True)), 1)  # played again
    assert known() == {(4, 2), (13, 2)}
    sink(batch((4, 9, False), (6, 5, True)), 2)  # new activity forgets failures
    assert known() == {(13, 3)}
    sink(spark.createDataFrame([], "key long, last_seen timestamp, idle boolean"), 3)
    assert known() == {(13, 4)}
    order = state.cleanup_order(spark.createDataFrame([(13, at(0)), (8, at(5)), (9, at(99))], "key long, ts timestamp"), sink.failures(spark, shape))
    assert [r.key for r in order.orderBy("turn").collect()] == [8, 13]


def test_cleanup_of_a_stream(spark, tmp_path):
    log = spark.createDataFrame([(1, at(0)), (13, at(0)), (3, at(9))], "key long, ts timestamp")
    log.write.parquet(f"{tmp_path}/log")
    sink = A.Cleanup(f"file://{tmp_path}/cleanup", removal())
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    out = A.watch(stream).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/states").trigger(availableNow=True)
    A.with_rocks(spark, out.start).awaitTermination()
    assert {(r.key, r.failures) for r in sink.failures(spark, "key long, failures long, last_seen timestamp").collect()} == {(13, 1)}
    tried = spark.read.parquet(*[f"{tmp_path}/cleanup/results/{n}" for n in marks(spark, sink.root)])
    assert {r.key for r in tried.where("removed").collect()} == {1}


def test_log_put_in_order(spark, tmp_path):
    """A shuffled replay with copies equals the batch, in order; late, null and unfinished parts have their places."""
    r = random.Random(4)
    rows = [(k, at(0.1 * k), f"v{k}") for k in range(200)]
    arrivals = sorted((k * 0.1 + r.uniform(0, 1.4), row) for k, row in enumerate(rows) for _ in range(r.choice([1, 1, 2, 3])))
    arrivals += [(99, (500, at(1), "too late")), (99, (0, at(0), "v0")), (99, (None, at(20), "no key")), (99, (501, None, "no time"))]
    shape = spark.createDataFrame([], "id long, ts timestamp, v string").schema
    sink = Ordered(f"{tmp_path}/order", "id")
    for part in range(0, len(arrivals), 90):
        spark.createDataFrame([row for _, row in arrivals[part : part + 90]], shape).write.mode("append").parquet(f"{tmp_path}/log")
        arrive(spark, f"{tmp_path}/log", shape, sink, f"{tmp_path}/states")
    late = sorted((tuple(x) for x in sink.late_rows(spark, shape).collect()), key=str)
    assert late == sorted([x for _, x in arrivals[-4:]], key=str)
    ended = [tuple(x) for x in sink.released(spark, shape, ended=True).collect()]
    assert sorted(ended) == rows and sink.released(spark, shape).count() < len(rows)
    done = marks(spark, sink.root)
    times = [[x.ts for x in spark.read.parquet(f"{sink.root}/ordered/{n}").collect()] for n in done]
    assert len(done) >= 4 and all(max(a) < min(b) for a, b in zip([t for t in times if t], [t for t in times if t][1:]))
    # a finished batch that is played again does nothing; one without its mark is written anew, to the same tables
    again = spark.createDataFrame([(900, at(100), "again")], shape)
    sink(again, done[-1])
    assert sorted(tuple(x) for x in sink.released(spark, shape, ended=True).collect()) == rows
    new = spark.createDataFrame([(901, at(30), "next"), (901, at(30), "copy"), (199, at(19.9), "v199")], shape)
    sink(new, done[-1] + 1)
    first = sorted(tuple(x) for x in sink.released(spark, shape, ended=True).collect())
    shutil.rmtree(f"{sink.root}/done/{done[-1] + 1}")
    sink(new, done[-1] + 1)
    assert sorted(tuple(x) for x in sink.released(spark, shape, ended=True).collect()) == first == [*rows, (901, at(30), "copy")]


def test_order_of_an_empty_log(spark, tmp_path):
    shape = spark.createDataFrame([], "id long, ts timestamp_ntz").schema
    sink = Ordered(f"{tmp_path}/order", "id")
    for n in (0, 1):
        sink(spark.createDataFrame([], shape), n)
        assert sink.released(spark, shape, ended=True).count() == sink.late_rows(spark, shape).count() == 0
