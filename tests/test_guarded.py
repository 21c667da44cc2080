"""Guarded micro-batches and the event log."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tesserae.streaming import counters, guarded

SCHEMA = "id long, body string"
DONE, DEAD, WAITING = f"{SCHEMA}, tries int, result string", f"{SCHEMA}, tries int, error string", f"{SCHEMA}, tries int, due double"


def step(row, attempt):
    if row.body == "poison":
        raise ValueError("bad")
    if row.body == "slow":
        time.sleep(30)
    if row.body == "later" and attempt < 2:
        raise OSError("not yet")
    return row.body.upper()


@pytest.fixture
def guard(spark, tmp_path):
    now = [1000.0]
    g = guarded.Guard(spark, step, seconds=0.3, tries=3, backoff=10.0, clock=lambda: now[0], folder=f"file://{tmp_path}/guard")
    g.now = now
    return g


def ids(df):
    return sorted(r.id for r in df.collect())


def test_batches(spark, guard):
    """A poisoned row and a slow one end as dead letters once, a row that recovers is done, waiting doubles, a replay changes nothing."""
    first = spark.createDataFrame([(1, "a"), (2, "poison"), (3, "slow"), (4, "later")], SCHEMA)
    guard(first, 0)
    assert ids(guard.table("done", DONE)) == [1] and ids(guard.table("dead", DEAD)) == []
    assert {(r.id, r.tries, r.due) for r in spark.read.parquet(guard.part("waiting", 0)).collect()} == {(k, 1, 1010.0) for k in (2, 3, 4)}
    guard(first, 0)
    assert ids(guard.table("done", DONE)) == [1]
    guard.now[0] = 1005.0
    guard(spark.createDataFrame([(5, "b")], SCHEMA), 1)  # nothing is due yet
    assert {(r.id, r.tries, r.due) for r in spark.read.parquet(guard.part("waiting", 1)).collect()} == {(k, 1, 1010.0) for k in (2, 3, 4)}
    guard.now[0] = 1010.0
    guard(spark.createDataFrame([], SCHEMA), 2)
    assert {(r.id, r.tries, r.due) for r in spark.read.parquet(guard.part("waiting", 2)).collect()} == {(k, 2, 1030.0) for k in (2, 3, 4)}
    guard.now[0] = 1030.0
    guard.finish(SCHEMA)
    assert ids(guard.table("done", DONE)) == [1, 4, 5] and ids(guard.table("dead", DEAD)) == [2, 3] and guard.last() == 3
    errors = {r.id: r.error for r in guard.table("dead", DEAD).collect()}
    assert errors[2] == "ValueError: bad" and errors[3].startswith("TooSlow")
    rows = {r.batch_id: r for r in guard.table("batches", "batch_id long, rows long, done long, dead long, failures long, slow long, waiting long").collect()}
    assert [(rows[k].rows, rows[k].done, rows[k].dead, rows[k].failures, rows[k].slow, rows[k].waiting) for k in range(4)] == [(4, 1, 0, 3, 1, 3), (4, 1, 0, 0, 0, 3), (3, 0, 0, 3, 1, 3), (3, 1, 2, 2, 1, 0)]


def test_replay_of_a_batch_that_broke_off(spark, guard):
    """Parts are there but the completion row isn't: the batch is done anew, and its parts are replaced."""
    guard(spark.createDataFrame([(1, "a"), (2, "poison")], SCHEMA), 0)
    at = spark._jvm.org.apache.hadoop.fs.Path(guard.part("batches", 0))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    guard(spark.createDataFrame([(1, "a"), (2, "poison")], SCHEMA), 0)
    assert ids(guard.table("done", DONE)) == [1] and spark.read.parquet(guard.part("waiting", 0)).count() == 1


def test_callbacks(spark, guard):
    seen = []

    def told(row):
        seen.append(row)
        raise RuntimeError("mine")

    guard.on_complete = told
    for k in range(2):
        guard(spark.createDataFrame([(k, "x")], SCHEMA), k)
    assert [(r["batch_id"], r["done"]) for r in seen] == [(0, 1), (1, 1)] and len(guard.errors) == 2


def test_event_log(spark, tmp_path):
    """Typed and catch-all subscribers, one that fails, one that leaves; a log larger than its buffer; counters of a stream."""
    log = counters.EventLog(spark, f"file://{tmp_path}/log", most=4)
    typed, everything = [], []

    def broken(event):
        raise ValueError("no")

    log.subscribe("a", broken)
    log.subscribe("a", typed.append)
    leave = log.subscribe(counters.ALL, everything.append)
    for k in range(3):
        log.emit("a", name=str(k))
        log.emit("b", name=str(k))
    leave()
    log.emit("b", name="last")
    assert [e["name"] for e in typed] == ["0", "1", "2"] and [e["kind"] for e in everything] == ["a", "b"] * 3
    rows = log.table().orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(10)) and sum(r.kind == "fault" and r.detail == "ValueError: no" for r in rows) == 3
    spark.range(50).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    with counters.listening(log):
        out = counters.counted(stream, "numbers", even=F.col("id") % 2 == 0)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    totals = {r.name: r.n for r in log.table().filter("kind = 'count'").groupBy("name").agg(F.sum("value").alias("n")).collect()}
    assert totals == {"numbers.rows": 50, "numbers.even": 25}
    assert {"started", "progress", "terminated"} <= {r.kind for r in log.table().select("kind").distinct().collect()}
