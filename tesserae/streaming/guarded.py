"""Micro-batches that stand poisoned rows, slow rows and replays: time limits, retries with back-off, dead letters, a completion row for each batch."""

from __future__ import annotations

import signal
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import place

#: What a row carries on its way: how often it was tried, and from when on it may be tried again (seconds).
TRIES, DUE = "tries", "due"


class TooSlow(Exception):
    """A row took longer than its limit."""


def limited(process: Callable, row: tuple, attempt: int, seconds: float) -> object:
    """``process(row, attempt)`` stopped after ``seconds`` (0: no limit). A worker runs its tasks in its main thread, where a timer can interrupt it."""
    if seconds <= 0:
        return process(row, attempt)

    def stop(*_: object) -> None:
        raise TooSlow(f"took more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return process(row, attempt)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@dataclass
class Guard:
    """A sink for ``foreachBatch``: ``process(row, attempt)`` gives a row's ``result`` (text), or raises.

    Tables in ``folder``, each with a part for every batch: ``done`` (the rows with result and tries), ``dead`` (rows that failed ``tries``
    times, with error), ``waiting`` (rows to be tried again, due after ``backoff`` seconds times 2 to the power of the failures before) and
    ``batches`` (the completion row, written last). A batch takes the new rows and those that the batch before left waiting, if they are due.
    Every part is overwritten by its batch alone and a batch with a completion row is left as it is, so a replay changes nothing.
    ``on_complete`` gets each completion row as a dict; what it raises is told in ``errors`` and stops nothing.
    """

    spark: SparkSession
    process: Callable
    seconds: float = 30.0
    tries: int = 3
    backoff: float = 5.0
    on_complete: Callable[[dict], None] | None = None
    clock: Callable[[], float] = time.time
    folder: str = ""
    errors: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.folder = self.folder or place(self.spark, "guarded")

    def part(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        if self._there(self.part("batches", batch)):
            return
        if taken := {TRIES, DUE, "result", "error"} & set(rows.columns):
            raise ValueError(f"the guard's own columns: {', '.join(sorted(taken))}")
        spark, now, began = rows.sparkSession, self.clock(), self.clock()
        todo = rows.withColumn(TRIES, F.lit(0)).withColumn(DUE, F.lit(0.0))
        if batch > 0 and self._there(self.part("waiting", batch - 1)):
            todo = todo.unionByName(spark.read.schema(todo.schema).parquet(self.part("waiting", batch - 1)))
        tried = self._tried(todo, now)
        tried.write.mode("overwrite").parquet(self.part("tried", batch))  # once: processing has effects and isn't repeated for each table
        tried = spark.read.schema(tried.schema).parquet(self.part("tried", batch))
        own = [c for c in rows.columns]
        failed = F.col("error").isNotNull()
        tables = {
            "done": tried.filter("result is not null").select(*own, TRIES, "result"),
            "dead": tried.filter(failed & (F.col(TRIES) >= self.tries)).select(*own, TRIES, "error"),
            "waiting": tried.filter("result is null").filter(~failed | (F.col(TRIES) < self.tries)).select(*own, TRIES, DUE),
        }
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.part(name, batch))
        counts = tried.agg(
            F.count(F.lit(1)).alias("rows"), F.count("result").alias("done"), F.sum((failed & (F.col(TRIES) >= self.tries)).cast("long")).alias("dead"), F.sum(failed.cast("long")).alias("failures"), F.sum(F.col("error").startswith("TooSlow").cast("long")).alias("slow"),
        ).first()
        row = {"batch_id": batch, "rows": counts.rows, "done": counts.done, "dead": counts.dead or 0, "failures": counts.failures or 0, "slow": counts.slow or 0, "seconds": float(self.clock() - began)}
        row["waiting"] = row["rows"] - row["done"] - row["dead"]
        spark.createDataFrame([row], "batch_id long, rows long, done long, dead long, failures long, slow long, seconds double, waiting long").coalesce(1).write.mode("overwrite").parquet(self.part("batches", batch))
        if self.on_complete:
            try:
                self.on_complete(row)
            except Exception as e:  # noqa: BLE001  a listener's error is its own
                self.errors.append(f"batch {batch}: {e}")

    def _tried(self, todo: DataFrame, now: float) -> DataFrame:
        """``todo`` with result and error after a try of the rows that are due."""
        columns, process, seconds, backoff = [c for c in todo.columns if c not in (TRIES, DUE)], self.process, self.seconds, self.backoff

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                tries, due, result, error = batch[TRIES].tolist(), batch[DUE].tolist(), [None] * len(batch), [None] * len(batch)
                for k, row in enumerate(batch[columns].itertuples(index=False)):
                    if due[k] > now:
                        continue
                    try:
                        result[k] = str(limited(process, row, tries[k], seconds))
                    except Exception as e:  # noqa: BLE001  any error is the row's
                        error[k] = f"{type(e).__name__}: {e}"
                        due[k] = now + backoff * 2 ** tries[k]
                    tries[k] += 1
                yield batch.assign(**{TRIES: pd.array(tries, "int32"), DUE: due, "result": result, "error": error})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema) + ", result string, error string"
        return todo.mapInPandas(each, schema)

    def last(self) -> int:
        """The number of the last complete batch, -1 before the first."""
        return -1 if not self._any("batches") else self.table("batches", "batch_id long").agg(F.max("batch_id")).first()[0]

    def _any(self, table: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def table(self, name: str, schema: str) -> DataFrame:
        """All parts of ``done``, ``dead``, ``waiting`` or ``batches``."""
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def finish(self, schema: str) -> None:
        """After the stream's end: batches without new rows until nothing waits. Waits, on the driver, for the next row that falls due."""
        while (batch := self.last()) >= 0:
            due = self.spark.read.schema(f"{schema}, {TRIES} int, {DUE} double").parquet(self.part("waiting", batch)).agg(F.min(DUE)).first()[0]
            if due is None:
                return
            time.sleep(max(0.0, due - self.clock()))
            self(self.spark.createDataFrame([], schema), batch + 1)


def drain(stream: DataFrame, guard: Guard) -> None:
    """Everything that the source holds through the guard, then what waits."""
    query = stream.writeStream.foreachBatch(guard).option("checkpointLocation", f"{guard.folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    guard.finish(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema))
