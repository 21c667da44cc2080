"""Debounce with event-time timers: a burst comes out when the watermark has passed its quiet time, the last ones too."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.storage import place

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Marks a row that only tells the time. Names that start with an underscore reach a processor as numbers.
BEAT = "beat__"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for the queries started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Debounce(StatefulProcessor):
    """Rows wait in a list state until the watermark has passed them, so bursts are the same whatever order the rows come in; a value state
    holds the open burst. A key has one timer: when its first waiting row could end a burst, or when its open burst could.
    """

    def __init__(self, columns: Sequence[str], order: Sequence[str], at: str, quiet: int, waiting: str, burst: str) -> None:
        self.columns, self.order, self.quiet, self.waiting_schema, self.burst_schema = list(columns), [list(columns).index(o) for o in order], quiet, waiting, burst
        self.at = self.columns.index(at)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.burst = handle.getValueState("burst", self.burst_schema)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = []
        for batch in rows:
            own = batch[~batch[BEAT]][self.columns]
            new += [tuple(None if x is pd.NA or x != x else x.item() if hasattr(x, "item") else x for x in r) for r in own.itertuples(index=False, name=None)]
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[self.at] for r in new) + self.quiet)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple(r[o] for o in self.order))
        ready, later = [r for r in rows if r[self.at] <= now], [r for r in rows if r[self.at] > now]
        held = self.burst.get() if self.burst.exists() else None
        burst = list(held) if held is not None else None  # the last row, its first time and its count
        out = []
        for r in ready:
            if burst is not None and r[self.at] < burst[self.at] + self.quiet:
                burst = [*r, burst[-2], burst[-1] + 1]
            else:
                if burst is not None:
                    out.append(burst)
                burst = [*r, r[self.at], 1]
        if burst is not None and burst[self.at] + self.quiet <= now:
            out.append(burst)
            burst = None
        self.waiting.put(later) if later else self.waiting.clear()
        self.burst.update(tuple(burst)) if burst is not None else self.burst.clear()
        ahead = [later[0][self.at]] if later else []
        if burst is not None:
            ahead.append(burst[self.at])
        if ahead:
            self._wake(min(ahead) + self.quiet)
        if out:
            yield pd.DataFrame(out, columns=[*self.columns, "first", "n"])

    def _wake(self, micros: int) -> None:
        """One timer, at the earliest of what was asked for; in milliseconds, rounded up."""
        at = -(-micros // 1000)
        if self.timer.exists():
            (before,) = self.timer.get()
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, key: str, order: Sequence[str], at: str = "at", quiet: float = 1.0, late: str = "1 minute") -> DataFrame:
    """The last row of every burst of a key with first (the burst's first ``at``) and n; ``at`` is in microseconds, as is ``first``.

    A burst ends where nothing follows for ``quiet`` seconds. Rows may come in any order within ``late``. ``stream`` has the column BEAT, as
    :func:`with_beats` gives it. A key's state is what came in the last ``late`` and one open burst.
    """
    columns = [f for f in stream.schema.fields if f.name != BEAT]
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    timed = stream.withColumn("time__", F.timestamp_micros(at)).withWatermark("time__", late)
    processor = Debounce([f.name for f in columns], order, at, round(quiet * 1e6), plain, f"{plain}, `first` long, `n` long")
    # The key's name mustn't be a column that pandas would have to keep apart.
    return timed.withColumn("key__", F.col(key)).groupBy("key__").transformWithStateInPandas(processor, f"{plain}, `first` long, `n` long", "append", "EventTime")


def with_beats(stream: DataFrame, folder: str, at: str = "at") -> DataFrame:
    """``stream`` together with the rows of ``folder`` that only tell the time; these reach the watermark and are in no burst."""
    schema = StructType([f for f in stream.schema.fields if f.name == at])
    beats = stream.sparkSession.readStream.schema(schema).parquet(folder)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != at else F.col(at) for f in stream.schema.fields]
    return stream.withColumn(BEAT, F.lit(False)).unionByName(beats.select(*nothing).withColumn(BEAT, F.lit(True)))


def beat(spark: SparkSession, folder: str, micros: int | None, at: str = "at") -> None:
    """Tell the time to the streams that read ``folder``; None makes the folder only."""
    spark.createDataFrame([] if micros is None else [(micros,)], f"`{at}` long").write.mode("append").parquet(folder)


def all_bursts(stream: DataFrame, key: str, order: Sequence[str], end: int, at: str = "at", quiet: float = 1.0, late: str = "1 minute", late_seconds: float = 60.0) -> DataFrame:
    """:func:`debounced` over everything that the source holds, in a table of the shared folder.

    The stream runs until the source is drained; then a beat past ``end`` (microseconds, the last time that the source may hold) tells it that
    time has gone on, and it runs again from its checkpoint, so the bursts still open come out as well.
    """
    spark = stream.sparkSession
    path, beats = place(spark, "bursts"), place(spark, "beats")
    beat(spark, beats, None, at)
    with rocks(spark):
        bursts = debounced(with_beats(stream, beats, at), key, order, at, quiet, late)
        for last in (False, True):
            if last:
                beat(spark, beats, end + round((quiet + late_seconds + 1) * 1e6), at)
            query = bursts.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(bursts.schema).parquet(path)
