"""Counters and an event log of streaming queries: observed metrics, and a listener whose subscribers can't hinder each other."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

LOG = "seq long, kind string, run_id string, batch_id long, name string, value long, detail string"
ALL = "*"


def counted(stream: DataFrame, name: str, **conditions: Column) -> DataFrame:
    """``stream`` with the observed counts ``rows`` and one for each condition; they cost no pass of their own."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, F.lit(1))).alias(k) for k, c in conditions.items()])


class EventLog(StreamingQueryListener):
    """Events of kinds ``started``, ``progress``, ``idle``, ``terminated``, and ``count``, one for each observed counter.

    Subscribers of a kind, or of all kinds (``*``), get each event as a dict. An error of one is an event of kind ``fault`` in the log and
    reaches no other. Rows gather on the driver, at most ``most`` between two calls of :meth:`flush`, which appends them to a table; beyond
    that the log flushes itself.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 1000) -> None:
        self.spark, self.path, self.most = spark, path, most
        self.rows: list[tuple] = []
        self.seq = 0
        self.subscribers: dict[str, list[Callable[[dict], None]]] = {}
        self.lock = threading.RLock()

    def subscribe(self, kind: str, handler: Callable[[dict], None]) -> Callable[[], None]:
        """Gives back what ends the subscription."""
        with self.lock:
            self.subscribers.setdefault(kind, []).append(handler)
        return lambda: self.subscribers[kind].remove(handler) if handler in self.subscribers.get(kind, []) else None

    def emit(self, kind: str, run_id: str = "", batch_id: int | None = None, name: str = "", value: int | None = None, detail: str = "") -> None:
        event = {"kind": kind, "run_id": run_id, "batch_id": batch_id, "name": name, "value": value, "detail": detail}
        with self.lock:
            self._keep(event)
            handlers = [*self.subscribers.get(kind, []), *self.subscribers.get(ALL, [])]
        for handler in handlers:
            try:
                handler(dict(event))
            except Exception as e:  # noqa: BLE001  a subscriber's error is its own
                with self.lock:
                    self._keep({**event, "kind": "fault", "detail": f"{type(e).__name__}: {e}"})

    def _keep(self, event: dict) -> None:
        self.rows.append((self.seq, *(event[k] for k in ("kind", "run_id", "batch_id", "name", "value", "detail"))))
        self.seq += 1
        if len(self.rows) >= self.most:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(LOG).parquet(self.path)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self.emit("started", str(event.runId), name=event.name or "")

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        self.emit("progress", str(p.runId), p.batchId, p.name or "", p.numInputRows, json.dumps(p.durationMs, sort_keys=True))
        for metric, row in (p.observedMetrics or {}).items():
            for name, value in row.asDict().items():
                self.emit("count", str(p.runId), p.batchId, f"{metric}.{name}", value)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        self.emit("idle", str(event.runId))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        self.emit("terminated", str(event.runId), detail=event.exception or "")


@contextmanager
def listening(log: EventLog) -> Iterator[EventLog]:
    """The log hears the queries that run inside; leaving waits until all their events have come."""
    log.spark.streams.addListener(log)
    try:
        yield log
    finally:
        log.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        log.spark.streams.removeListener(log)
        log.flush()
