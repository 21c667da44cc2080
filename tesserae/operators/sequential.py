"""Folds in order: debounce, change dedup, rate limits, circuit breakers, and the general sorted fold behind them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sorted_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object], step: Callable, out: str, kind: str) -> DataFrame:
    """``df`` with ``out``: ``step(state, row)`` over each group's rows in order, one row at a time, the state starting anew with each group.

    Rows are dealt by key and sorted by Spark, which spills; a task keeps one group's state only, never a group's rows.
    """
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out}` {kind}"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for batch in batches:
            found = []
            for key, row in zip(batch[list(keys)].itertuples(index=False, name=None), batch.itertuples(index=False), strict=True):
                if key != group:
                    group, state = key, start()
                found.append(step(state, row))
            yield batch.assign(**{out: found})

    return dealt.mapInPandas(each, schema)


def rate_limited(events: DataFrame, keys: Sequence[str], order: Sequence[str], most: int = 60, seconds: float = 60.0, seconds_col: str = "at") -> DataFrame:
    """``events`` with ``allowed``: fewer than ``most`` were allowed in the last ``seconds``; those that aren't don't count."""

    def step(times: deque, row: tuple) -> bool:
        now = getattr(row, seconds_col)
        while times and now - times[0] > seconds:
            times.popleft()
        if len(times) >= most:
            return False
        times.append(now)
        return True

    return sorted_fold(events, keys, order, deque, step, "allowed", "boolean")


def circuit_broken(outcomes: DataFrame, keys: Sequence[str], order: Sequence[str], errors: int = 5, cooldown: float = 60.0, seconds_col: str = "at", ok_col: str = "ok") -> DataFrame:
    """``outcomes`` with ``state``: ``open`` if the breaker rejects the row; else ``ok`` or ``error``, whose run of ``errors`` opens it for ``cooldown`` seconds."""

    def step(state: dict, row: tuple) -> str:
        now = getattr(row, seconds_col)
        if state["opened"] is not None:
            if now - state["opened"] < cooldown:
                return "open"
            state.update(opened=None, run=0)
        if getattr(row, ok_col):
            state.update(opened=None, run=0)
            return "ok"
        state["run"] += 1
        if state["run"] >= errors:
            state["opened"] = now
        return "error"

    return sorted_fold(outcomes, keys, order, lambda: {"run": 0, "opened": None}, step, "state", "string")


def debounced(changes: DataFrame, key: str, order: Sequence[str], ts: str = "ts", quiet: str = "1 second") -> DataFrame:
    """The last change of every burst: bursts end where nothing follows for ``quiet``. Adds first (time) and n (changes)."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.col(ts) >= F.lag(ts).over(w) + F.expr(f"interval {quiet}")
    c = changes.withColumn("__burst", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy(key, "__burst")
    c = c.withColumn("first", F.min(ts).over(g)).withColumn("n", F.count(F.lit(1)).over(g)).withColumn("__last", F.row_number().over(g.orderBy(*[F.desc(o) for o in order])))
    return c.filter("__last = 1").drop("__burst", "__last")


def real_changes(changes: DataFrame, key: str, order: Sequence[str], hash_col: str = "hash") -> DataFrame:
    """Changes whose hash differs from the one before of the same key, with ``kind``: created, modified or deleted (a null hash).

    A deletion forgets the hash, and deletions always pass; A, B, A are three changes.
    """
    before = F.lag(hash_col).over(Window.partitionBy(key).orderBy(*order))
    kind = F.when(F.col(hash_col).isNull(), "deleted").when(F.col("__before").isNull(), "created").otherwise("modified")
    c = changes.withColumn("__before", before).withColumn("kind", kind)
    return c.filter(F.col(hash_col).isNull() | F.col("__before").isNull() | (F.col("__before") != F.col(hash_col))).drop("__before")
