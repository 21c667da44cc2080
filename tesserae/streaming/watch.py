"""File-change streams: debounce by session windows with a watermark, and keyed state for change dedup, rate limits and circuit breakers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.storage import place


def changes(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", suffixes: tuple[str, ...] = (), ignore: tuple[str, ...] = (), path_col: str = "path", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of change rows from a folder of files; rows whose path has another suffix, or matches one of the ``ignore`` patterns (* and ?), are left out."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    out = reader.load(path)
    if suffixes:
        out = out.filter(F.lower(F.col(path_col)).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    for pattern in ignore:
        like = pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".")
        out = out.filter(~F.col(path_col).rlike(f"(^|/){like}$"))
    return out


def debounced(stream: DataFrame, key: str, ts: str = "ts", quiet: str = "1 second", late: str = "1 minute", last: tuple[str, ...] = ("hash",)) -> DataFrame:
    """One row per burst of a key once the watermark has passed it: the last values, first and last time, count. ``ts`` is cast to timestamp, which watermarks need."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = s.groupBy(key, F.session_window(ts, quiet).alias("burst"))
    return g.agg(*[F.max_by(c, ts).alias(c) for c in last], F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).drop("burst")


def _stateful(stream: DataFrame, key: str, order: tuple[str, ...], state: str, start: Callable[[], tuple], step: Callable[[list, Any], Any], out: str, kind: str) -> DataFrame:
    """Rows of each key in ``order`` inside a micro-batch, with what ``step`` makes of a row and the key's state, a list of its fields."""

    def each(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = [list(x) if isinstance(x, (list, tuple)) else x for x in (held.get if held.exists else start())]
        # a micro-batch's rows of a key, sorted: its size is bounded by the trigger's options
        rows = pd.concat(list(batches)).sort_values(list(order), kind="stable")
        found = [step(now, r) for r in rows.itertuples(index=False)]
        held.update(tuple(now))
        yield rows.assign(**{out: found})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + f", `{out}` {kind}"
    return stream.groupBy(key).applyInPandasWithState(each, schema, state, "append", GroupStateTimeout.NoTimeout)


def real_changes(stream: DataFrame, key: str, order: tuple[str, ...], hash_col: str = "hash") -> DataFrame:
    """Changes whose hash isn't the last one of their key, with ``kind``: created, modified or deleted; other rows are dropped."""

    def step(state: list, row: Any) -> str | None:
        value = getattr(row, hash_col)
        if value is None or value != value:
            state[0] = None
            return "deleted"
        old, state[0] = state[0], value
        return None if old == value else "created" if old is None else "modified"

    return _stateful(stream, key, order, "last string", lambda: (None,), step, "kind", "string").filter("kind is not null")


def rate_limited(stream: DataFrame, key: str, order: tuple[str, ...], most: int = 60, seconds: float = 60.0, at: str = "at") -> DataFrame:
    """With ``allowed``; the state of a key is at most ``most`` times."""

    def step(state: list, row: Any) -> bool:
        now = getattr(row, at)
        state[0] = [t for t in state[0] if now - t <= seconds]
        if len(state[0]) >= most:
            return False
        state[0].append(float(now))
        return True

    return _stateful(stream, key, order, "times array<double>", lambda: ([],), step, "allowed", "boolean")


def circuit_broken(stream: DataFrame, key: str, order: tuple[str, ...], errors: int = 5, cooldown: float = 60.0, at: str = "at", ok: str = "ok") -> DataFrame:
    """With ``state``: open, ok or error. A key's state is a count and the time of opening."""

    def step(state: list, row: Any) -> str:
        now = getattr(row, at)
        if state[1] is not None:
            if now - state[1] < cooldown:
                return "open"
            state[:] = [0, None]
        if getattr(row, ok):
            state[:] = [0, None]
            return "ok"
        state[0] += 1
        if state[0] >= errors:
            state[1] = float(now)
        return "error"

    return _stateful(stream, key, order, "run int, opened double", lambda: (0, None), step, "state", "string")


def split_overflow(changes: DataFrame, most: int, key: str, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """For ``foreachBatch``: each key's first ``most`` changes, and those that its bounded queue drops."""
    ranked = changes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("__n") <= most).drop("__n"), ranked.filter(F.col("__n") > most).drop("__n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that the source holds now, run through the stream into a table of the shared folder; the checkpoint lies beside it."""
    spark = stream.sparkSession
    path = place(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
