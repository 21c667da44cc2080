"""Streaming queries, drained into tables: the same results as their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import place
from ..streaming import counters, guarded, timers, watch
from . import fixtures as fx
from . import folds


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = fx.table(spark, sf_dir, "events").schema
    s = watch.changes(spark, f"{sf_dir}/event[s].parquet", schema, files_per_trigger=64)  # a pattern: a stream takes no single file by name
    return s.select("event_id", F.col("user_id").alias("path"), F.floor(F.col("user_id") / 16).alias("watcher"), F.col("event_type").alias("change"), F.md5("props").alias("hash"), F.col("ts").cast("timestamp").alias("ts"))


def stream_change_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("hash", F.when(F.col("change") == "error", F.lit(None)).otherwise(F.substring("hash", 1, 1)))
    return watch.drained(watch.real_changes(e, "path", ("ts", "event_id")), "changes").select("event_id", "path", "kind")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "watcher", (F.unix_micros("ts") / F.lit(1e6)).alias("at"))
    return watch.drained(watch.rate_limited(e, "watcher", ("at", "event_id"), 5, 3600.0 * 4), "limited")


def stream_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "watcher", (F.unix_micros("ts") / F.lit(1e6)).alias("at"), (F.col("change") != "error").alias("ok"))
    return watch.drained(watch.circuit_broken(e, "watcher", ("at", "event_id"), 2, 3600.0 * 12), "breaker")


def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bursts of the events, by timers."""
    e = _events(spark, sf_dir).select("event_id", "path", "change", F.unix_micros("ts").alias("at"))
    end = fx.table(spark, sf_dir, "events").agg(F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()[0] or 0
    bursts = timers.all_bursts(e, "path", ("at", "event_id"), end, quiet=4 * 3600.0, late="1 hour", late_seconds=3600.0)
    return bursts.select("event_id", "path", "change", F.timestamp_micros("first").cast("timestamp_ntz").alias("first"), "n")


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of the rate-limited events, as the event log has them, added up over all batches."""
    e = _events(spark, sf_dir).select("event_id", "watcher", (F.unix_micros("ts") / F.lit(1e6)).alias("at"))
    limited = watch.rate_limited(e, "watcher", ("at", "event_id"), 5, 3600.0 * 4)
    with counters.listening(counters.EventLog(spark, place(spark, "event-log"))) as log:
        watch.drained(counters.counted(limited, "changes", allowed=F.col("allowed"), rejected=~F.col("allowed")), "counted")
    return log.table().filter("kind = 'count'").groupBy("name").agg(F.sum("value").alias("n"))


def _checked(row: tuple, attempt: int) -> str:
    """A step that always fails on some errors and, at the first try, on some clicks."""
    if row.change == "error" and row.event_id % 3 == 0:
        raise ValueError(f"event {row.event_id}")
    if row.change == "click" and row.event_id % 5 == 0 and attempt == 0:
        raise OSError("not now")
    return f"{row.change}-{row.event_id}"


def stream_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a step that fails on some: results, and dead letters after two tries."""
    e = _events(spark, sf_dir).select("event_id", "change")
    guard = guarded.Guard(spark, _checked, seconds=10.0, tries=2, backoff=0.0)
    guarded.drain(e, guard)
    done = guard.table("done", "event_id long, change string, tries int, result string").select("event_id", F.lit("done").alias("fate"), "tries", F.col("result").alias("what"))
    dead = guard.table("dead", "event_id long, change string, tries int, error string").select("event_id", F.lit("dead").alias("fate"), "tries", F.col("error").alias("what"))
    return done.unionByName(dead)


QUERIES = {f.__name__: f for f in (stream_change_dedup, stream_rate_limit, stream_circuit_breaker, stream_debounce, stream_counts, stream_guarded)}
ORACLE_SQL = {"stream_debounce": folds.ORACLE_SQL["debounce_sessions"], "stream_change_dedup": folds.ORACLE_SQL["change_dedup"], "stream_rate_limit": folds.ORACLE_SQL["rate_limit"], "stream_circuit_breaker": folds.ORACLE_SQL["circuit_breaker"], "stream_counts": f"""WITH r AS ({folds.ORACLE_SQL["rate_limit"]}) SELECT 'changes.' || name AS name, CAST(n AS BIGINT) AS n FROM (SELECT 'rows' AS name, count(*) AS n FROM r UNION ALL SELECT 'allowed', count(*) FILTER (allowed) FROM r UNION ALL SELECT 'rejected', count(*) FILTER (NOT allowed) FROM r)""",
    "stream_guarded": """SELECT event_id, CASE WHEN poison THEN 'dead' ELSE 'done' END AS fate, CAST(CASE WHEN poison OR late THEN 2 ELSE 1 END AS INTEGER) AS tries, CASE WHEN poison THEN 'ValueError: event ' || event_id ELSE event_type || '-' || event_id END AS what
        FROM (SELECT event_id, event_type, event_type = 'error' AND event_id % 3 = 0 AS poison, event_type = 'click' AND event_id % 5 = 0 AS late FROM events)""",
}
