"""Bursts by timers: whatever the batches and the order inside the lateness, and those that are open when the source ends."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.streaming import timers

SCHEMA = "id long, path string, at long"
SECOND = 1_000_000


def plain(rows, quiet):
    out = []
    for path in {r[1] for r in rows}:
        burst: list = []
        for r in sorted((r for r in rows if r[1] == path), key=lambda r: (r[2], r[0])):
            if burst and r[2] >= burst[-1][2] + quiet:
                out.append((*burst[-1], burst[0][2], len(burst)))
                burst = []
            burst.append(r)
        out.append((*burst[-1], burst[0][2], len(burst)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("files", [1, 6])
def test_all_bursts(spark, tmp_path, files):
    """Rows come up to 50 seconds late; ties of time; a key that is null; a gap of exactly the quiet time."""
    rng = random.Random(files)
    rows = [(k, rng.choice(["a", "b", None]), 10**15 + rng.randrange(600) * SECOND) for k in range(120)]
    rows += [(900, "edge", 10**15), (901, "edge", 10**15 + 5 * SECOND), (902, "edge", 10**15 + 10 * SECOND - 1), (903, "edge", 10**15 + 590 * SECOND), (904, "edge", 10**15 + 590 * SECOND)]
    rows.sort(key=lambda r: r[2] + rng.randrange(50) * SECOND)
    step = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * step : (k + 1) * step], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = timers.all_bursts(stream, "path", ("at", "id"), max(r[2] for r in rows), quiet=5.0, late="1 minute")
    assert sorted((tuple(r) for r in got.select("id", "path", "at", "first", "n").collect()), key=repr) == plain(rows, 5 * SECOND)


def test_provider_is_given_back(spark, tmp_path):
    before = spark.conf.get(timers.PROVIDER, None)
    with pytest.raises(ZeroDivisionError), timers.rocks(spark):
        assert spark.conf.get(timers.PROVIDER) == timers.ROCKS
        raise ZeroDivisionError
    assert spark.conf.get(timers.PROVIDER, None) == before


def test_beats_alone_make_no_burst(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "none"))
    assert timers.all_bursts(stream, "path", ("at", "id"), 10**15, quiet=5.0).select(F.count("*")).first()[0] == 0
