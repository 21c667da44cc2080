"""Table functions against the frames that hold whole groups."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import sheets, table_functions


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(1)
    rows = [(k % 4, k, rng.choice((8, 16, 40, 300)), rng.randint(1, 40), rng.randint(1, 40_000)) for k in range(500)]
    return spark.createDataFrame(rows, "sheet int, ord int, w int, h int, bytes long").repartition(6)


def told(df, *columns):
    return sorted(map(tuple, df.select("sheet", "ord", *columns).collect()))


def test_rows(frames):
    assert repr(told(table_functions.row_packed(frames, "sheet", "ord", 100, 2), "x", "y", "page")) == repr(told(sheets.packed(frames, "sheet", "ord", "row", 100, 2), "x", "y", "page"))


def test_banks(frames):
    assert told(table_functions.banked(frames, "sheet", "ord"), "bank") == told(sheets.banks(frames, "sheet", "ord"), "bank")


def test_wrong_calls(frames):
    for wrong in (lambda: table_functions.row_packed(frames.withColumn("x", F.lit(1)), "sheet", "ord"), lambda: table_functions.banked(frames.drop("bytes").withColumn("bytes2", F.lit(1)), "sheet", "ord", size="ord2")):
        with pytest.raises(Exception, match="column"):
            wrong().collect()
    assert table_functions.row_packed(frames.limit(0), "sheet", "ord").count() == 0


def test_batches_that_cut_groups(spark, frames):
    """Folds go on from one batch to the next, and rows reach Python in batches, not one by one."""
    whole = told(table_functions.row_packed(frames, "sheet", "ord", 100, 2), "x", "y", "page"), told(table_functions.banked(frames, "sheet", "ord"), "bank")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert (told(table_functions.row_packed(frames, "sheet", "ord", 100, 2), "x", "y", "page"), told(table_functions.banked(frames, "sheet", "ord"), "bank")) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = table_functions.row_packed(frames, "sheet", "ord")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BatchEvalPythonUDTF" not in plan
    empty = frames.withColumn("sheet", F.when(F.col("sheet") > 1, F.col("sheet")))  # null is a key like any other
    assert repr(told(table_functions.row_packed(empty.filter("sheet is null"), "sheet", "ord"), "x", "y")) == repr(told(table_functions.row_packed(empty, "sheet", "ord").filter("sheet is null"), "x", "y"))
