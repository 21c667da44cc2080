"""Sheets of pixels at size: how they are dealt to tasks, and that nothing made of them is broadcast."""

from __future__ import annotations

import os

import pytest

from tesserae.plans import catalog
from tesserae.plans.segments import SHEETS_A_TASK, sheets


@pytest.fixture(scope="module")
def many(spark, sf_dir, tmp_path_factory):
    """The small tables with so many suppliers that their sheets take four tasks."""
    folder = tmp_path_factory.mktemp("many")
    for name in os.listdir(sf_dir):
        if name != "supplier.parquet":
            os.symlink(f"{sf_dir}/{name}", folder / name)
    spark.range(3 * SHEETS_A_TASK + 1).withColumnRenamed("id", "s_suppkey").write.parquet(str(folder / "supplier.parquet"))
    return str(folder)


def test_sheets_are_dealt_to_as_many_tasks_as_they_need(spark, many):
    assert sheets(spark, many).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["background_map", "tile_two_colours", "strip_loop", "sheet_text_regions", "sheet_boxes", "sheet_boxes_tolerant", "sprite_shadow", "sprite_glow"])
def test_nothing_made_of_pixels_is_broadcast(spark, many, name):
    """Estimates know nothing of what comes out of lists, so a join would take the pixels for small."""
    plan = catalog.QUERIES[name](spark, many)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    if name.startswith("sprite"):
        assert "SortMergeJoin" not in plan and plan.count("Exchange") == 1


@pytest.mark.parametrize("cover", [False, True])
def test_scaled_gathers_only_what_it_shows(spark, cover):
    from tesserae.operators import images

    px = spark.createDataFrame([(1, x, y, 10 * x + y, 0, 0, 255) for x in range(6) for y in range(6) if (x, y) != (3, 3)], "image int, x int, y int, r int, g int, b int, a int")
    scaled = images.scaled(px, "image", 6, 6, 4, 3, cover)
    plan = scaled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and "SortMergeJoin" not in plan
    got = {(r.x, r.y): (r.r, r.a) for r in scaled.collect()}
    n, left, top = (4, 0, (3 - 4) // 2) if cover else (3, (4 - 3) // 2, 0)
    want = {}
    for x in range(4):
        for y in range(3):
            inside = left <= x < left + n and top <= y < top + n
            sx, sy = (2 * (x - left) + 1) * 6 // (2 * n), (2 * (y - top) + 1) * 6 // (2 * n)
            want[x, y] = (10 * sx + sy, 255) if inside and (sx, sy) != (3, 3) else (0, 0)
    assert got == want


def test_seams_have_their_counterparts(spark, sf_dir):
    """The first eight columns meet those at the right end: pixels are drawn towards them."""
    from pyspark.sql import functions as F

    from tesserae.plans import fixtures as fx
    from tesserae.plans import pixels

    own = fx.colours(spark, sf_dir).select((F.col("p_partkey") % 7).cast("int").alias("image"), (F.floor(F.col("p_partkey") / 7) % 32).cast("int").alias("x"), F.floor(F.col("p_partkey") / 224).cast("int").alias("y"), F.col("r").alias("was"))
    drawn = pixels.pixel_seam(spark, sf_dir).filter("x < 8").join(own, ["image", "x", "y"])
    assert drawn.filter("r <> was").count() * 2 > drawn.count()


def test_levels_are_dealt_to_as_many_tasks_as_they_need(spark, tmp_path):
    from pyspark.sql import functions as F

    from tesserae.plans import rules

    spark.read.parquet(f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/customer.parquet").limit(1).drop("c_custkey").crossJoin(spark.range(2 * rules.LEVELS_A_TASK + 1).select(F.col("id").alias("c_custkey"))).write.parquet(str(tmp_path / "customer.parquet"))
    assert rules._levels(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_issues_of_levels_broadcast_no_cells(spark, sf_dir):
    plan = catalog.QUERIES["level_issues"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" not in plan and "LeftOuter, BuildRight" not in plan
