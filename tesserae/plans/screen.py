"""Screen queries: scanlines, transfers, sprite tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import tiles as T
from ..operators import screen as ops
from . import fixtures as fx


def scanline_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scanline_load(fx.sprites(spark, sf_dir), ["scene"])


def scanline_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.violations(scanline_load(spark, sf_dir))


def worst_scanline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.worst_line(scanline_load(spark, sf_dir), ["scene"])


def heat_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overlay_class(scanline_load(spark, sf_dir), fx.sprites(spark, sf_dir), "scene")


def dma_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the tiles of a part: 32 a tile."""
    s = fx.sprites(spark, sf_dir).withColumn("bytes", (F.col("w") * F.col("h") / 64).cast("long") * 32)
    return ops.transfer(s, ["l_partkey"], "bytes")


def layout_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hints(scanline_load(spark, sf_dir), fx.sprites(spark, sf_dir), "scene")


def link_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprite table entries: each links to the next of its order, the last to 0."""
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    s = fx.sprites(spark, sf_dir).groupBy("l_orderkey", *order).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("w").alias("w"), F.min("h").alias("h"))
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    i = F.row_number().over(w) - 1
    s = s.withColumn("i", i).withColumn("link", F.coalesce(F.lead("i").over(w), F.lit(0)))
    no = F.lit(False)
    entry = T.sprite_words(F.col("x"), F.col("y"), T.tiles_across(F.col("w")), T.tiles_across(F.col("h")), (F.col("l_partkey") % 2048).cast("int"), F.col("link"), (F.col("l_suppkey") % 4).cast("int"), no, F.col("l_linenumber") % 2 == 0, no)
    return s.select("l_orderkey", *order, "link", entry.alias("entry"))


QUERIES = {f.__name__: f for f in (scanline_load, scanline_violations, worst_scanline, heat_class, dma_budget, layout_hints, link_next)}

_LOAD = f"{fx.SPRITES}, load AS (SELECT scene, CAST(scanline AS INTEGER) AS scanline, count(*) AS sprites, CAST(sum(w) AS BIGINT) AS pixels FROM (SELECT scene, w, unnest(range(greatest(0, y), least({dims.SCREEN_LINES}, y + h))) AS scanline FROM sprites) GROUP BY 1, 2)"

ORACLE_SQL = {
    "scanline_load": f"WITH {_LOAD} SELECT * FROM load",
    "scanline_violations": f"WITH {_LOAD} SELECT *, greatest(sprites - 20, 0) AS lost, pixels > 320 AS too_wide FROM load WHERE sprites > 20 OR pixels > 320",
    "worst_scanline": f"WITH {_LOAD} SELECT scene, scanline, sprites FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY sprites DESC, scanline) AS k FROM load) WHERE k = 1",
    "heat_class": f"""WITH {_LOAD}, g AS (SELECT DISTINCT scene FROM sprites), f AS (SELECT scene, unnest(range(224)) AS scanline FROM g), n AS (SELECT scene, f.scanline, coalesce(sprites, 0) AS n FROM f LEFT JOIN load USING (scene, scanline))
        SELECT scene, CAST(scanline AS INTEGER) AS scanline, CASE WHEN n = 0 THEN 0 WHEN n <= 10 THEN 1 WHEN n <= 15 THEN 2 WHEN n < 20 THEN 3 ELSE 4 END AS heat FROM n""",
    "dma_budget": f"""WITH {fx.SPRITES}, t AS (SELECT l_partkey, CAST(sum(w * h // 64 * 32) AS BIGINT) AS bytes FROM sprites GROUP BY 1)
        SELECT l_partkey, bytes, CAST(floor(bytes::DOUBLE / 168 * 10) AS BIGINT) AS tenths, CAST(floor(bytes::DOUBLE / 168 * 1000 / 40) AS BIGINT) AS per_mille, CASE WHEN bytes::DOUBLE / 168 > 40 THEN 'over' WHEN bytes::DOUBLE / 168 > 30 THEN 'near' ELSE 'fits' END AS verdict FROM t""",
    "layout_hints": f"""WITH {_LOAD}, l AS (SELECT scene, count(*) FILTER (sprites > 20) AS bad, count(*) FILTER (pixels > 320) AS wide, max(sprites) AS most FROM load GROUP BY 1), t AS (SELECT scene, count(*) AS total FROM sprites GROUP BY 1)
        SELECT scene, total, coalesce(bad, 0) AS bad, coalesce(wide, 0) AS wide, coalesce(most, 0) AS most, array_to_string(list_filter([CASE WHEN bad > 0 THEN 'stagger' END, CASE WHEN most - 20 > 5 THEN 'combine' END, CASE WHEN bad > 10 THEN 'redesign' END,
        CASE WHEN total > 64 THEN 'background' END, CASE WHEN wide > 0 THEN 'narrow' END, CASE WHEN bad > 0 OR total > 80 THEN 'multiplex' END], lambda x: x IS NOT NULL), ',') AS hints FROM t LEFT JOIN l USING (scene)""",
    "link_next": f"""WITH {fx.SPRITES}, s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(x) AS x, min(y) AS y, min(w) AS w, min(h) AS h FROM sprites GROUP BY 1, 2, 3, 4),
        i AS (SELECT *, row_number() OVER v - 1 AS i FROM s WINDOW v AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
        n AS (SELECT *, CAST(coalesce(lead(i) OVER v, 0) AS INTEGER) AS link FROM i WINDOW v AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, link, printf('%04X%04X%04X%04X', (y + 128) & 1023, (((w + 7) // 8 - 1) * 4 + (h + 7) // 8 - 1) * 256 + (link & 127),
        l_partkey % 2048 + CASE WHEN l_linenumber % 2 = 0 THEN 2048 ELSE 0 END + l_suppkey % 4 * 8192, (x + 128) & 1023) AS entry FROM n""",
}
