"""Pixel and style queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels as ops
from . import fixtures as fx


def _pixels(spark: SparkSession, sf_dir: str, image: Column | None = None) -> DataFrame:
    """Parts as pixels of images 32 wide; every fifth is clear. ``image``: which image, by default one for a range of parts."""
    k = F.col("p_partkey")
    c = fx.colours(spark, sf_dir)
    return c.select(F.col("image") if image is None else image.alias("image"), (F.floor(k / 7) % 32).cast("int").alias("x"), F.floor(k / 224).cast("int").alias("y"), "r", "g", "b", F.when(k % 5 == 0, 0).otherwise(255).alias("a"))


def pixel_tint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tint(_pixels(spark, sf_dir), (255, 128, 0), 0.5)


def pixel_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.outline(_pixels(spark, sf_dir), "image", 2)


def pixel_seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over seven images that hold all columns of every line, so that the first columns have their counterparts at the right end."""
    return ops.seam(_pixels(spark, sf_dir, (F.col("p_partkey") % 7).cast("int")), "image", 32, 8)


def style_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.style(_pixels(spark, sf_dir), ["image"])


def chr_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.frame_banks(fx.frames(spark, sf_dir).select("seq", "frame", "ticks"), ["seq"], "frame", "ticks", 8)


def mirror_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = fx.table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").groupBy((F.col("p_partkey") % 50).alias("hero"), F.pmod(F.col("p_size"), F.lit(8)).alias("direction")).agg(F.min("p_partkey").alias("sheet"))
    return ops.mirrored_plan(own, ["hero"])


QUERIES = {f.__name__: f for f in (pixel_tint, pixel_outline, pixel_seam, style_measures, chr_banks, mirror_plan)}

_PX = f"{fx.COLOURS}, px AS (SELECT image, CAST(p_partkey // 7 % 32 AS INTEGER) AS x, CAST(p_partkey // 224 AS INTEGER) AS y, r, g, b, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 255 END AS a FROM colours)"
_DISC = ", ".join(f"({dx}, {dy})" for dx in range(-2, 3) for dy in range(-2, 3) if 0 < dx * dx + dy * dy <= 4)

ORACLE_SQL = {
    "pixel_tint": f"WITH {_PX} SELECT image, x, y, a, " + ", ".join(f"CASE WHEN a > 0 THEN CAST(floor({c} + ({v} - {c}) * 0.5::DOUBLE) AS INTEGER) ELSE {c} END AS {c}" for c, v in zip("rgb", (255, 128, 0), strict=True)) + " FROM px",
    "pixel_outline": f"WITH {_PX}, s AS (SELECT image, x, y FROM px WHERE a > 0), d(dx, dy) AS (VALUES {_DISC}), n AS (SELECT DISTINCT image, x + dx AS x, y + dy AS y FROM s, d) SELECT * FROM n ANTI JOIN s USING (image, x, y)",
    "pixel_seam": f"WITH {_PX.replace('CAST(p_partkey // 128 AS INTEGER) AS image', 'CAST(p_partkey % 7 AS INTEGER) AS image')}, e AS (SELECT image, x - 24 AS x, y, r AS rr, g AS gg, b AS bb FROM px WHERE x >= 24) SELECT px.image, px.x, px.y, a, "
    + ", ".join(f"CASE WHEN rr IS NULL THEN {c} ELSE CAST(floor({c} + ({c * 2} - {c}) * (1 - px.x / 8.0::DOUBLE)) AS INTEGER) END AS {c}" for c in "rgb")
    + " FROM px LEFT JOIN e ON e.image = px.image AND e.x = px.x AND e.y = px.y",
    "style_measures": f"""WITH {_PX}, g AS (SELECT image, (r * 299 + g * 587 + b * 114) // 1000 AS g, floor((greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b, 1) * 1000) AS s FROM px),
        m AS (SELECT image, count(DISTINCT g) AS greys, CAST(max(g) - min(g) AS BIGINT) AS contrast, CAST(floor(avg(s)) AS BIGINT) AS saturation FROM g GROUP BY 1)
        SELECT *, CASE WHEN greys <= 4 THEN 'flat' WHEN greys <= 8 THEN 'simple' WHEN greys <= 16 THEN 'smooth' ELSE 'detailed' END AS shading FROM m""",
    "chr_banks": f"WITH {fx.FRAMES}, t AS (SELECT seq, list(ticks ORDER BY frame) AS f FROM frames GROUP BY 1), b AS (SELECT seq, f, unnest(range(8)) AS bank FROM t) SELECT seq, CAST(bank AS INTEGER) AS bank, f[least(bank, len(f) - 1) + 1] AS ticks FROM b",
    "mirror_plan": """WITH o AS (SELECT p_partkey % 50 AS hero, p_size % 8 AS direction, min(p_partkey) AS sheet FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2), g AS (SELECT hero, unnest(range(8)) AS direction FROM (SELECT DISTINCT hero FROM o))
        SELECT g.hero, CAST(g.direction AS INTEGER) AS direction, coalesce(a.sheet, b.sheet) AS sheet, a.sheet IS NULL AND b.sheet IS NOT NULL AS flipped FROM g LEFT JOIN o a ON a.hero = g.hero AND a.direction = g.direction
        LEFT JOIN o b ON b.hero = g.hero AND (12 - b.direction) % 8 = g.direction""",
}
