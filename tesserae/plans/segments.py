"""Sheets of sprites and what is cut out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import segments as ops
from . import fixtures as fx

W = H = 96
#: Sheets whose pixels one task makes.
SHEETS_A_TASK = 64
# Sprites on a grid of each sheet's own, with holes; every third sheet is clear behind them and every fifth has a gradient there.
_INSIDE = "x % (24 + image % 11) BETWEEN 2 AND 6 + image % 19 AND y % (22 + image % 13) BETWEEN 1 AND 4 + image % 17 AND (x * 7 + y * 3 + image) % 11 <> 0"
_CHANNELS = {
    "r": "CASE WHEN s THEN 56 + (x * 5 + image * 3) % 200 WHEN image % 5 = 4 THEN x * 2 ELSE image * 3 % 25 END",
    "g": "CASE WHEN s THEN 40 + (y * 9 + image) % 200 ELSE 8 END",
    "b": "CASE WHEN s THEN (x + y) % 256 ELSE 4 END",
    "a": "CASE WHEN s THEN 255 WHEN image % 3 = 0 THEN 0 ELSE 255 END",
}


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, x, y, r, g, b, a: one sheet of 96 x 96 pixels a supplier; dealt by image before the pixels are made, so that what goes by image finds them in place.

    The number of parts follows from the number of sheets and is told: the keys alone are so small that Spark would put them all together in one task, and their pixels with them.
    """
    suppliers = fx.table(spark, sf_dir, "supplier")
    images = suppliers.select(F.col("s_suppkey").cast("int").alias("image")).repartition(-(-suppliers.count() // SHEETS_A_TASK) or 1, "image")
    place = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(W * H - 1))).alias("i"))
    seen = place.selectExpr("image", f"i % {W} AS x", f"i div {W} AS y").withColumn("y", F.col("y").cast("int")).selectExpr("*", f"{_INSIDE} AS s")
    return seen.selectExpr("image", "x", "y", *[f"{sql} AS {c}" for c, sql in _CHANNELS.items()])


SHEETS = f"""place AS (SELECT CAST(s_suppkey AS INTEGER) AS image, unnest(range({W * H})) AS i FROM supplier),
    seen AS (SELECT *, {_INSIDE} AS s FROM (SELECT image, CAST(i % {W} AS INTEGER) AS x, CAST(i // {W} AS INTEGER) AS y FROM place)),
    px AS (SELECT image, x, y, {", ".join(f"{sql} AS {c}" for c, sql in _CHANNELS.items())} FROM seen),
    mask AS (SELECT image, x, y FROM px WHERE a >= 128 AND greatest(r, g, b) > 30)"""


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).filter(ops.is_content()).select("image", "x", "y")


def sheet_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content pixels of each row of the cropped sheets."""
    return ops.border_crop(sheets(spark, sf_dir), W, H).groupBy("image", "y").agg(F.sum(ops.is_content().cast("long")).alias("n"), F.count(F.lit(1)).alias("width"))


def sheet_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.background(sheets(spark, sf_dir), "image", W, H)


def sheet_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.closed_boxes(_mask(spark, sf_dir), "image", W, H)


def sheet_boxes_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tolerant_boxes(_mask(spark, sf_dir), "image", W, H, least=10, row_gap=4, column_gap=3)


def sheet_text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = _mask(spark, sf_dir)
    return ops.text_regions(ops.closed_boxes(mask, "image", W, H), mask, "image", H)


def sheet_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crop_boxes(ops.closed_boxes(_mask(spark, sf_dir), "image", W, H), W, H, 3)


def grid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.grid_frames(sheets(spark, sf_dir), "image", W, H, 12, 9, margin=3, padding=2, least_alpha=255 * 30)


def strip_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.seamless_loop(ops.strip_frames(sheets(spark, sf_dir), W, 5), "image", 4)


QUERIES = {f.__name__: f for f in (sheet_content, sheet_background, sheet_boxes, sheet_boxes_tolerant, sheet_text_regions, sheet_crops, grid_frames, strip_loop)}


def _runs(name: str, source: str, keys: str, pos: str, gap: int) -> str:
    """Islands in SQL: numbers of places less their rank would do without gaps; a flag summed up does with them."""
    return f"""{name}_d AS (SELECT DISTINCT {keys}, {pos} FROM {source}), {name}_f AS (SELECT *, CASE WHEN {pos} - lag({pos}) OVER (PARTITION BY {keys} ORDER BY {pos}) <= {gap + 1} THEN 0 ELSE 1 END AS fresh FROM {name}_d),
        {name}_n AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY {pos}) AS run FROM {name}_f), {name} AS (SELECT {keys}, min({pos}) AS lo, max({pos}) AS hi FROM {name}_n GROUP BY {keys}, run)"""


_CLOSED = f"""{SHEETS}, {_runs("rr", "mask", "image", "y", 0)}, rows_in AS (SELECT image, lo AS top, hi AS bottom FROM rr WHERE hi - lo >= 4 AND hi < {H - 1}),
    inside AS (SELECT m.*, top, bottom FROM mask m JOIN rows_in USING (image) WHERE y BETWEEN top AND bottom), {_runs("cc", "inside", "image, top, bottom", "x", 0)},
    boxes AS (SELECT image, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM inside JOIN (SELECT * FROM cc WHERE hi - lo >= 4 AND hi < {W - 1}) USING (image, top, bottom)
        WHERE x BETWEEN lo AND hi GROUP BY image, top, lo)"""
_RULES = ", ".join(f"CASE WHEN {rule.replace('height', str(H))} THEN '{name}' END" for name, rule in ops.TEXT_RULES.items())

ORACLE_SQL = {
    "sheet_content": f"WITH {SHEETS} SELECT image, y - {H // 10} AS y, CAST(count(*) FILTER (a >= 128 AND greatest(r, g, b) > 30) AS BIGINT) AS n, count(*) AS width FROM px WHERE y >= {H // 10} AND y < {H * 90 // 100} AND x >= {W * 2 // 100} AND x < {W * 98 // 100} GROUP BY image, y",
    "sheet_background": f"""WITH {SHEETS}, c AS (SELECT image, CASE WHEN y > 0 THEN 2 ELSE 0 END + CASE WHEN x > 0 THEN 1 ELSE 0 END AS o, CASE WHEN a = 0 THEN 0 ELSE r END AS r, CASE WHEN a = 0 THEN 0 ELSE g END AS g, CASE WHEN a = 0 THEN 0 ELSE b END AS b,
            CASE WHEN a = 0 THEN 0 ELSE 255 END AS a FROM px WHERE x IN (0, {W - 1}) AND y IN (0, {H - 1})),
        f AS (SELECT c.image, count(*) AS odd FROM c JOIN c z ON z.image = c.image AND z.o = 0 WHERE abs(c.r - z.r) + abs(c.g - z.g) + abs(c.b - z.b) + abs(c.a - z.a) > 30 GROUP BY 1),
        v AS (SELECT image, r, g, b, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, min(o)) AS k FROM c GROUP BY image, r, g, b, a)
        SELECT v.image, CASE WHEN coalesce(odd, 0) <= 1 THEN r END AS r, CASE WHEN coalesce(odd, 0) <= 1 THEN g END AS g, CASE WHEN coalesce(odd, 0) <= 1 THEN b END AS b FROM v LEFT JOIN f USING (image) WHERE k = 1""",
    "sheet_boxes": f"WITH {_CLOSED} SELECT * FROM boxes",
    "sheet_boxes_tolerant": f"""WITH {SHEETS}, every AS (SELECT * FROM mask WHERE x % 4 = 0), {_runs("rr", "every", "image", "y", 4)},
        rows_in AS (SELECT image, lo AS top, CASE WHEN hi + 5 > {H - 1} THEN {H - 1} ELSE hi END AS bottom FROM rr WHERE CASE WHEN hi + 5 > {H - 1} THEN {H} - lo ELSE hi - lo END >= 10),
        inside AS (SELECT m.*, top, bottom FROM mask m JOIN rows_in USING (image) WHERE y BETWEEN top AND bottom), {_runs("cc", "inside", "image, top, bottom", "x", 3)},
        cols AS (SELECT image, top, bottom, lo, CASE WHEN hi + 4 > {W - 1} THEN hi + 1 ELSE hi END AS stop FROM cc),
        t AS (SELECT image, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM inside JOIN cols USING (image, top, bottom) WHERE stop - lo >= 10 AND x >= lo AND x < stop AND y < bottom GROUP BY image, top, lo)
        SELECT * FROM t WHERE w > 1 AND h > 1""",
    "sheet_text_regions": f"""WITH {_CLOSED}, n AS (SELECT b.image, b.x, b.y, b.w, b.h, count(*) AS n FROM boxes b JOIN mask m ON m.image = b.image AND m.x >= b.x AND m.x < b.x + w AND m.y >= b.y AND m.y < b.y + h GROUP BY ALL)
        SELECT *, array_to_string(list_filter([{_RULES}], lambda t: t IS NOT NULL), ',') AS reasons FROM n""",
    "sheet_crops": f"WITH {_CLOSED} SELECT *, greatest(0, x - 3) AS \"left\", greatest(0, y - 3) AS top, least({W}, x + w + 3) AS \"right\", least({H}, y + h + 3) AS bottom FROM boxes",
    "grid_frames": f"""WITH {SHEETS}, g AS (SELECT unnest(range(12)) AS row), k AS (SELECT unnest(range(12)) AS col), c AS (SELECT row, col, 3 + col * 14 AS x0, 3 + row * 11 AS y0 FROM g, k WHERE 3 + col * 14 + 12 <= {W - 3} AND 3 + row * 11 + 9 <= {H - 3}),
        s AS (SELECT image, row, col, x0 AS x, y0 AS y, CAST(sum(a) AS BIGINT) AS alpha FROM px JOIN c ON x >= x0 AND x < x0 + 12 AND y >= y0 AND y < y0 + 9 GROUP BY ALL HAVING sum(a) >= {255 * 30})
        SELECT image, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, alpha, CAST(row_number() OVER (PARTITION BY image ORDER BY row, col) - 1 AS INTEGER) AS frame FROM s""",
    "strip_loop": f"""WITH {SHEETS}, s AS (SELECT image, x // 19 AS frame, x % 19 AS x, y, r, g, b FROM px WHERE x < 95), z AS (SELECT l.*, f.r AS fr, f.g AS fg, f.b AS fb FROM s l JOIN s f USING (image, x, y) WHERE l.frame = 4 AND f.frame = 0),
        d AS (SELECT image, avg(abs(r - fr) + abs(g - fg) + abs(b - fb)) > 150 AS blended FROM z GROUP BY 1)
        SELECT image, x, y, blended, """
    + ", ".join(f"CASE WHEN blended THEN CAST(floor({c} * 0.7::DOUBLE + f{c} * 0.3::DOUBLE) AS INTEGER) ELSE {c} END AS {c}" for c in "rgb")
    + " FROM z JOIN d USING (image)",
}
