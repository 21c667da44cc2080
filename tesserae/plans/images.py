"""Images to tiles, maps and other forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images as ops
from . import fixtures as fx
from .segments import SHEETS, H, W, sheets

_WIDE = 90  # not a whole number of tiles


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).filter(F.col("x") < _WIDE)


def _index():
    return F.floor(F.col("r") / 64).cast("int")


def _listed(df: DataFrame, px: str = "px") -> DataFrame:
    return df.withColumn(px, F.array_join(F.col(px).cast("array<string>"), ""))


def image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(ops.tiles_of(_indexed(spark, sf_dir), "image", _index(), _WIDE, H, pad=False))


def image_tiles_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(ops.tiles_of(_indexed(spark, sf_dir), "image", _index(), _WIDE, H, pad=True))


def background_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = ops.tiles_of(_indexed(spark, sf_dir), "image", _index(), _WIDE, H, pad=True)
    return ops.background_map(tiles, "image", 32, 30, most=100)


def tile_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = fx.tiles(spark, sf_dir).groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "px"))["px"].alias("px"))
    return _listed(ops.rotations(tiles, ["l_orderkey"]))


def image_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scaled(sheets(spark, sf_dir), "image", W, H, 40, 32)


def image_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scaled(sheets(spark, sf_dir), "image", W, H, 40, 32, cover=True)


def background_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sheet: pixels that stay after each way to take the background away, and a sum over the keyed ones."""
    s = sheets(spark, sf_dir)
    count = lambda df, name: df.groupBy("image").agg(F.sum((F.col("a") > 0).cast("long")).alias(name))
    keyed = ops.keyed(s).groupBy("image").agg(F.sum(F.col("r") * 3 + F.col("g") * 2 + F.col("b")).alias("keyed"))
    return count(ops.without_colour(s, (8, 8, 8)), "by_colour").join(count(ops.without_dark(s), "by_brightness"), "image").join(keyed, "image")


def tile_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tile_brightness(sheets(spark, sf_dir), "image")


def tile_two_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of every tile after it is in two colours."""
    two = ops.two_colours(sheets(spark, sf_dir), "image").groupBy("image", *[F.floor(F.col(c) / 8).cast("int").alias(f"t{c}") for c in "xy"])
    return two.agg(*[F.sum(c).alias(c) for c in "rgb"], F.countDistinct("r", "g", "b").alias("colours"))


def brightness_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).groupBy("image", ops.brightness_band(*map(F.col, "rgb")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def tile_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = fx.variants(spark, sf_dir).select("asset", "tiles", ops.budget(F.col("tiles"), 4096).alias("b"))
    return used.select("asset", "tiles", "b.*")


def _palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return fx.colours(spark, sf_dir).select(F.floor(key / 16).alias("palette"), (key % 16).cast("int").alias("idx"), "r", "g", "b")


def hit_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.hit_palette(_palettes(spark, sf_dir))


def damage_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.damage_palette(_palettes(spark, sf_dir))


def palette_by_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of each palette's entries from dark to light."""
    p = _palettes(spark, sf_dir).withColumn("luma", F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114)
    order = F.array_sort(F.collect_list(F.struct("luma", "idx")))
    return p.groupBy("palette").agg(order.alias("o")).select("palette", F.array_join(F.transform("o", lambda s: s["idx"].cast("string")), ",").alias("order"))


QUERIES = {f.__name__: f for f in (
    image_tiles, image_tiles_padded, background_map, tile_rotations, image_contained, image_covering, background_removed, tile_brightness, tile_two_colours, brightness_bands, tile_budget,
    hit_palette, damage_palette, palette_by_luma,
)}

_GRID = f"SELECT image, x // 8 AS tx, y // 8 AS ty, y % 8 * 8 + x % 8 AS place, r // 64 AS v FROM px WHERE x < {_WIDE}"
_TILES = f"""{SHEETS}, t AS ({_GRID}), u AS (SELECT DISTINCT image, tx, ty FROM t), f AS (SELECT image, tx, ty, unnest(range(64)) AS place FROM u),
    tiles AS (SELECT image, tx, ty, string_agg(CAST(coalesce(v, 0) AS VARCHAR), '' ORDER BY place) AS px FROM f LEFT JOIN t USING (image, tx, ty, place) GROUP BY ALL)"""


def _scaled(w: int, h: int, left: int, top: int) -> str:
    return f"""WITH {SHEETS}, box AS (SELECT image, CAST(i % 40 AS INTEGER) AS x, CAST(i // 40 AS INTEGER) AS y FROM (SELECT DISTINCT image FROM place), (SELECT unnest(range(1280)) AS i)),
        s AS (SELECT *, CASE WHEN x >= {left} AND x < {left + w} AND y >= {top} AND y < {top + h} THEN (2 * (x - {left}) + 1) * {W} // {2 * w} END AS sx, (2 * (y - {top}) + 1) * {H} // {2 * h} AS sy FROM box)
        SELECT s.image, s.x, s.y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM s LEFT JOIN px ON px.image = s.image AND px.x = sx AND px.y = sy"""


_PALETTES = f"WITH {fx.COLOURS}, p AS (SELECT p_partkey // 16 AS palette, CAST(p_partkey % 16 AS INTEGER) AS idx, r, g, b FROM colours)"

ORACLE_SQL = {
    "image_tiles": f"WITH {_TILES} SELECT image, tx, ty, px FROM tiles WHERE tx < {_WIDE // 8}",
    "image_tiles_padded": f"WITH {_TILES} SELECT image, tx, ty, px FROM tiles",
    "background_map": f"""WITH {_TILES}, c AS (SELECT image, cell, coalesce(px, repeat('0', 64)) AS px FROM (SELECT DISTINCT image FROM u), (SELECT CAST(unnest(range(960)) AS INTEGER) AS cell) LEFT JOIN (SELECT image AS i, ty * 32 + tx AS spot, px FROM tiles) ON i = image AND spot = cell),
        n AS (SELECT image, px, row_number() OVER (PARTITION BY image ORDER BY min(cell)) AS k FROM c GROUP BY image, px) SELECT image, cell, CAST(CASE WHEN k < 100 THEN k ELSE 0 END AS INTEGER) AS tile FROM c JOIN n USING (image, px)""",
    "tile_rotations": f"""WITH {fx.TILES}, t AS (SELECT l_orderkey, first(px ORDER BY l_linenumber, px) AS px FROM tiles GROUP BY 1), q AS (SELECT l_orderkey, px, unnest(range(4)) AS q FROM t)
        SELECT l_orderkey, CAST(q * 90 AS INTEGER) AS angle, array_to_string(list_transform(range(64), lambda i: CASE q WHEN 0 THEN px[i + 1] WHEN 1 THEN px[(7 - i % 8) * 8 + i // 8 + 1] WHEN 2 THEN px[64 - i] ELSE px[(i % 8) * 8 + 7 - i // 8 + 1] END), '') AS px FROM q""",
    "image_contained": _scaled(32, 32, 4, 0),
    "image_covering": _scaled(40, 40, 0, -4),
    "background_removed": f"""WITH {SHEETS} SELECT image, CAST(count(*) FILTER (a > 0 AND abs(r - 8) + abs(g - 8) + abs(b - 8) > 30) AS BIGINT) AS by_colour, CAST(count(*) FILTER (a > 0 AND r + g + b > 150) AS BIGINT) AS by_brightness,
        CAST(sum(CASE WHEN a < 128 THEN 255 * 4 ELSE r * 3 + g * 2 + b END) AS BIGINT) AS keyed FROM px GROUP BY 1""",
    "tile_brightness": f"""WITH {SHEETS}, t AS (SELECT image, x // 8 AS tx, y // 8 AS ty, sum((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) AS grey, count(*) FILTER (r + g + b > 384 AND a > 200) AS lit, count(*) AS n FROM px GROUP BY ALL)
        SELECT image, tx, ty, grey < 100 * n AS solid, 10 * lit > 6 * n AS bright, CASE WHEN 10 * lit < 3 * n THEN 'full' WHEN 10 * lit < 7 * n THEN 'partial' ELSE 'none' END AS region FROM t""",
    "tile_two_colours": f"""WITH {SHEETS}, n AS (SELECT image, x // 8 AS tx, y // 8 AS ty, r, g, b, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY image, tx, ty ORDER BY n DESC, r DESC, g DESC, b DESC) AS k FROM n),
        d AS (SELECT p.image, p.x, p.y, c.r, c.g, c.b, row_number() OVER (PARTITION BY p.image, p.x, p.y ORDER BY (p.r - c.r) ** 2 + (p.g - c.g) ** 2 + (p.b - c.b) ** 2, k) AS near FROM px p JOIN c ON c.image = p.image AND tx = p.x // 8 AND ty = p.y // 8 AND k <= 2)
        SELECT image, x // 8 AS tx, y // 8 AS ty, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, count(DISTINCT (r, g, b)) AS colours FROM d WHERE near = 1 GROUP BY ALL""",
    "brightness_bands": f"WITH {SHEETS} SELECT image, CAST(CASE WHEN (r + g + b) // 3 < 32 THEN 0 WHEN (r + g + b) // 3 < 96 THEN 1 WHEN (r + g + b) // 3 < 192 THEN 2 ELSE 3 END AS INTEGER) AS band, count(*) AS n FROM px GROUP BY 1, 2",
    "tile_budget": f"WITH {fx.VARIANTS} SELECT asset, tiles, tiles * 32 AS used, tiles * 32 <= 4096 AS fits, 128 AS most FROM variants",
    "hit_palette": f"{_PALETTES} SELECT palette, idx, CASE WHEN idx = 0 THEN r ELSE 240 END AS r, CASE WHEN idx = 0 THEN g ELSE 240 END AS g, CASE WHEN idx = 0 THEN b ELSE 240 END AS b FROM p",
    "damage_palette": f"{_PALETTES} SELECT palette, idx, " + ", ".join(f"CASE WHEN idx = 0 THEN {c} ELSE CAST(greatest(0, least(255, floor({c} * 0.7::DOUBLE + {v * 0.3!r}::DOUBLE))) AS INTEGER) END AS {c}" for c, v in zip("rgb", (255, 0, 0), strict=True)) + " FROM p",
    "palette_by_luma": f"{_PALETTES} SELECT palette, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY r * 299 + g * 587 + b * 114, idx) AS \"order\" FROM p GROUP BY 1",
}
