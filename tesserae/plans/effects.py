"""Effects, mirrored parts, raw colours and safety."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import effects as ops
from . import fixtures as fx
from .segments import SHEETS, H, W, sheets

_TARGETS = ("rgb24", "genesis", "snes", "gameboy", "nes", "other")


def outline_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = sheets(spark, sf_dir).withColumn("r", F.when(F.col("image") % 4 == 1, 0).otherwise(F.col("r")))
    return ops.outline_class(px.withColumns({"g": F.when(F.col("image") % 4 == 1, 0).otherwise(F.col("g")), "b": F.when(F.col("image") % 4 == 1, 0).otherwise(F.col("b"))}), "image", W, H)


def mirrored_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tiles as the part that mirroring needs, and whether the part gives the tile again."""
    p = fx.tiles(spark, sf_dir).select("px").distinct().select("px", ops.mirrored_part(F.col("px")).alias("m"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "")
    return p.select(text("px").alias("px"), "m.symmetry", text("m.part").alias("part"), (F.col("m.whole") == F.col("px")).alias("same"))


def raw_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.colours(spark, sf_dir).select("p_partkey", "r", "g", "b", F.explode(F.array(*map(F.lit, _TARGETS))).alias("target"))
    return c.select("p_partkey", "target", ops.raw_colour(F.col("target"), *map(F.col, "rgb")).cast("long").alias("raw"))


def safe_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages, some made unsafe, and paths and arguments made of them."""
    k = F.col("page_id")
    url = F.when(k % 7 == 0, F.lit("http://LOCALHOST:80/x")).when(k % 7 == 1, F.lit("ftp://a.org/x")).when(k % 7 == 2, F.lit("https://me@10.1.2.3/x")).otherwise(F.col("url"))
    path = F.when(k % 5 == 0, F.lit("../x.png")).when(k % 5 == 1, F.lit("/etc/x")).when(k % 5 == 2, F.lit("a/../b.png")).when(k % 5 == 3, F.lit("a..b/c.png")).otherwise(F.lit("C:x"))
    return fx.table(spark, sf_dir, "pages").select("page_id", ops.safe_address(url).alias("address"), ops.safe_path(path).alias("path"), ops.safe_argument(F.concat(F.lit("--"), url, F.lit("; rm -rf $(x) "))).alias("argument"))


def attached_animations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = fx.table(spark, sf_dir, "part").select(F.concat_ws("-", "p_type", (F.col("p_partkey") % 90).cast("string")).alias("name"))
    anims = fx.frames(spark, sf_dir).groupBy("seq").agg(F.count(F.lit(1)).alias("frames"), F.max("loop").alias("loop"), F.min("ticks").alias("ticks"))
    anims = anims.select(F.concat(F.lit("SMALL-"), (F.col("seq") % 70).cast("string")).alias("name"), F.concat(F.lit("a"), F.col("seq").cast("string")).alias("anim"), "frames", "loop", "ticks")
    return ops.attached(names, anims)


def small_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.floor(F.col("value") * 1_000_000)).alias("size"))
    return ops.small_enough(e, "size", 50)


QUERIES = {f.__name__: f for f in (outline_class, mirrored_parts, raw_colours, safe_addresses, attached_animations, small_changes)}

_DIST = "list_sort(list_transform([{}], lambda p: {{'d': (r - p.r) ** 2 + (g - p.g) ** 2 + (b - p.b) ** 2, 'k': p.k}}))[1].k"
_FIXED = ", ".join(f"{{'r': {r}, 'g': {g}, 'b': {b}, 'k': {k}}}" for k, (r, g, b) in enumerate(dims.FIXED_64))
_H, _V = "list_transform(range(64), lambda i: px[(i // 8) * 8 + 7 - i % 8 + 1])", "list_transform(range(64), lambda i: px[(7 - i // 8) * 8 + i % 8 + 1])"

ORACLE_SQL = {
    "outline_class": f"""WITH {SHEETS}, p AS (SELECT image, x, y, a, CASE WHEN image % 4 = 1 THEN 0 ELSE r END AS r, CASE WHEN image % 4 = 1 THEN 0 ELSE g END AS g, CASE WHEN image % 4 = 1 THEN 0 ELSE b END AS b FROM px),
        e AS (SELECT image, r, g, b FROM p WHERE a > 128 AND x IN (0, {W - 1}) UNION ALL SELECT image, r, g, b FROM p WHERE a > 128 AND y IN (0, {H - 1})), n AS (SELECT image, r, g, b, count(*) AS n FROM e GROUP BY ALL),
        t AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, r, g, b) AS k, count(*) OVER (PARTITION BY image) AS colours FROM n)
        SELECT i.image, CASE WHEN k IS NULL THEN 'none' WHEN r = 0 AND g = 0 AND b = 0 THEN 'black' WHEN colours > 3 THEN 'selective' ELSE 'coloured' END AS style, r, g, b FROM (SELECT DISTINCT image FROM px) i LEFT JOIN t ON t.image = i.image AND k = 1""",
    "mirrored_parts": f"""WITH {fx.TILES}, t AS (SELECT DISTINCT px FROM tiles), s AS (SELECT px, px = {_H} AS h, px = {_V} AS v FROM t)
        SELECT array_to_string(px, '') AS px, CASE WHEN h AND v THEN 'radial' WHEN h THEN 'horizontal' WHEN v THEN 'vertical' ELSE 'none' END AS symmetry,
            array_to_string(list_transform(list_filter(range(64), lambda i: (NOT h OR i % 8 < 4) AND (NOT v OR i // 8 < 4)), lambda i: px[i + 1]), '') AS part, true AS same FROM s""",
    "raw_colours": f"""WITH {fx.COLOURS}, c AS (SELECT *, unnest({list(_TARGETS)}) AS target FROM colours)
        SELECT p_partkey, target, CAST(CASE target WHEN 'rgb24' THEN r * 65536 + g * 256 + b WHEN 'genesis' THEN (r // 32) * 2 + (g // 32) * 32 + (b // 32) * 512 WHEN 'snes' THEN r // 8 + (g // 8) * 32 + (b // 8) * 1024
            WHEN 'gameboy' THEN CASE WHEN r * 299 + g * 587 + b * 114 >= 192000 THEN 0 WHEN r * 299 + g * 587 + b * 114 >= 128000 THEN 1 WHEN r * 299 + g * 587 + b * 114 >= 64000 THEN 2 ELSE 3 END WHEN 'nes' THEN {_DIST.format(_FIXED)} END AS BIGINT) AS raw FROM c""",
    "safe_addresses": r"""WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'http://LOCALHOST:80/x' WHEN 1 THEN 'ftp://a.org/x' WHEN 2 THEN 'https://me@10.1.2.3/x' ELSE url END AS url,
            CASE page_id % 5 WHEN 3 THEN true ELSE false END AS path FROM pages), h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#]*@)?([^/:?#]*)', 1)) AS host FROM p)
        SELECT page_id, (url LIKE 'http://%' OR url LIKE 'https://%') AND host NOT IN ('localhost', '127.0.0.1', '0.0.0.0') AND host NOT LIKE '192.168.%' AND host NOT LIKE '10.%' AS address, path,
            trim(translate(url || '; rm -rf $(x) ', ';|&$`<>()', '')) AS argument FROM h""",
    "attached_animations": f"""WITH {fx.FRAMES}, n AS (SELECT DISTINCT p_type || '-' || p_partkey % 90 AS name FROM part), a AS (SELECT 'SMALL-' || seq % 70 AS name, 'a' || seq AS anim, count(*) AS k, bool_or(loop) AS loop, min(ticks) AS ticks FROM frames GROUP BY seq),
        g AS (SELECT name, string_agg(anim || ':' || k || ':' || loop || ':' || ticks, ',' ORDER BY anim) AS anims FROM a GROUP BY 1) SELECT coalesce(n.name, g.name) AS name, coalesce(anims, '') AS anims, n.name IS NOT NULL AS known FROM n FULL JOIN g ON n.name = g.name""",
    "small_changes": "SELECT event_id, CAST(floor(value * 1000000) AS BIGINT) AS size FROM events WHERE event_id % 11 <> 0 AND floor(value * 1000000) <= 52428800",
}
