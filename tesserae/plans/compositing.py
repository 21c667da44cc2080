"""Shadows, glows, resampled and turned sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compositing as ops
from .segments import SHEETS, H, W, sheets

SHADOW, GLOW, RADIUS = (10, 0, 20, 100), (250, 240, 60), 2
OFFSET = (2, -3)
SMALL = (40, 28)
DIRECTIONS = tuple(range(0, 360, 45))
#: Holes in the sheets, and pixels that are half clear.
_ALPHA = "CASE WHEN (x + y) % 5 = 0 THEN 0 WHEN (x * 3 + y) % 7 = 0 THEN 60 + x WHEN (x + y * 2) % 9 = 0 THEN 200 ELSE a END"


def sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).withColumn("a", F.expr(_ALPHA))


def by_line(pixels: DataFrame, *keys: str) -> DataFrame:
    """A row a line of an image: its pixels as x:r,g,b,a."""
    shown = F.concat(F.col("x").cast("string"), F.lit(":"), F.concat_ws(",", *[F.col(c).cast("string") for c in ops.RGBA]))
    return pixels.groupBy(*keys, "y").agg(F.array_join(F.sort_array(F.collect_list(F.struct("x", shown.alias("t"))))["t"], " ").alias("line"))


def sprite_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_line(ops.shadow(sprites(spark, sf_dir), "image", *OFFSET, SHADOW), "image")


def sprite_glow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.glow_lines(sprites(spark, sf_dir), "image", RADIUS, GLOW)


def image_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_line(ops.resampled(sprites(spark, sf_dir), "image", (W, H), SMALL), "image")


def image_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet in eight directions: visible pixels, and a sum over them that tells their places and colours."""
    turned = ops.turned(sprites(spark, sf_dir).filter("a > 0"), "image", (W, H), DIRECTIONS)
    told = (F.col("x").cast("long") * 131 + F.col("y") * 1009 + F.col("r") * 7 + F.col("g") * 31 + F.col("b") * 61 + F.col("a") * 17) % 100_003
    return turned.groupBy("image", "degrees").agg(F.count(F.lit(1)).alias("pixels"), F.sum(told * (1 + F.col("x") % 17)).alias("told"))


QUERIES = {f.__name__: f for f in (sprite_shadow, sprite_glow, image_resampled, image_directions)}

_LINE = "string_agg(x || ':' || r || ',' || g || ',' || b || ',' || a, ' ' ORDER BY x) AS line"
_SPRITES = f"{SHEETS}, p AS (SELECT image, x, y, r, g, b, {_ALPHA} AS a FROM px), v AS (SELECT * FROM p WHERE a > 0)"
_MIX = lambda u, o, m: f"(((({u} * (255 - {m}) + {o} * {m} + 128) >> 8) + ({u} * (255 - {m}) + {o} * {m} + 128)) >> 8)"


def _paste(source: str, under: str, over: str) -> str:
    """A step that covers the columns ``under`` with ``over``."""
    return f"SELECT * REPLACE ({', '.join(f'{_MIX(f'{under}{c}', f'{over}{c}', f'{over}a')} AS {under}{c}' for c in ops.RGBA)}) FROM ({source})"


def _glow_sql() -> str:
    offsets = ", ".join(f"({x}, {y}, {x * x + y * y})" for x in range(-RADIUS, RADIUS + 1) for y in range(-RADIUS, RADIUS + 1) if x * x + y * y <= RADIUS * RADIUS + RADIUS)
    start = "SELECT coalesce(n.image, v.image) AS image, coalesce(n.x, v.x) AS x, coalesce(n.y, v.y) AS y, d2, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM n FULL JOIN v ON n.image = v.image AND n.x = v.x AND n.y = v.y"
    silhouette = ", ".join(f"CASE WHEN a >= 128 THEN {k} ELSE {c} END AS s{c}" for c, k in zip("rgb", GLOW, strict=True))
    step = _paste(f"SELECT *, {silhouette}, a AS sa, 0 AS cr, 0 AS cg, 0 AS cb, 0 AS ca, 0 AS \"or\", 0 AS og, 0 AS ob, 0 AS oa FROM ({start})", "c", "s")
    for r in range(RADIUS, 0, -1):
        ring = f"a < 128 AND coalesce(d2 <= {r * r + r}, false)"
        step = f"SELECT * REPLACE ({', '.join(f'CASE WHEN {ring} THEN {k} ELSE 0 END AS "o{c}"' for c, k in zip(ops.RGBA, (*GLOW, 255), strict=True))}) FROM ({step})"
        step = _paste(step, "o", "").replace("or *", '"or" *').replace("AS or", 'AS "or"')
        step = f"SELECT * REPLACE (CASE WHEN \"or\" = {GLOW[0]} AND og = {GLOW[1]} AND ob = {GLOW[2]} THEN least(oa, {255 * r // (2 * RADIUS)}) ELSE oa END AS oa) FROM ({step})"
        step = _paste(step, "c", "o").replace(" or *", ' "or" *')
    step = _paste(step, "c", "")
    return f"""WITH {_SPRITES}, n AS (SELECT image, x + dx AS x, y + dy AS y, min(d) AS d2 FROM v, (VALUES {offsets}) o(dx, dy, d) WHERE a >= 128 GROUP BY ALL),
        c AS (SELECT image, x + {RADIUS} AS x, y + {RADIUS} AS y, cr AS r, cg AS g, cb AS b, ca AS a FROM ({step}) WHERE ca > 0) SELECT image, y, {_LINE} FROM c GROUP BY image, y"""


def _resampled_sql() -> str:
    premultiplied = ", ".join(f"((({c} * a + 128) >> 8) + ({c} * a + 128)) >> 8 AS {c}" for c in "rgb")
    weights = lambda name, size, to: f"{name}(o, i, w) AS (VALUES {', '.join(map(str, ops.lanczos(size, to)))})"
    sums = ", ".join(f"CAST(greatest(0, least(255, (CAST(sum({c} * w) AS BIGINT) + {1 << (ops.BITS - 1)}) >> {ops.BITS})) AS INTEGER) AS {c}" for c in ops.RGBA)
    back = ", ".join(f"CASE WHEN a IN (0, 255) THEN {c} ELSE least(255, {c} * 255 // a) END AS {c}" for c in "rgb")
    return f"""WITH {_SPRITES}, {weights("wx", W, SMALL[0])}, {weights("wy", H, SMALL[1])}, q AS (SELECT image, x, y, {premultiplied}, a FROM p), h AS (SELECT image, o AS x, y, {sums} FROM q JOIN wx ON x = i GROUP BY image, o, y),
        t AS (SELECT image, x, o AS y, {sums} FROM h JOIN wy ON y = i GROUP BY image, x, o), z AS (SELECT image, x, y, {back}, a FROM t) SELECT image, y, {_LINE} FROM z GROUP BY image, y"""


def _directions_sql() -> str:
    places = []
    for angle in DIRECTIONS:
        (wide, high), (a, b, c, d, e, f) = ops.turn(W, H, angle)
        back = [f"floor({k[0]!r}::DOUBLE * (x + 0.5::DOUBLE) + {k[1]!r}::DOUBLE * (y + 0.5::DOUBLE) + {k[2]!r}::DOUBLE)" for k in ((a, b, c), (d, e, f))]
        places.append(f"SELECT {float(angle)}::DOUBLE AS degrees, x, y, {back[0]} AS sx, {back[1]} AS sy FROM range({wide}) i(x), range({high}) j(y)")
    return f"""WITH {_SPRITES}, m AS ({' UNION ALL '.join(places)}) SELECT image, degrees, count(*) AS pixels, CAST(sum((m.x * 131 + m.y * 1009 + r * 7 + g * 31 + b * 61 + a * 17) % 100003 * (1 + m.x % 17)) AS BIGINT) AS told
        FROM v JOIN m ON v.x = m.sx AND v.y = m.sy GROUP BY image, degrees"""


_SHADOW = ", ".join(f"CASE WHEN a >= 128 THEN {k} ELSE {c} END AS s{c}" for c, k in zip("rgb", SHADOW, strict=False))
_BOTH = f"""SELECT coalesce(o.image, s.image) AS image, coalesce(o.x, s.x) AS x, coalesce(o.y, s.y) AS y, {", ".join(f"coalesce({c}, 0) AS {c}, coalesce(s{c}, 0) AS s{c}, 0 AS c{c}" for c in ops.RGBA)}
    FROM (SELECT image, x, y + {-OFFSET[1]} AS y, r, g, b, a FROM v) o FULL JOIN (SELECT image, x + {OFFSET[0]} AS x, y, {_SHADOW}, a * {SHADOW[3]} // 255 AS sa FROM v) s ON o.image = s.image AND o.x = s.x AND o.y = s.y"""

ORACLE_SQL = {
    "sprite_shadow": f"WITH {_SPRITES}, c AS (SELECT image, x, y, cr AS r, cg AS g, cb AS b, ca AS a FROM ({_paste(_paste(_BOTH, 'c', 's'), 'c', '')}) WHERE ca > 0) SELECT image, y, {_LINE} FROM c GROUP BY image, y",
    "sprite_glow": _glow_sql(),
    "image_resampled": _resampled_sql(),
    "image_directions": _directions_sql(),
}
