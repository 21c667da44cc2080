"""Palettes by clustering over the colours of ``part``, 64 parts an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import FIXED_64
from ..functions import colour as C
from ..operators import clusters as ops
from ..operators import palettes
from . import fixtures as fx
from .compositing import _ALPHA
from .palettes import _CUT, _LAB, FOUR
from .segments import SHEETS, sheets

SIZE, ROUNDS = 8, 12


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.colours(spark, sf_dir).withColumn("sheet", F.floor(F.col("p_partkey") / 64)).select("sheet", *ops.RGB)


def _hundredths(value: Column) -> Column:
    """Rounded as a double, like SQL's: Spark's own two places round the decimal that a double is shown as, which lies on a half where the double is below it."""
    return F.round(value * 100) / 100


def kmeans_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error in hundredths, as sums of doubles have no order."""
    return ops.kmeans_palette(_sheets(spark, sf_dir), "sheet", SIZE, ROUNDS).withColumn("error", _hundredths(F.col("error")))


def octree_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.octree_palette(_sheets(spark, sf_dir), "sheet", SIZE)


def lab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours through CIELAB, in hundredths, and back: how many come back as they were, or a step off in some channel."""
    there = fx.colours(spark, sf_dir).select(*ops.RGB, *ops.lab_units())
    back = C.from_lab(*[F.col(c) / F.lit(float(ops.UNIT)) for c in ("l", "a", "bb")])
    off = F.greatest(*[F.abs(F.col(c) - v) for c, v in zip(ops.RGB, back, strict=True)])
    return there.select(off.alias("off")).groupBy("off").agg(F.count(F.lit(1)).alias("colours"))


KEYED, ENTRIES = (64, 128, 0), 6


def key_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse colours in palettes of six, one colour of which is kept for what is transparent."""
    coarse = fx.colours(spark, sf_dir).withColumns({c: (F.floor(F.col(c) / 64) * 64).cast("int") for c in "rgb"})
    return palettes.key_quantised(coarse, "image", "p_partkey", KEYED, ENTRIES)


def hardware_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours through their sheet's k-means palette to the fixed 64."""
    near, centroids = ops.kmeans(_sheets(spark, sf_dir), "sheet", SIZE, ROUNDS)
    at = centroids.select("sheet", F.posexplode("centroids").alias("idx", "c"))
    rgb = C.from_lab(*[F.col(f"c.{c}") / ops.UNIT for c in ("l", "a", "bb")])
    return palettes.hardware_mapped(near, at.select("sheet", "idx", *[c.alias(n) for c, n in zip(rgb, ops.RGB, strict=True)]), "sheet", FIXED_64)


def ordered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets in four colours by an ordered pattern of a spread of 48; clear pixels are entry 0."""
    px = palettes.ordered_dither(sheets(spark, sf_dir).withColumn("a", F.expr(_ALPHA)), FOUR, 8, spread=64 * 0.75, alpha="a")
    return px.groupBy("image", "idx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 7 + F.col("y")).alias("told"))


QUERIES = {f.__name__: f for f in (kmeans_palette, octree_palette, lab_round_trip, key_quantised, hardware_mapped, ordered_index)}

_COLOURS = f"{fx.COLOURS}, s AS (SELECT p_partkey // 64 AS sheet, r, g, b, p_partkey FROM colours), x AS (SELECT sheet, r, g, b, {_LAB} FROM s)"
_UNITS = ", ".join(f"CAST(floor({c} * {ops.UNIT} + 0.5) AS BIGINT) AS {c}" for c in ("l", "a", "bb"))
_CUBE = lambda t: f"(CASE WHEN {t} > 0.206893 THEN {t} * {t} * {t} ELSE ({t} - 16.0::DOUBLE / 116) / 7.787 END)"


def _back(lightness: str, a: str, b: str) -> list[str]:
    """CIELAB to sRGB in SQL."""
    middle = f"(({lightness} + 16) / 116.0::DOUBLE)"
    xyz = [f"{_CUBE(t)} * {w}" for t, w in zip((f"({a} / 500.0::DOUBLE + {middle})", middle, f"({middle} - {b} / 200.0::DOUBLE)"), C.WHITE, strict=True)]
    linear = ["(" + " + ".join(f"{v} * {w}" for v, w in zip(xyz, row, strict=True)) + ")" for row in C.LINEAR]
    return [f"CAST(floor(greatest(0.0, least(255.0, (CASE WHEN {c} > 0.0031308 THEN 1.055 * pow({c}, 1.0::DOUBLE / 2.4) - 0.055 ELSE 12.92 * {c} END) * 255))) AS INTEGER)" for c in linear]


def _kmeans_sql(hardware: bool = False) -> str:
    away = "(c.l - b.l) * (c.l - b.l) + (c.a - b.a) * (c.a - b.a) + (c.bb - b.bb) * (c.bb - b.bb)"
    steps = [
        f"c AS MATERIALIZED (SELECT sheet, r, g, b, {_UNITS}, count(*) AS n FROM x GROUP BY ALL)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY l, a, bb, r, g, b) - 1 AS k, count(*) OVER (PARTITION BY sheet) AS m FROM c)",
        f"book0 AS MATERIALIZED (SELECT sheet, i AS idx, CAST(l AS DOUBLE) AS l, CAST(a AS DOUBLE) AS a, CAST(bb AS DOUBLE) AS bb FROM o, range({SIZE}) t(i) WHERE i < least({SIZE}, m) AND k = CASE WHEN least({SIZE}, m) = 1 THEN 0 ELSE i * (m - 1) // (least({SIZE}, m) - 1) END)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT c.sheet, c.r, c.g, c.b, any_value(c.l) AS l, any_value(c.a) AS a, any_value(c.bb) AS bb, any_value(c.n) AS n, min({away}) AS d, arg_min(idx, struct_pack(d := {away}, i := idx)) AS idx FROM c JOIN book{k} b ON c.sheet = b.sheet GROUP BY c.sheet, c.r, c.g, c.b)")
        if k < ROUNDS:
            means = ", ".join(f"CAST(sum({c} * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS {c}" for c in ("l", "a", "bb"))
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT b.sheet, b.idx, coalesce(m.l, b.l) AS l, coalesce(m.a, b.a) AS a, coalesce(m.bb, b.bb) AS bb FROM book{k} b LEFT JOIN (SELECT sheet, idx, {means} FROM near{k} GROUP BY ALL) m USING (sheet, idx))")
    rgb = ", ".join(f"{v} AS {c}" for c, v in zip("rgb", _back(*(f"(b.{c} / {float(ops.UNIT)}::DOUBLE)" for c in ("l", "a", "bb"))), strict=True))
    if hardware:
        away = "(b.r - f.r) * (b.r - f.r) + (b.g - f.g) * (b.g - f.g) + (b.b - f.b) * (b.b - f.b)"
        return f"""WITH {_COLOURS}, {', '.join(steps)}, q AS (SELECT sheet, idx, {rgb} FROM book{ROUNDS} b), f(hw, r, g, b) AS (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(FIXED_64))}),
            h AS (SELECT sheet, idx, arg_min(hw, struct_pack(d := {away}, hw := hw)) AS hw FROM q b, f GROUP BY sheet, idx) SELECT n.sheet, n.r, n.g, n.b, CAST(n.idx AS INTEGER) AS idx, hw FROM near{ROUNDS} n JOIN h USING (sheet, idx)"""
    return f"WITH {_COLOURS}, {', '.join(steps)} SELECT n.sheet, CAST(n.idx AS INTEGER) AS idx, {rgb}, pixels, error FROM (SELECT sheet, idx, CAST(sum(n) AS BIGINT) AS pixels, round(sum(d * n) / {ops.UNIT**2}.0::DOUBLE, 2) AS error FROM near{ROUNDS} GROUP BY ALL) n JOIN book{ROUNDS} b USING (sheet, idx)"


ORACLE_SQL = {
    "kmeans_palette": _kmeans_sql(),
    "hardware_mapped": _kmeans_sql(True),
    "key_quantised": f"""WITH {fx.COLOURS}, cut AS ({_CUT.format(n=64)}), c AS (SELECT image, r, g, b, count(*) AS n, min(p_partkey) AS first, (r, g, b) = {KEYED} AS is_key FROM cut GROUP BY ALL), m AS (SELECT *, bool_or(is_key) OVER (PARTITION BY image) AS has FROM c),
        p AS (SELECT image, r, g, b, place - 1 + has::INTEGER AS idx FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, first) AS place FROM m WHERE NOT is_key) WHERE place <= {ENTRIES} - has::INTEGER),
        d AS (SELECT m.*, p.idx, row_number() OVER (PARTITION BY m.image, m.r, m.g, m.b ORDER BY (m.r - p.r) ** 2 + (m.g - p.g) ** 2 + (m.b - p.b) ** 2, p.idx) AS k FROM m LEFT JOIN p ON p.image = m.image)
        SELECT image, r, g, b, n, CAST(CASE WHEN is_key THEN 0 ELSE idx END AS INTEGER) AS idx FROM d WHERE k = 1""",
    "ordered_index": f"""WITH {SHEETS}, p AS (SELECT image, x, y, r, g, b, {_ALPHA} AS a, ([{", ".join(str(v) for row in palettes.bayer(8) for v in row)}][y % 8 * 8 + x % 8 + 1] / 64.0::DOUBLE - 0.5) * 48.0 AS t FROM px),
        c AS (SELECT image, x, y, a, {", ".join(f"greatest(0.0::DOUBLE, least(255.0::DOUBLE, {c} + t)) AS {c}" for c in "rgb")} FROM p),
        i AS (SELECT image, x, y, CASE WHEN a < 128 THEN 0 ELSE list_sort([{", ".join(f"{{'d': (r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b}), 'i': {k}}}" for k, (r, g, b) in enumerate(FOUR))}])[1].i END AS idx FROM c)
        SELECT image, CAST(idx AS INTEGER) AS idx, count(*) AS n, CAST(sum(x * 7 + y) AS BIGINT) AS told FROM i GROUP BY ALL""",
    "lab_round_trip": f"""WITH {_COLOURS}, u AS (SELECT r, g, b, {_UNITS} FROM x), v AS (SELECT r, g, b, {', '.join(f'{v} AS {c}' for c, v in zip(('r2', 'g2', 'b2'), _back(*(f'({c} / {float(ops.UNIT)}::DOUBLE)' for c in ('l', 'a', 'bb'))), strict=True))} FROM u)
        SELECT greatest(abs(r - r2), abs(g - g2), abs(b - b2)) AS off, count(*) AS colours FROM v GROUP BY 1""",
}
