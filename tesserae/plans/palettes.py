"""Colour and palette queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import BLACK, BLACKS, FIXED_64
from ..functions import colour as C
from ..operators import palettes as ops
from . import fixtures as fx

FOUR = ((0, 0, 0), (128, 32, 32), (64, 160, 96), (240, 240, 224))


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return fx.table(spark, sf_dir, "nation").select(k.alias("idx"), (k * 53 % 256).cast("int").alias("r"), (k * 101 % 256).cast("int").alias("g"), (F.col("n_regionkey") * 61 % 256).cast("int").alias("b"))


PALETTE = "palette AS (SELECT n_nationkey AS idx, CAST(n_nationkey * 53 % 256 AS INTEGER) AS r, CAST(n_nationkey * 101 % 256 AS INTEGER) AS g, CAST(n_regionkey * 61 % 256 AS INTEGER) AS b FROM nation)"


def nearest_color_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.nearest_join(fx.colours(spark, sf_dir), palette(spark, sf_dir)).select("p_partkey", "idx", F.col("distance").cast("long").alias("distance"))


def nearest_color_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an eye's weights, the palette's first entry left out."""
    return ops.nearest_join(fx.colours(spark, sf_dir), palette(spark, sf_dir), "eye", 1).select("p_partkey", "idx", F.col("distance").cast("long").alias("distance"))


def nearest_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = C.nearest(ops.rgb(), FIXED_64, "eye", BLACKS)
    return fx.colours(spark, sf_dir).select("p_partkey", near["i"].alias("idx"), near["d"].cast("long").alias("distance"))


def nearest_lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In CIELAB; distances in whole hundredths."""
    near = C.nearest(ops.rgb(), FOUR, "lab")
    return fx.colours(spark, sf_dir).select("p_partkey", near["i"].alias("idx"), F.round(F.sqrt(near["d"]), 1).alias("distance"))


def color_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = fx.colours(spark, sf_dir).withColumns({c: (F.floor(F.col(c) / 32) * 32).cast("int") for c in "rgb"})
    return ops.top_colours(coarse, ["image"], "p_partkey", 16)


def weighted_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.weighted_top(fx.colours(spark, sf_dir), ["image"], "p_partkey")


def fixed_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fixed_palette(ops.weighted_top(fx.colours(spark, sf_dir), ["image"], "p_partkey"), ["image"])


def palette_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coverage(fx.colours(spark, sf_dir), FOUR, ["image"])


def _coarse(df: DataFrame) -> DataFrame:
    return df.withColumns({c: (F.floor(F.col(c) / 64) * 64).cast("int") for c in "rgb"})


def palette_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.members(_coarse(fx.colours(spark, sf_dir)), _coarse(palette(spark, sf_dir))).select("p_partkey", "r", "g", "b")


def palette_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.members(_coarse(fx.colours(spark, sf_dir)), _coarse(palette(spark, sf_dir)), False).select("p_partkey", "r", "g", "b")


def snap_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.snapped(ops.top_colours(fx.colours(spark, sf_dir), ["image"], "p_partkey", 16), ["image"])


def color_pack_9bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.colours(spark, sf_dir).withColumn("word", C.pack9(*ops.rgb()))
    r, g, b = C.unpack9(F.col("word"))
    r36, g36, b36 = C.unpack9(F.col("word"), "times36")
    return c.select("p_partkey", "word", r.alias("r"), g.alias("g"), b.alias("b"), r36.alias("r36"), g36.alias("g36"), b36.alias("b36"))


def color_pack_15bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.colours(spark, sf_dir).withColumn("word", C.pack15(*ops.rgb()))
    r, g, b = C.unpack15(F.col("word"))
    return c.select("p_partkey", "word", r.alias("r"), g.alias("g"), b.alias("b"), C.pack24(*ops.rgb()).alias("word24"))


def shade_2bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.colours(spark, sf_dir).select("p_partkey", C.luma(*ops.rgb()).alias("luma"), C.shade2(*ops.rgb()).alias("shade"))


def color_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.colours(spark, sf_dir).select("p_partkey", *[C.quantise_depth(F.col("r"), n).alias(f"r{n}") for n in (1, 2, 3, 4, 5, 6)], C.snap(F.col("g")).alias("g_level"), (F.floor(C.saturation(*ops.rgb()) * 1000)).cast("long").alias("saturation"))


def distinct_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.colours(spark, sf_dir).groupBy("image").agg(F.countDistinct("r", "g", "b").alias("colours"), F.countDistinct("r").alias("reds"))


def ordered_dither_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = fx.colours(spark, sf_dir).withColumns({"x": F.col("p_partkey") % 64, "y": F.floor(F.col("p_partkey") / 64)})
    return ops.ordered_dither(px, FOUR).groupBy("image", "idx").agg(F.count(F.lit(1)).alias("n"))


def dither_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of 2 x 2 squares of a tile that are a checkerboard of two colours."""
    at = lambda i: F.element_at("px", i + 1)
    board = F.filter(F.sequence(F.lit(0), F.lit(54)), lambda i: (i % 8 < 7) & (at(i) == at(i + 9)) & (at(i + 1) == at(i + 8)) & (at(i) != at(i + 1)))
    t = fx.tiles(spark, sf_dir).select(F.size(board).alias("boards"))
    return t.groupBy("boards").agg(F.count(F.lit(1)).alias("tiles"), F.max(F.when(F.col("boards") > 4.9, "heavy").when(F.col("boards") > 0.98, "light").otherwise("none")).alias("dither"))


QUERIES = {
    f.__name__: f
    for f in (
        nearest_color_rgb, nearest_color_weighted, nearest_fixed, nearest_lab, color_histogram_topk, weighted_palette, fixed_palette, palette_coverage, palette_semi, palette_anti, snap_palette, color_pack_9bit,
        color_pack_15bit, shade_2bit, color_depths, distinct_colours, ordered_dither_class, dither_ratio,
    )
}

_D = lambda w: " + ".join(f"(c.{x} - p.{x}) * (c.{x} - p.{x}) * {k}" for x, k in zip("rgb", w, strict=True))
_VALUES = lambda colours: ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(colours))
_NEAREST = "SELECT p_partkey, idx, CAST(d AS BIGINT) AS distance FROM (SELECT c.p_partkey, p.idx, {d} AS d, row_number() OVER (PARTITION BY c.p_partkey ORDER BY {d}, p.idx) AS k FROM colours c, {p} p {where}) WHERE k = 1"
_CUT = "SELECT p_partkey, image, CAST(r // {n} * {n} AS INTEGER) AS r, CAST(g // {n} * {n} AS INTEGER) AS g, CAST(b // {n} * {n} AS INTEGER) AS b FROM colours"
_SNAP = lambda c: f"list_reduce([{', '.join(map(str, C.LEVELS))}], lambda a, v: CASE WHEN abs({c} - v) < abs({c} - a) THEN v ELSE a END)"
_TOP = "SELECT image, r, g, b, n, place FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, f) AS place FROM (SELECT image, r, g, b, count(*) AS n, min(p_partkey) AS f FROM {src} GROUP BY ALL)) WHERE place <= 16"
_WEIGHT = """w AS (SELECT image, CAST(r // 16 * 16 AS INTEGER) AS r, CAST(g // 16 * 16 AS INTEGER) AS g, CAST(b // 16 * 16 AS INTEGER) AS b, min(p_partkey) AS f,
    CAST(sum(CAST(floor(1000 + 2000.0::DOUBLE * ((greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b, 1))) AS BIGINT)) AS BIGINT) AS weight FROM colours GROUP BY 1, 2, 3, 4),
    top AS (SELECT image, r, g, b, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY weight DESC, f) AS place FROM w) WHERE place <= 20)"""
_LIN = lambda c: f"(CASE WHEN {c} / 255.0::DOUBLE > 0.04045 THEN pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {c} / 255.0::DOUBLE / 12.92 END)"
_XYZ = lambda k: "((" + " + ".join(f"{_LIN(c)} * {w}" for c, w in zip("rgb", C.XYZ[k], strict=True)) + f") / {C.WHITE[k]})"
_F = lambda k: f"(CASE WHEN {_XYZ(k)} > 0.008856 THEN pow({_XYZ(k)}, 1.0::DOUBLE / 3) ELSE 7.787 * {_XYZ(k)} + 16.0::DOUBLE / 116 END)"
_LAB = f"116 * {_F(1)} - 16 AS l, 500 * ({_F(0)} - {_F(1)}) AS a, 200 * ({_F(1)} - {_F(2)}) AS bb"
_BAYER = ", ".join(str(v) for row in ops.bayer(4) for v in row)

ORACLE_SQL = {
    "nearest_color_rgb": f"WITH {fx.COLOURS}, {PALETTE} " + _NEAREST.format(d=_D((1, 1, 1)), p="palette", where=""),
    "nearest_color_weighted": f"WITH {fx.COLOURS}, {PALETTE} " + _NEAREST.format(d=_D((300, 590, 110)), p="palette", where="WHERE p.idx >= 1"),
    "nearest_fixed": f"WITH {fx.COLOURS}, fixed(idx, r, g, b) AS (VALUES {_VALUES(FIXED_64)}) " + _NEAREST.format(d=_D((300, 590, 110)), p="fixed", where=f"WHERE p.idx NOT IN {BLACKS}"),
    "nearest_lab": f"""WITH {fx.COLOURS}, four(idx, r, g, b) AS (VALUES {_VALUES(FOUR)}), x AS (SELECT p_partkey, {_LAB} FROM colours), y AS (SELECT idx, {_LAB} FROM four),
        z AS (SELECT p_partkey, idx, (x.l - y.l) * (x.l - y.l) + (x.a - y.a) * (x.a - y.a) + (x.bb - y.bb) * (x.bb - y.bb) AS d FROM x, y)
        SELECT p_partkey, arg_min(idx, d) AS idx, round(sqrt(min(d)), 1) AS distance FROM z GROUP BY 1""",
    "color_histogram_topk": f"WITH {fx.COLOURS}, cut AS ({_CUT.format(n=32)}) {_TOP.format(src='cut')}",
    "weighted_palette": f"WITH {fx.COLOURS}, {_WEIGHT} SELECT * FROM top",
    "fixed_palette": f"""WITH {fx.COLOURS}, {_WEIGHT}, fixed(idx, r, g, b) AS (VALUES {_VALUES(FIXED_64)}),
        n AS (SELECT image, weight, place, CASE WHEN idx IN {BLACKS} THEN {BLACK} ELSE idx END AS idx FROM (SELECT c.*, p.idx, row_number() OVER (PARTITION BY c.image, c.place ORDER BY {_D((1, 1, 1))}, p.idx) AS k FROM top c, fixed p) WHERE k = 1),
        s AS (SELECT image, idx, CAST(sum(weight) AS BIGINT) AS score, min(place) AS seen FROM n GROUP BY ALL),
        b AS (SELECT s.*, (f.r * 299 + f.g * 587 + f.b * 114) // 1000 AS brightness FROM s JOIN fixed f USING (idx)),
        c AS (SELECT *, CASE WHEN brightness < 60 THEN 'dark' WHEN brightness < 160 THEN 'middle' ELSE 'bright' END AS band FROM b),
        d AS (SELECT *, row_number() OVER (PARTITION BY image, band ORDER BY score DESC, seen) AS k FROM c),
        e AS (SELECT *, CASE WHEN band = 'dark' AND k = 1 THEN 0 WHEN band = 'middle' AND k <= 2 THEN 1 WHEN band = 'bright' AND k = 1 THEN 2 ELSE 3 END AS wave FROM d)
        SELECT image, idx, score, CAST(brightness AS BIGINT) AS brightness, band, pick FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY wave, score DESC, seen) AS pick FROM e) WHERE pick <= 4""",
    "palette_coverage": f"""WITH {fx.COLOURS}, four(idx, r, g, b) AS (VALUES {_VALUES(FOUR)}), n AS (SELECT c.p_partkey, c.image, min({_D((1, 1, 1))}) AS d FROM colours c, four p GROUP BY 1, 2)
        SELECT image, count(*) AS pixels, count(*) FILTER (d < 2000) AS matched, CAST(sum(d) AS BIGINT) AS error FROM n GROUP BY 1""",
    "snap_palette": f"WITH {fx.COLOURS}, t AS ({_TOP.format(src='colours')}) SELECT image, {', '.join(f'CAST({_SNAP(c)} AS INTEGER) AS {c}' for c in 'rgb')}, min(place) AS place, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY ALL",
    "color_pack_9bit": f"""WITH {fx.COLOURS}, w AS (SELECT p_partkey, r // 32 AS r3, g // 32 AS g3, b // 32 AS b3 FROM colours), l AS (SELECT *, [{', '.join(map(str, C.LEVELS))}] AS lv FROM w)
        SELECT p_partkey, CAST(r3 * 2 + g3 * 32 + b3 * 512 AS INTEGER) AS word, lv[r3 + 1] AS r, lv[g3 + 1] AS g, lv[b3 + 1] AS b, least(r3 * 36, 255) AS r36, least(g3 * 36, 255) AS g36, least(b3 * 36, 255) AS b36 FROM l""",
    "color_pack_15bit": f"WITH {fx.COLOURS} SELECT p_partkey, r // 8 + g // 8 * 32 + b // 8 * 1024 AS word, r // 8 * 8 AS r, g // 8 * 8 AS g, b // 8 * 8 AS b, r * 65536 + g * 256 + b AS word24 FROM colours",
    "shade_2bit": f"""WITH {fx.COLOURS}, y AS (SELECT p_partkey, r * 299 + g * 587 + b * 114 AS luma FROM colours)
        SELECT p_partkey, luma, CASE WHEN luma >= 192000 THEN 0 WHEN luma >= 128000 THEN 1 WHEN luma >= 64000 THEN 2 ELSE 3 END AS shade FROM y""",
    "color_depths": f"""WITH {fx.COLOURS} SELECT p_partkey, r // 128 * 255 AS r1, r // 64 * 85 AS r2, (r >> 5) * 32 + (r >> 5) * 4 + (r >> 6) AS r3, r // 16 * 17 AS r4, (r >> 3) * 8 + (r >> 5) AS r5, (r >> 2) * 4 + (r >> 6) AS r6,
        {_SNAP('g')} AS g_level, CAST(floor((greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b, 1) * 1000) AS BIGINT) AS saturation FROM colours""",
    "distinct_colours": f"WITH {fx.COLOURS} SELECT image, count(DISTINCT (r, g, b)) AS colours, count(DISTINCT r) AS reds FROM colours GROUP BY 1",
    "ordered_dither_class": f"""WITH {fx.COLOURS}, four(idx, r, g, b) AS (VALUES {_VALUES(FOUR)}),
        t AS (SELECT p_partkey, image, r, g, b, ([{_BAYER}][p_partkey // 64 % 4 * 4 + p_partkey % 64 % 4 + 1] / 16.0::DOUBLE - 0.5) * 85.0 AS t FROM colours),
        c AS (SELECT p_partkey, image, {', '.join(f'greatest(0.0::DOUBLE, least(255.0::DOUBLE, {c} + t)) AS {c}' for c in 'rgb')} FROM t),
        n AS (SELECT image, idx, row_number() OVER (PARTITION BY p_partkey ORDER BY {_D((1, 1, 1))}, idx) AS k FROM c, four p) SELECT image, idx, count(*) AS n FROM n WHERE k = 1 GROUP BY ALL""",
    "dither_ratio": f"""WITH {fx.TILES}, b AS (SELECT len(list_filter(range(55), lambda i: i % 8 < 7 AND px[i + 1] = px[i + 10] AND px[i + 2] = px[i + 9] AND px[i + 1] <> px[i + 2])) AS boards FROM tiles)
        SELECT CAST(boards AS INTEGER) AS boards, count(*) AS tiles, CASE WHEN boards > 4.9 THEN 'heavy' WHEN boards > 0.98 THEN 'light' ELSE 'none' END AS dither FROM b GROUP BY ALL""",
} | {
    f"palette_{kind}": f"WITH {fx.COLOURS}, {PALETTE}, cut AS ({_CUT.format(n=64)}), allowed AS (SELECT DISTINCT r // 64 * 64 AS r, g // 64 * 64 AS g, b // 64 * 64 AS b FROM palette) SELECT p_partkey, r, g, b FROM cut {kind.upper()} JOIN allowed USING (r, g, b)"
    for kind in ("semi", "anti")
}
