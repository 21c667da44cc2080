"""Tile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tiles as T
from ..operators import tiles as ops
from ..operators.storage import stored
from . import fixtures as fx

ORDINAL = ["l_orderkey", "l_linenumber"]


def bank(deduped: DataFrame) -> DataFrame:
    return ops.bank(deduped, ORDINAL, F.shiftright("l_orderkey", 12))


def tile_dedup_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dedup(fx.tiles(spark, sf_dir), ORDINAL, size=64).drop("ck")


def tile_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stored(ops.dedup(fx.tiles(spark, sf_dir), ORDINAL, flips="", size=64), "tiles")
    return d.join(bank(d).select("ck", "tile_id"), "ck").select(*ORDINAL, "key", "tile_id", "kind")


def tile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stats(ops.dedup(fx.tiles(spark, sf_dir), ORDINAL, size=64))


def tile_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("px")
    h, v = T.flip_h(px, size=64), T.flip_v(px, size=64)
    s = fx.tiles(spark, sf_dir).select(T.symmetry(px, size=64).alias("symmetry"), F.floor(T.similarity(px, h) * 64).cast("long").alias("same_h"), F.floor(T.similarity(px, v) * 64).cast("long").alias("same_v"))
    return s.groupBy("symmetry").agg(F.count(F.lit(1)).alias("n"), F.sum("same_h").alias("same_h"), F.sum("same_v").alias("same_v"))


def tilemap_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stored(ops.dedup(fx.tiles(spark, sf_dir), ORDINAL, size=64), "tiles")
    return ops.name_table(d, bank(d), ORDINAL, (F.col("l_orderkey") % 4).cast("int"), F.col("l_linenumber") % 2 == 1, 16)


def tile_convert_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours above 1 become 1 in the bank; the rebuilt map is deduplicated again."""
    t = fx.tiles(spark, sf_dir)
    d = stored(ops.dedup(t, ORDINAL, size=64), "tiles")
    made = ops.rebuild(d, t, ORDINAL, F.transform("px", lambda p: F.least(p, F.lit(1))))
    made = made.select(*ORDINAL, "px", F.col("new_key").alias("key"))
    return ops.stats(ops.dedup_keyed(made.drop("px").distinct(), made.select("px", "key").distinct(), ORDINAL, size=64))


def pixel_mask_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.tiles(spark, sf_dir).select(*ORDINAL, T.key(F.col("px")).alias("key"), T.mask_hex(F.col("px")).alias("mask"))


def tile_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.transform("px", lambda p: p * 3)
    # Counted, since the optimiser drops an inner distinct under an outer one and would encode every tile.
    return fx.tiles(spark, sf_dir).groupBy("px").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(T.encode(F.col("px"), "planar2").alias("planar2"), T.encode(F.col("px"), "rows2").alias("rows2"), T.encode(px, "packed4").alias("packed4"), T.encode(px, "packed4_low").alias("packed4_low"), T.encode(px, "pairs4").alias("pairs4"), T.encode(F.col("px"), "mono1").alias("mono1"), T.encode(F.col("px"), "chunky2").alias("chunky2")).distinct()


def tile_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planar tiles decoded again: those that differ from what was encoded (none)."""
    t = fx.tiles(spark, sf_dir).select("px").distinct()
    return t.withColumn("again", T.decode_planar2(T.encode(F.col("px"), "planar2"), F.lit(0))).agg(F.count(F.lit(1)).alias("tiles"), F.sum((F.col("again") == F.col("px")).cast("long")).alias("equal"))


def dense_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles by their share of pixels in use, 0.3 at least."""
    t = fx.tiles(spark, sf_dir).select("px").distinct().select(T.key(F.col("px")).alias("key"), T.density(F.col("px")).alias("density"))
    return t.filter("density >= 0.3").select("key", F.floor(F.col("density") * 64).cast("long").alias("pixels"))


def quantised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 one-bit tiles: sign masks, and their symmetry."""
    px = F.transform("embedding", lambda v: (v > 0).cast("int"))
    return fx.table(spark, sf_dir, "embeddings").filter(F.size("embedding") == 64).select("vec_id", T.mask_hex(px).alias("mask"), T.symmetry(px, size=64).alias("symmetry"), F.floor(T.density(px) * 64).cast("long").alias("pixels"))


QUERIES = {f.__name__: f for f in (tile_dedup_flip, tile_dedup_exact, tile_stats, tile_symmetry, tilemap_word, tile_convert_rebuild, pixel_mask_hex, tile_layouts, tile_decode, dense_tiles, quantised_vectors)}

_FLIPS = """k AS MATERIALIZED (SELECT l_orderkey, l_linenumber, md5(array_to_string(px, ',')) AS key, md5(array_to_string(list_transform(range(64), lambda i: px[(i // 8) * 8 + 7 - i % 8 + 1]), ',')) AS kh,
    md5(array_to_string(list_transform(range(64), lambda i: px[(7 - i // 8) * 8 + i % 8 + 1]), ',')) AS kv, md5(array_to_string(list_reverse(px), ',')) AS khv FROM {0}),
    c AS (SELECT *, least(key, kh, kv, khv) AS ck FROM k),
    d AS (SELECT *, first_value(key) OVER w AS rep, row_number() OVER w = 1 AS is_first FROM c WINDOW w AS (PARTITION BY ck ORDER BY l_orderkey, l_linenumber, key)),
    m AS MATERIALIZED (SELECT *, CASE WHEN is_first THEN 'unique' WHEN key = rep THEN 'exact' WHEN kh = rep THEN 'h' WHEN kv = rep THEN 'v' ELSE 'hv' END AS kind FROM d)"""
_STATS = """SELECT count(*) AS n_tiles, count(*) FILTER (kind = 'unique') AS n_unique, count(*) FILTER (kind = 'exact') AS n_exact, count(*) FILTER (kind = 'h') AS n_h, count(*) FILTER (kind = 'v') AS n_v,
    count(*) FILTER (kind = 'hv') AS n_hv, CAST(floor((count(*) - count(*) FILTER (kind = 'unique')) * 10000.0 / count(*)) AS BIGINT) AS saved_bp, count(*) FILTER (kind = 'unique') * 256 AS bytes FROM m"""
_HEX = "array_to_string(list_transform(range({n}), lambda k: printf('%02X', {value})), '')"
_BITS = lambda px, b, at: " + ".join(f"(({px}[{at} + {x + 1}] >> {b}) & 1) * {1 << (7 - x)}" for x in range(8))
_PACK = lambda px, per, base, low=False: " + ".join(f"{px}[k * {per} + {j + 1}] % {base} * {base ** (j if low else per - 1 - j)}" for j in range(per))

ORACLE_SQL = {
    "tile_dedup_flip": f"WITH {fx.TILES}, {_FLIPS.format('tiles')} SELECT l_orderkey, l_linenumber, key, rep, kind FROM m",
    "tile_dedup_exact": f"""WITH {fx.TILES}, k AS MATERIALIZED (SELECT l_orderkey, l_linenumber, md5(array_to_string(px, ',')) AS key FROM tiles),
        d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber) = 1 AS is_first FROM k),
        b AS (SELECT key, row_number() OVER (ORDER BY l_orderkey, l_linenumber, key) - 1 AS tile_id FROM d WHERE is_first)
        SELECT l_orderkey, l_linenumber, key, tile_id, CASE WHEN is_first THEN 'unique' ELSE 'exact' END AS kind FROM d JOIN b USING (key)""",
    "tile_stats": f"WITH {fx.TILES}, {_FLIPS.format('tiles')} {_STATS}",
    "tile_symmetry": f"""WITH {fx.TILES}, s AS (SELECT px, list_transform(range(64), lambda i: px[(i // 8) * 8 + 7 - i % 8 + 1]) AS h, list_transform(range(64), lambda i: px[(7 - i // 8) * 8 + i % 8 + 1]) AS v FROM tiles)
        SELECT CASE WHEN px = h AND px = v THEN 'radial' WHEN px = h THEN 'horizontal' WHEN px = v THEN 'vertical' ELSE 'none' END AS symmetry, count(*) AS n,
        CAST(sum(len(list_filter(range(1, 65), lambda i: px[i] = h[i]))) AS BIGINT) AS same_h, CAST(sum(len(list_filter(range(1, 65), lambda i: px[i] = v[i]))) AS BIGINT) AS same_v FROM s GROUP BY 1""",
    "tilemap_word": f"""WITH {fx.TILES}, {_FLIPS.format('tiles')}, b AS (SELECT ck, row_number() OVER (ORDER BY l_orderkey, l_linenumber, key) - 1 AS tile_id FROM m WHERE kind = 'unique')
        SELECT l_orderkey, l_linenumber, key, printf('%04X', ((tile_id + 16) & 2047) + CASE WHEN kind IN ('h', 'hv') THEN 2048 ELSE 0 END + CASE WHEN kind IN ('v', 'hv') THEN 4096 ELSE 0 END
        + l_orderkey % 4 * 8192 + CASE WHEN l_linenumber % 2 = 1 THEN 32768 ELSE 0 END) AS word FROM m JOIN b USING (ck)""",
    "tile_convert_rebuild": f"WITH {fx.TILES}, low AS (SELECT DISTINCT l_orderkey, l_linenumber, list_transform(px, lambda p: least(p, 1)) AS px FROM tiles), {_FLIPS.format('low')} {_STATS}",
    "pixel_mask_hex": f"WITH {fx.TILES} SELECT l_orderkey, l_linenumber, md5(array_to_string(px, ',')) AS key, "
    + _HEX.format(n=8, value=" + ".join(f"(px[k * 8 + {x + 1}] <> 0)::INTEGER * {1 << (7 - x)}" for x in range(8)))
    + " AS mask FROM tiles",
    "tile_layouts": f"WITH {fx.TILES}, t AS (SELECT DISTINCT px, list_transform(px, lambda p: p * 3) AS q FROM tiles) SELECT DISTINCT "
    + ", ".join(
        f"{_HEX.format(n=n, value=value)} AS {name}"
        for name, n, value in (
            ("planar2", 16, f"CASE WHEN k < 8 THEN {_BITS('px', 0, 'k * 8')} ELSE {_BITS('px', 1, '(k - 8) * 8')} END"),
            ("rows2", 16, f"CASE WHEN k % 2 = 0 THEN {_BITS('px', 0, '(k // 2) * 8')} ELSE {_BITS('px', 1, '(k // 2) * 8')} END"),
            ("packed4", 32, _PACK("q", 2, 16)),
            ("packed4_low", 32, _PACK("q", 2, 16, True)),
            ("pairs4", 32, "CASE " + " ".join(f"WHEN k // 16 * 2 + k % 2 = {b} THEN {_BITS('q', b, '(k % 16 // 2) * 8')}" for b in range(4)) + " END"),
            ("mono1", 8, _BITS("px", 0, "k * 8")),
            ("chunky2", 16, _PACK("px", 4, 4)),
        )
    )
    + " FROM t",
    "tile_decode": f"WITH {fx.TILES} SELECT count(DISTINCT px) AS tiles, count(DISTINCT px) AS equal FROM tiles",
    "dense_tiles": f"WITH {fx.TILES} SELECT DISTINCT md5(array_to_string(px, ',')) AS key, len(list_filter(px, lambda p: p <> 0)) AS pixels FROM tiles WHERE len(list_filter(px, lambda p: p <> 0)) / 64.0 >= 0.3",
    "quantised_vectors": "WITH t AS (SELECT vec_id, list_transform(embedding, lambda v: (v > 0)::INTEGER) AS px FROM embeddings WHERE len(embedding) = 64), s AS (SELECT *, list_transform(range(64), lambda i: px[(i // 8) * 8 + 7 - i % 8 + 1]) AS h, list_transform(range(64), lambda i: px[(7 - i // 8) * 8 + i % 8 + 1]) AS v FROM t) SELECT vec_id, "
    + _HEX.format(n=8, value=_BITS("px", 0, "k * 8"))
    + " AS mask, CASE WHEN px = h AND px = v THEN 'radial' WHEN px = h THEN 'horizontal' WHEN px = v THEN 'vertical' ELSE 'none' END AS symmetry, CAST(list_sum(px) AS BIGINT) AS pixels FROM s",
}
