"""Map queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tiles as T
from ..operators import maps as ops
from . import fixtures as fx

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.split(fx.cells(spark, sf_dir))


def gid_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select(*KEY, "gid", "flip_h", "flip_v", "flip_d", T.flip_byte(F.col("flip_h"), F.col("flip_v")).alias("flags"))


def tileset_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.as_of(_cells(spark, sf_dir), fx.tilesets(spark, sf_dir)).groupBy("gid", "first_gid").agg(F.count(F.lit(1)).alias("n"))


def tileset_asof_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way for tilesets too many to broadcast."""
    return ops.as_of(_cells(spark, sf_dir), fx.tilesets(spark, sf_dir), most=0).groupBy("gid", "first_gid").agg(F.count(F.lit(1)).alias("n"))


def tileset_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.contained(ops.as_of(_cells(spark, sf_dir), fx.tilesets(spark, sf_dir))).groupBy("map_id", "inside").agg(F.count(F.lit(1)).alias("n"))


def collision_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ops.as_of(_cells(spark, sf_dir), fx.tilesets(spark, sf_dir))
    return ops.collision(c, fx.tile_properties(spark, sf_dir)).select(*KEY, "gid", "code")


def collision_from_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ops.as_of(_cells(spark, sf_dir), fx.tilesets(spark, sf_dir))
    return ops.collision(c, fx.tile_properties(spark, sf_dir), F.lit(0)).groupBy("map_id", "code").agg(F.count(F.lit(1)).alias("n"))


def map_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as little-endian name-table words."""
    word = T.name_word(F.col("gid") % 2048, F.col("flip_h"), F.col("flip_v"), F.col("map_id").cast("int") % 4, F.lit(False))
    return _cells(spark, sf_dir).select(*KEY, T.word_hex(word, "little").alias("word"))


def map_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _cells(spark, sf_dir).groupBy("map_id").agg(F.max(F.col("l_partkey") % 700).alias("width"), F.max(F.col("l_suppkey")).alias("height"), F.countDistinct("gid").alias("tiles"), F.lit(8).alias("tile_width"), (F.min("l_linenumber") * 8).alias("tile_height"))
    return ops.validate(m)


QUERIES = {f.__name__: f for f in (gid_flags, tileset_asof, tileset_asof_blocks, tileset_contains, collision_lookup, collision_from_properties, map_words, map_validation)}

_SPLIT = f"{fx.CELLS}, s AS (SELECT *, raw & 536870911 AS gid, raw & 2147483648 <> 0 AS flip_h, raw & 1073741824 <> 0 AS flip_v, raw & 536870912 <> 0 AS flip_d FROM cells)"
_ASOF = f"{_SPLIT}, {fx.TILESETS}, a AS (SELECT s.*, CASE WHEN gid > 0 THEN first_gid END AS first_gid, CASE WHEN gid > 0 THEN tile_count END AS tile_count FROM s ASOF LEFT JOIN tilesets t ON s.gid >= t.first_gid)"
_KEY = ", ".join(KEY)
_COUNT = f"WITH {_ASOF} SELECT gid, first_gid, count(*) AS n FROM a GROUP BY 1, 2"

ORACLE_SQL = {
    "gid_flags": f"WITH {_SPLIT} SELECT {_KEY}, gid, flip_h, flip_v, flip_d, CASE WHEN flip_h THEN 64 ELSE 0 END + CASE WHEN flip_v THEN 128 ELSE 0 END AS flags FROM s",
    "tileset_asof": _COUNT,
    "tileset_asof_blocks": _COUNT,
    "tileset_contains": f"WITH {_ASOF} SELECT map_id, coalesce(gid >= first_gid AND gid - first_gid < tile_count, false) AS inside, count(*) AS n FROM a GROUP BY 1, 2",
    "collision_lookup": f"""WITH {_ASOF}, {fx.PROPERTIES} SELECT {_KEY}, gid, CAST(CASE WHEN gid = 0 THEN 0 WHEN a.first_gid IS NULL THEN 1 ELSE coalesce(collision, CASE WHEN gid - a.first_gid < 9 THEN gid - a.first_gid ELSE 1 END) END AS INTEGER) AS code
        FROM a LEFT JOIN properties p ON p.first_gid = a.first_gid AND p.local_id = gid - a.first_gid""",
    "collision_from_properties": f"""WITH {_ASOF}, {fx.PROPERTIES} SELECT map_id, CAST(CASE WHEN gid = 0 OR a.first_gid IS NULL THEN 0 ELSE coalesce(collision, 0) END AS INTEGER) AS code, count(*) AS n
        FROM a LEFT JOIN properties p ON p.first_gid = a.first_gid AND p.local_id = gid - a.first_gid GROUP BY 1, 2""",
    "map_words": f"""WITH {_SPLIT}, w AS (SELECT *, printf('%04X', gid % 2048 + CASE WHEN flip_h THEN 2048 ELSE 0 END + CASE WHEN flip_v THEN 4096 ELSE 0 END + map_id % 4 * 8192) AS x FROM s) SELECT {_KEY}, x[3:4] || x[1:2] AS word FROM w""",
    "map_validation": f"""WITH {_SPLIT}, m AS (SELECT map_id, max(l_partkey % 700) AS width, max(l_suppkey) AS height, count(DISTINCT gid) AS tiles, 8 AS tile_width, min(l_linenumber) * 8 AS tile_height FROM s GROUP BY 1)
        SELECT *, array_to_string(list_filter([CASE WHEN greatest(width, height) > 512 THEN 'size' END, CASE WHEN tiles > 2047 THEN 'tiles' END, CASE WHEN tile_width <> 8 OR tile_height <> 8 THEN 'tile size' END], lambda x: x IS NOT NULL), ',') AS problems FROM m""",
}
