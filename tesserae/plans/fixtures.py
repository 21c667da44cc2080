"""The engine's domains as views over the driver's tables: each as a DataFrame, and as SQL for the driver's comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on the screens of scenes, one for a range of orders."""
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 64).alias("scene"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_partkey") * 7 % 320).cast("int").alias("x"),
        ((F.col("l_suppkey") * 13 + F.col("l_linenumber") * 11) % 240 - 16).cast("int").alias("y"),
        (8 * (1 + F.col("l_linenumber") % 4)).cast("int").alias("w"),
        (8 * (1 + F.floor(F.col("l_linenumber") / 2) % 4)).cast("int").alias("h"),
    )


SPRITES = """sprites AS (SELECT l_orderkey // 64 AS scene, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey * 7 % 320 AS INTEGER) AS x,
    CAST((l_suppkey * 13 + l_linenumber * 11) % 240 - 16 AS INTEGER) AS y, CAST(8 * (1 + l_linenumber % 4) AS INTEGER) AS w, CAST(8 * (1 + l_linenumber // 2 % 4) AS INTEGER) AS h FROM lineitem)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 tiles of four colours, mirrored by the parity of their numbers; one row per (l_orderkey, l_linenumber, px)."""
    # A tile follows from its row's numbers and these, and other values make another tile, so that distinct numbers are distinct tiles.
    numbers = [(F.col("l_suppkey") % 5 % 4).cast("int").alias("__a"), (F.col("l_partkey") % 3).cast("int").alias("__b"), (F.col("l_partkey") % 2).cast("int").alias("__c")]
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *numbers).distinct()
    mirrored = [F.coalesce(F.col(c) % 2 == 1, F.lit(False)).alias(f"__{m}") for m, c in (("h", "l_linenumber"), ("v", "l_orderkey"))]
    # The numbers and mirrors take a few dozen values, whatever the rows are, and the 64 sums are made once for each of these.
    shape = ["__a", "__b", "__c", "__h", "__v"]
    kinds = table(spark, sf_dir, "lineitem").select(*numbers, *mirrored).distinct()
    across = [F.when(F.col("__h"), F.col("__a") * (7 - x)).otherwise(F.col("__a") * x) for x in range(8)]
    down = [F.when(F.col("__v"), F.col("__b") * (7 - y)).otherwise(F.col("__b") * y) for y in range(8)]
    px = F.array(*[(across[i % 8] + down[i // 8] + F.col("__c") * (i % 8 * (i // 8))) % 4 for i in range(64)])
    looks = kinds.select(*[F.col(c).alias(f"_{c}") for c in shape], px.alias("px"))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in shape])
    return t.select("*", *mirrored).join(F.broadcast(looks), same).select("l_orderkey", "l_linenumber", "px")


TILES = """tiles AS (SELECT DISTINCT l_orderkey, l_linenumber, list_transform(range(64), lambda i: CAST(((l_suppkey % 5) * (CASE WHEN l_linenumber % 2 = 1 THEN 7 - i % 8 ELSE i % 8 END)
    + (l_partkey % 3) * (CASE WHEN l_orderkey % 2 = 1 THEN 7 - i // 8 ELSE i // 8 END) + (i % 8) * (i // 8) * (l_partkey % 2)) % 4 AS INTEGER)) AS px FROM lineitem)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map cells with flip flags in the top bits; number 0 is an empty cell."""
    line = F.col("l_linenumber").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 64).alias("map_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_partkey") + F.when(line % 7 == 0, 0).otherwise(1) + (line % 4) * F.lit(0x40000000)).alias("raw"),
    )


CELLS = """cells AS (SELECT l_orderkey // 64 AS map_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_partkey + CASE WHEN l_linenumber % 7 = 0 THEN 0 ELSE 1 END + CAST(l_linenumber % 4 AS BIGINT) * 1073741824 AS raw FROM lineitem)"""


def tilesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of 128 numbers; every fifth one is left out, so that numbers past the end of a set occur."""
    first = F.floor(F.col("p_partkey") / 128) * 128 + 1
    return table(spark, sf_dir, "part").groupBy(first.alias("first_gid")).agg(F.count(F.lit(1)).alias("tile_count")).filter("cast((first_gid - 1) / 128 as bigint) % 5 <> 3")


TILESETS = "tilesets AS (SELECT p_partkey // 128 * 128 + 1 AS first_gid, count(*) AS tile_count FROM part GROUP BY 1 HAVING ((p_partkey // 128 * 128 + 1) - 1) // 128 % 5 <> 3)"


def tile_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collision codes of some tiles of a set."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_size % 3 = 0").select((F.floor(key / 128) * 128 + 1).alias("first_gid"), (key % 128).alias("local_id"), (F.col("p_size") % 9).cast("int").alias("collision"))


PROPERTIES = "properties AS (SELECT p_partkey // 128 * 128 + 1 AS first_gid, p_partkey % 128 AS local_id, CAST(p_size % 9 AS INTEGER) AS collision FROM part WHERE p_size % 3 = 0)"


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_partkey") * 37 % 256).cast("int").alias("r"), (F.col("p_partkey") * 91 % 256).cast("int").alias("g"), (F.col("p_size") * 5 % 256).cast("int").alias("b"),
        F.floor(F.col("p_partkey") / 128).cast("int").alias("image"),
    )


COLOURS = "colours AS (SELECT p_partkey, CAST(p_partkey * 37 % 256 AS INTEGER) AS r, CAST(p_partkey * 91 % 256 AS INTEGER) AS g, CAST(p_size * 5 % 256 AS INTEGER) AS b, CAST(p_partkey // 128 AS INTEGER) AS image FROM part)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animation frames: sequence, place, duration in ticks, loop."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("frame"), (F.length("text") % 8 + 1).cast("int").alias("ticks"), (F.col("conv_id") % 2 == 0).alias("loop"))


FRAMES = "frames AS (SELECT conv_id AS seq, turn AS frame, CAST(length(text) % 8 + 1 AS INTEGER) AS ticks, conv_id % 2 = 0 AS loop FROM conversations)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State machines: an edge from a turn's (role, turn) to the next one's."""
    c = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 8).alias("fsm"), "conv_id", "turn", F.concat_ws("-", "role", F.col("turn").cast("string")).alias("state"))
    after = c.select("fsm", "conv_id", (F.col("turn") - 1).alias("turn"), F.col("state").alias("dst"))
    return c.withColumnRenamed("state", "src").join(after, ["fsm", "conv_id", "turn"]).select("fsm", "src", "dst").distinct()


EDGES = """edges AS (SELECT DISTINCT a.conv_id // 8 AS fsm, a.role || '-' || a.turn AS src, b.role || '-' || b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of three models, a little apart, some left out."""
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(d).alias("d")) for m, d in (("a", 0), ("b", 1), ("c", 9))]))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", models.alias("m")).filter("(o_orderkey + m.d) % 4 <> 0")
    return o.select(
        F.floor(F.col("o_orderkey") / 50).alias("image"), F.col("m.model").alias("model"), F.col("o_orderkey").alias("ord"),
        (F.col("o_custkey") * 29 % 1200 + F.col("m.d")).cast("int").alias("x"), (F.col("o_orderkey") * 17 % 800).cast("int").alias("y"),
        (16 + F.col("o_orderkey") % 3 * 8).cast("int").alias("w"), (16 + F.col("o_custkey") % 3 * 8).cast("int").alias("h"), F.col("o_orderpriority").alias("type"),
    )


BOXES = """boxes AS (SELECT o_orderkey // 50 AS image, m AS model, o_orderkey AS ord, CAST(o_custkey * 29 % 1200 + d AS INTEGER) AS x, CAST(o_orderkey * 17 % 800 AS INTEGER) AS y,
    CAST(16 + o_orderkey % 3 * 8 AS INTEGER) AS w, CAST(16 + o_custkey % 3 * 8 AS INTEGER) AS h, o_orderpriority AS type
    FROM orders, (VALUES ('a', 0), ('b', 1), ('c', 9)) AS models(m, d) WHERE (o_orderkey + d) % 4 <> 0)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File changes: path, kind, hash, time."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), F.col("event_type").alias("change"), F.md5("props").alias("hash"), "ts", "value")


CHANGES = "changes AS (SELECT event_id, user_id AS path, event_type AS change, md5(props) AS hash, ts, value FROM events)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest: an asset's variant on a platform, its stage and tiles."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    tiles = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("tiles"))
    return o.join(c, o.o_custkey == c.c_custkey).join(tiles, "o_orderkey").select(
        F.col("o_orderkey").alias("asset"), F.col("c_mktsegment").alias("platform"), F.col("o_orderstatus").alias("stage"), "tiles", (F.col("o_orderkey") % 4).cast("int").alias("palette"),
    )


VARIANTS = """variants AS (SELECT o_orderkey AS asset, c_mktsegment AS platform, o_orderstatus AS stage, tiles, CAST(o_orderkey % 4 AS INTEGER) AS palette
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tiles FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
