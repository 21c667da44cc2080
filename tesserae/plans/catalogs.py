"""Catalog, cache, provider and template queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogs as ops
from . import fixtures as fx

_NAMES = ("Solid", "WATER", "Ladder", "lava", "platform")
_CODES = ((3, "solid", 1), (1, "SOLID", 11), (2, "water", 4), (4, "ladder", 3), (5, "Platform", 2))
_PROVIDERS = (("local", 3, True), ("cloud", 7, True), ("studio", 4, False), ("backup", 8, True))
_PLATFORMS = ("nes", "genesis", "snes")


def _cased(c, names: tuple[str, ...]):  # noqa: ANN001
    return F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))


def name_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of objects to collision codes; the first entry of a name counts."""
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", _cased(F.col("p_partkey"), _NAMES).alias("name"))
    return ops.first_named(rows, spark.createDataFrame(_CODES, "ord int, name string, code int"))


def downsample_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fx.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("source"), (F.col("o_custkey") % 5).cast("int").alias("target"))
    return ops.downsample(pairs, "source", "target")


def cells_of_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprites on maps of 40 x 28 cells of which some are missing."""
    cells = fx.cells(spark, sf_dir).select(F.col("map_id").alias("scene"), (F.col("l_partkey") % 40).alias("tx"), (F.col("l_suppkey") % 28).alias("ty"), "raw").groupBy("scene", "tx", "ty").agg(F.min("raw").alias("raw"))
    points = fx.sprites(spark, sf_dir).select("scene", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y")
    return ops.cell_of(points, cells, ["scene"], 8, 8).drop("x", "y")


def platform_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset"))
    own = fx.table(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("asset"), _cased(F.col("o_custkey"), _PLATFORMS).alias("platform"), F.col("o_orderstatus").alias("stage"))
    return ops.every_variant(assets, _PLATFORMS, own, "asset")


def best_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", ops.best_provider(_cased(F.col("user_id"), tuple(p[0] for p in _PROVIDERS)), (F.col("event_id") % 24).cast("int"), _PROVIDERS).alias("provider"))


def bank_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir).groupBy("seq", (F.col("frame") % 3).alias("anim")).agg(F.min("frame").alias("start"))
    return ops.bank_starts(f.withColumn("anim", F.concat(F.lit("anim"), F.col("anim").cast("string"))), ["seq"], "anim", "start")


def slot_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4).alias("slot"), (F.col("l_partkey") % 16).alias("idx"), F.col("l_orderkey").alias("image"), (F.col("l_orderkey") % 3 == 0).alias("indexed"))
    return ops.slot_usage(p, "slot", "idx", "image", "indexed")


def resource_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.variants(spark, sf_dir)
    return ops.resource_usage(v, "platform", "tiles", F.lit(40_000))


def nested_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.nested_catalog(fx.table(spark, sf_dir, "part"), "p_brand", "p_type", "p_partkey")


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.kind_counts(fx.table(spark, sf_dir, "part").select(F.col("p_type").alias("kind")), "kind")


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the log of a run."""
    log = fx.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    return ops.stage_times(log, "user_id", "event_type", "at")


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return ops.progress(log, "user_id", "at", F.lit(500))


def first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten first sprites of each scene that leave the screen."""
    out = fx.sprites(spark, sf_dir).filter("x + w > 320 or y < 0 or y + h > 224")
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    text = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "x", "y")])
    return ops.first_of(out, ["scene"], place, text, 10)


def request_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests without a cached answer, by key."""
    key = ops.request_key({"description": (F.concat(F.lit("sprite "), (F.col("p_partkey") % 400).cast("string")), True), "height": (F.col("p_size"), False), "width": (F.col("p_size") * 2, False)})
    asked = fx.table(spark, sf_dir, "part").select(key.alias("key"))
    return ops.uncached(asked, fx.table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(key.alias("key")), "key")


def analysis_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and clicks as requests, purchases as answers that hold for a day."""
    e = fx.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), "event_type")
    return ops.fresh_answers(e.filter("event_type in ('error', 'click')"), e.filter("event_type = 'purchase'"), "user_id", "at")


def character_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3 != 0).alias("combat"))
    return ops.character_machine(c, "c_custkey", "combat")


def autotile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir).select("map_id", (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 28).alias("y")).distinct()
    return ops.autotile(cells, "map_id", (F.col("x") + F.col("y")) % 3 != 0)


def asset_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask kind, target side, size on a smaller screen and frames of made-up assets."""
    o = fx.table(spark, sf_dir, "orders")
    side, frames = F.col("o_orderkey") % 90 + 4, F.col("o_custkey") % 12 + 1
    return o.select(
        "o_orderkey", ops.mask_kind(F.col("o_orderkey") % 10 / 10.0, F.when(F.col("o_custkey") % 9 == 0, "boss").otherwise("enemy")).alias("mask"), ops.sheet_target(side, F.col("o_custkey") % 60).alias("target"),
        ops.tier_size(side, F.lit(320), F.lit(256)).alias("size"), ops.frame_clamp(frames, F.lit(8), F.col("o_orderkey") % 7, F.col("o_orderkey") % 5 != 0).cast("long").alias("frames"),
    )


def animation_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order by status as an asset's states."""
    return ops.animation_sets(fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber").distinct(), ["l_orderkey"], "l_returnflag", "l_linenumber")


QUERIES = {f.__name__: f for f in (
    name_codes, downsample_configs, cells_of_points, platform_variants, best_providers, bank_starts, slot_usage, resource_usage, nested_catalog, kind_counts, stage_times, progress_log, first_violations, request_cache,
    analysis_cache, character_machine, autotile, asset_targets, animation_sets,
)}


def _pick(key: str, names: tuple[str, ...]) -> str:
    return f"[{', '.join(repr(n) for n in names)}][{key} % {len(names)} + 1]"


_FITS = " ".join(f"WHEN available AND (needs = 0 OR needs & {bits} <> 0) AND preferred = '{name}' THEN '{name}'" for name, bits, available in _PROVIDERS if available).replace("available AND ", "")
_ORDER = " ".join(f"WHEN needs = 0 OR needs & {bits} <> 0 THEN '{name}'" for name, bits, available in _PROVIDERS if available)
_DOWN = "CASE WHEN source = target THEN NULL {up} WHEN source = 2 AND target = 0 THEN {a} WHEN source = 2 AND target = 1 THEN {b} WHEN source = 4 AND target = 2 THEN {c} ELSE {other} END"


def _down(n: int, other: str, up: str = "WHEN source < target THEN NULL") -> str:
    said = [repr(v[n]) if isinstance(v[n], str) else str(v[n]).lower() for v in ops.DOWN.values()]
    return _DOWN.format(up=up, a=said[0], b=said[1], c=said[2], other=other)


ORACLE_SQL = {
    "name_codes": f"WITH codes(ord, name, code) AS (VALUES {', '.join(map(str, _CODES))}), f AS (SELECT lower(name) AS low, arg_min(code, ord) AS code FROM codes GROUP BY 1), n AS (SELECT p_partkey, {_pick('p_partkey', _NAMES)} AS name FROM part) SELECT p_partkey, name, code FROM n LEFT JOIN f ON low = lower(name)",
    "downsample_configs": f"""WITH p AS (SELECT o_orderkey, CAST(o_orderkey % 5 AS INTEGER) AS source, CAST(o_custkey % 5 AS INTEGER) AS target FROM orders)
        SELECT *, {_down(0, "'median_cut'", "WHEN source < target THEN 'error'")} AS reduction, {_down(1, "target >= 1")} AS dither, {_down(2, "CASE WHEN target <= 0 THEN 'NEAREST' ELSE 'LANCZOS' END")} AS resize, {_down(3, "'euclidean'")} AS matching FROM p""",
    "cells_of_points": f"""WITH {fx.SPRITES}, {fx.CELLS}, g AS (SELECT map_id AS scene, l_partkey % 40 AS tx, l_suppkey % 28 AS ty, min(raw) AS raw FROM cells GROUP BY ALL),
        p AS (SELECT scene, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(x / 8) AS BIGINT) AS tx, CAST(floor(y / 8) AS BIGINT) AS ty FROM sprites) SELECT p.*, raw FROM p LEFT JOIN g USING (scene, tx, ty)""",
    "platform_variants": f"""WITH g AS (SELECT o_orderkey AS asset, unnest({list(_PLATFORMS)}) AS platform FROM orders), o AS (SELECT o_orderkey AS asset, {_pick('o_custkey', _PLATFORMS)} AS platform, o_orderstatus AS stage FROM orders WHERE o_orderkey % 4 <> 0)
        SELECT asset, platform, coalesce(stage, 'pending') AS stage FROM g LEFT JOIN o USING (asset, platform)""",
    "best_providers": f"WITH r AS (SELECT event_id, {_pick('user_id', tuple(p[0] for p in _PROVIDERS))} AS preferred, CAST(event_id % 24 AS INTEGER) AS needs FROM events) SELECT event_id, CASE {_FITS} {_ORDER} END AS provider FROM r",
    "bank_starts": f"WITH {fx.FRAMES}, f AS (SELECT seq, 'anim' || frame % 3 AS anim, min(frame) AS start FROM frames GROUP BY 1, 2) SELECT seq, string_agg(anim || ':' || start, ',' ORDER BY anim) AS banks FROM f GROUP BY 1",
    "slot_usage": "WITH i AS (SELECT l_orderkey % 4 AS slot, l_partkey % 16 AS idx, l_orderkey % 3 = 0 AS indexed, count(*) AS n FROM lineitem GROUP BY l_orderkey, 1, 2, 3) SELECT slot, idx, count(*) AS images, CAST(sum(CASE WHEN indexed THEN 1 ELSE n END) AS BIGINT) AS uses FROM i GROUP BY 1, 2",
    "resource_usage": f"WITH {fx.VARIANTS}, u AS (SELECT platform, CAST(sum(tiles) AS BIGINT) AS tiles FROM variants GROUP BY 1) SELECT platform, tiles, tiles * 1000 // 40000 AS share, tiles * 10 > 40000 * 9 AS near FROM u",
    "nested_catalog": "WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2) SELECT p_brand, string_agg(p_type || ':' || n || ':' || f, ',' ORDER BY p_type) AS actions FROM c GROUP BY 1",
    "kind_counts": "SELECT coalesce(p_type, 'total') AS kind, count(*) AS n FROM part GROUP BY ROLLUP (p_type)",
    "stage_times": "WITH l AS (SELECT user_id, event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)) - epoch_us(ts) AS d FROM events) SELECT user_id, event_type, CAST(sum(d) AS BIGINT) AS micros, count(*) AS entries FROM l WHERE d IS NOT NULL GROUP BY 1, 2",
    "progress_log": "SELECT user_id, event_id AS id, k * 100 // 500 AS percent, since // (k * 1000000) AS seconds FROM (SELECT user_id, event_id, row_number() OVER w AS k, epoch_us(ts) - min(epoch_us(ts)) OVER w AS since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
    "first_violations": f"""WITH {fx.SPRITES}, o AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM sprites WHERE x + w > 320 OR y < 0 OR y + h > 224)
        SELECT scene, count(*) AS n, string_agg(l_orderkey || '/' || l_linenumber || '/' || x || '/' || y, ',' ORDER BY k) FILTER (k <= 10) AS first FROM o GROUP BY 1""",
    "request_cache": """WITH k AS (SELECT p_partkey, substr(md5('{"description": "sprite ' || p_partkey % 400 || '", "height": ' || p_size || ', "width": ' || p_size * 2 || '}'), 1, 12) AS key FROM part) SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE p_partkey % 3 = 0)""",
    "analysis_cache": """WITH r AS (SELECT user_id, event_id AS id, ts FROM events WHERE event_type IN ('error', 'click')), c AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
        SELECT r.user_id, id, coalesce(r.ts - c.ts <= INTERVAL 24 HOUR, false) AS hit FROM r ASOF LEFT JOIN c ON r.user_id = c.user_id AND r.ts >= c.ts""",
    "character_machine": f"WITH e(src, dst, condition, priority) AS (VALUES {', '.join(map(str, ops.CHARACTER_EDGES))}) SELECT c_custkey, e.* FROM customer, e WHERE c_custkey % 3 <> 0 OR (src IN ('idle', 'walk') AND dst IN ('idle', 'walk'))",
    "autotile": f"""WITH {fx.CELLS}, s AS (SELECT DISTINCT map_id, l_partkey % 40 AS x, l_suppkey % 28 AS y FROM cells WHERE (l_partkey % 40 + l_suppkey % 28) % 3 <> 0)
        SELECT s.*, CAST(CASE WHEN r.x IS NULL THEN 0 ELSE 1 END + CASE WHEN b.x IS NULL THEN 0 ELSE 2 END + CASE WHEN l.x IS NULL THEN 0 ELSE 4 END + CASE WHEN t.x IS NULL THEN 0 ELSE 8 END AS INTEGER) AS mask FROM s
        LEFT JOIN s r ON r.map_id = s.map_id AND r.x = s.x + 1 AND r.y = s.y LEFT JOIN s b ON b.map_id = s.map_id AND b.x = s.x AND b.y = s.y + 1 LEFT JOIN s l ON l.map_id = s.map_id AND l.x = s.x - 1 AND l.y = s.y LEFT JOIN s t ON t.map_id = s.map_id AND t.x = s.x AND t.y = s.y - 1""",
    "asset_targets": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 OR o_custkey % 9 = 0 THEN 'pixel' ELSE 'aabb' END AS mask, CASE WHEN greatest(o_orderkey % 90 + 4, o_custkey % 60) > 48 THEN 32 ELSE 16 END AS target,
        greatest(least((o_orderkey % 90 + 4) * 256 // 320, (o_orderkey % 90 + 4) // 2), 16) // 8 * 8 AS size, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE least(o_custkey % 12 + 1, 8, greatest(1, o_orderkey % 7)) END AS frames FROM orders""",
    "animation_sets": """WITH d AS (SELECT DISTINCT l_orderkey, l_returnflag, CAST(l_linenumber AS VARCHAR) AS n FROM lineitem), s AS (SELECT l_orderkey, l_returnflag, string_agg(n, '+' ORDER BY n) AS items FROM d GROUP BY 1, 2)
        SELECT l_orderkey, string_agg(l_returnflag || '=' || items, ',' ORDER BY l_returnflag) AS states FROM s GROUP BY 1""",
}
