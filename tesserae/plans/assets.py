"""Manifest, validation, metric and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import geometry as G
from ..functions import text as X
from ..operators import assets as ops
from . import fixtures as fx

PLATFORMS = {"AUTOMOBILE": "nes", "BUILDING": "sms", "FURNITURE": "genesis", "HOUSEHOLD": "snes", "MACHINERY": "gba"}
SHEET = (8, 16, 24, 32, 64)


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.variants(spark, sf_dir).withColumn("platform", dims.lookup(F.col("platform"), PLATFORMS, "other"))


def manifest_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.usage(_variants(spark, sf_dir))


def palette_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.palette_users(_variants(spark, sf_dir))


def needs_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unfinished(_variants(spark, sf_dir), "F").select("asset", "platform", "stage")


def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.md5("o_orderpriority").alias("hash"))
    before = o.filter("o_orderkey % 3 <> 0").withColumn("hash", F.when(F.col("o_orderkey") % 5 == 0, F.lit("old")).otherwise(F.col("hash")))
    return ops.changed(o, before, "o_orderkey").select("o_orderkey", "why")


def tier_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir).groupBy((F.col("asset") % 200).alias("family")).agg(F.collect_set("platform").alias("platforms"))
    return ops.highest_tier(v, "platforms").select("family", "tier")


def limit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir).withColumn("tier", dims.tier(F.col("platform")))
    limit = dims.lookup(F.col("tier"), {t[0]: t[5] for t in dims.TIERS}, 0)
    rules = [*ops.limit_rules(F.col("tiles"), limit, "tiles"), ("error", "stage", F.col("stage") == "P"), ("warning", "palette", F.col("palette") == 3)]
    return ops.validated(v, rules).select("asset", "tiles", "errors", "warnings", "valid")


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = [("error", "short", F.col("n_chars") < 100), ("error", "long", F.col("n_chars") > 20_000), ("warning", "unlabelled", F.col("quality").isNull()), ("error", "bad", F.col("quality") == 0)]
    return ops.validated(d, rules).select("doc_id", "errors", "warnings", "valid")


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.floor("value").cast("string")).alias("v"))
    return ops.summary(m, ["event_type"], "v")


def cost_running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", (F.col("user_id") % 5).alias("provider"), "ts", F.floor(F.col("value") * 100).cast("decimal(12,0)").alias("cost"))
    out = ops.ledger(c, ["provider"], ["ts", "event_id"], 100_000)
    return out.select("event_id", "provider", F.col("spent").cast("long").alias("spent"), F.col("left").cast("long").alias("left"), "inside")


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.status_counts(_variants(spark, sf_dir), ["platform", "stage"], "tiles")


def tile_offset_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.prefix_offsets(_variants(spark, sf_dir), ["platform"], ["asset"], "tiles").select("asset", "platform", "tiles", "offset")


def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("_"), (F.col("p_partkey") % 4).cast("string")).alias("name"))
    return ops.duplicate_names(p, "p_brand", X.c_identifier(F.col("name"))).select("p_partkey", "p_brand", "name", "clean")


def sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sprites(spark, sf_dir).select(F.col("l_orderkey").alias("sheet"), "l_linenumber", "l_partkey", "l_suppkey", "w", "h").distinct()
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return ops.sheet_layout(s, ["sheet"], order, 3, SHEET).select("sheet", *order, "i", "cell_w", "cell_h", "x", "y")


def label_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    labels = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderpriority").alias("type"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("description"))
    return ops.first_labels(items, labels, "id", "o_orderkey")


def size_position_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sprites(spark, sf_dir).withColumn("w", F.when(F.col("l_partkey") % 9 == 0, F.col("w") * 3).otherwise(F.col("w")))
    return ops.classify(s, 224).groupBy("size", "place", "type", "action").agg(F.count(F.lit(1)).alias("n"))


def bbox_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("player", "bullet", "pickup", "boss", "door")))
    s = fx.sprites(spark, sf_dir).select("w", "h", F.element_at(kinds, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("kind")).distinct()
    b = s.withColumn("b", G.default_boxes(F.col("kind"), F.col("w"), F.col("h")))
    return b.select("kind", "w", "h", *[F.col(f"b.{k}.{c}").alias(f"{k}_{c}") for k in ("hit", "hurt") for c in "xywh"], *[G.margin_box(F.col("w"), F.col("h"), 15)[c].alias(f"inner_{c}") for c in "xywh"])


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.floor(k / n) % len(words) + 1).cast("int"))
    name = F.concat(pick(("enemy", "player", "bg", "slime"), 1), F.lit("_"), pick(("slime", "Cyber-ninja", "blue"), 3), F.lit("-"), pick(("attack", "idle", "f01", "pickup"), 5), pick(("", "_f12", "_frame3", "_red", "_x"), 7), F.lit(".png"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", name.alias("file"))


def label_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir).withColumn("l", X.label(F.col("file")))
    return n.select("p_partkey", "file", "l.category", "l.name", "l.state", "l.frame", "l.variant", X.label_filename(F.col("l")).alias("standard"), dims.name_hint(F.col("file")).alias("hint"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.when(F.col("p_partkey") % 7 == 0, "..").otherwise(""), F.when(F.col("p_partkey") % 5 == 0, "con").otherwise(F.col("p_brand")), F.lit(':?'), F.when(F.col("p_partkey") % 10 == 5, F.lit("")).otherwise(F.col("p_type")), F.lit(".png "))
    raw = F.when(F.col("p_partkey") % 5 == 0, F.lit("con.png")).otherwise(raw)
    return fx.table(spark, sf_dir, "part").select("p_partkey", X.safe_filename(raw).alias("safe"), X.c_identifier(F.col("p_type")).alias("c_name"), X.upper_snake(F.col("p_type")).alias("constant"), X.mask_secret(F.col("p_type")).alias("masked"))


def readable_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", X.size(F.col("n_chars") * F.col("n_chars") * 64).alias("size"), X.duration(F.floor(F.col("n_chars") / 4) * F.lit(0.25)).alias("duration"))


QUERIES = {
    f.__name__: f
    for f in (
        manifest_usage, palette_users, needs_processing, manifest_changes, tier_max, limit_check, document_rules, metric_summary, cost_running_budget, status_rollup, tile_offset_prefix, duplicate_names,
        sheet_layout, label_left_join, size_position_class, bbox_defaults, label_infer, safe_names, readable_sizes,
    )
}

_V = f"{fx.VARIANTS}, v AS (SELECT asset, CASE platform {' '.join(f'WHEN {k!r} THEN {p!r}' for k, p in PLATFORMS.items())} ELSE 'other' END AS platform, stage, tiles, palette FROM variants)"
_TIER = "CASE platform " + " ".join(f"WHEN '{p}' THEN {t[0]}" for t in dims.TIERS for p in t[7]) + " ELSE 0 END"
_SPEC = lambda k: "CASE tier " + " ".join(f"WHEN {t[0]} THEN {t[k]}" for t in dims.TIERS) + " END"
_LIST = lambda *cases: f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {n!r} END' for n, c in cases)}], lambda x: x IS NOT NULL), ',')"
_BOX = lambda k, size: f"CAST(floor({size} * CASE g " + " ".join(f"WHEN {n!r} THEN {v[k] or 0}" for n, v in dims.BOXES.items()) + " END / 100.0) AS INTEGER)"
_PICK = lambda words, n: f"([{', '.join(map(repr, words))}])[p_partkey // {n} % {len(words)} + 1]"
_IN = lambda words: "(" + ", ".join(map(repr, words)) + ")"

ORACLE_SQL = {
    "safe_names": r"""WITH n AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 5 = 0 THEN 'con.png' ELSE CASE WHEN p_partkey % 7 = 0 THEN '..' ELSE '' END || p_brand || ':?' || p_type || '.png ' END AS raw FROM part),
        t AS (SELECT *, trim(regexp_replace(raw, '[/\\<>:"|?*\r\n\t]', '_', 'g'), '. ') AS t FROM n)
        SELECT p_partkey, CASE WHEN upper(regexp_replace(t, '[.][^.]*$', '')) = 'CON' THEN '_' || t ELSE t END AS safe, lower(regexp_replace(p_type, '[^\p{L}\p{N}_]', '_', 'g')) AS c_name, upper(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) AS constant,
            CASE WHEN length(p_type) <= 8 THEN '***' ELSE p_type[:4] || '...' || p_type[-4:] END AS masked FROM t""",
    "manifest_usage": f"WITH {_V}, u AS (SELECT platform, count(*) AS assets, CAST(sum(tiles) AS BIGINT) AS tiles, count(DISTINCT palette) AS palettes, {_TIER} AS tier FROM v GROUP BY 1) SELECT *, tiles <= {_SPEC(5)} AS tiles_ok, palettes <= {_SPEC(3)} AS palettes_ok FROM u",
    "palette_users": f"WITH {_V} SELECT platform, palette, count(*) AS assets, min(asset) AS first FROM v GROUP BY 1, 2",
    "needs_processing": f"WITH {_V} SELECT asset, platform, stage FROM v WHERE stage <> 'F'",
    "manifest_changes": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'changed' END AS why FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0",
    "tier_max": f"WITH {_V} SELECT asset % 200 AS family, max({_TIER}) AS tier FROM v GROUP BY 1",
    "limit_check": f"""WITH {_V}, t AS (SELECT *, {_TIER} AS tier FROM v), l AS (SELECT *, {_SPEC(5)} AS lim FROM t), e AS (SELECT *, {_LIST(('tiles', 'tiles > lim'), ('stage', "stage = 'P'"))} AS errors, {_LIST(('tiles', 'tiles <= lim AND tiles * 10 > lim * 9'), ('palette', 'palette = 3'))} AS warnings FROM l)
        SELECT asset, tiles, errors, warnings, errors = '' AS valid FROM e""",
    "document_rules": f"WITH e AS (SELECT doc_id, {_LIST(('short', 'n_chars < 100'), ('long', 'n_chars > 20000'), ('bad', 'quality = 0'))} AS errors, {_LIST(('unlabelled', 'quality IS NULL'),)} AS warnings FROM documents LEFT JOIN labels USING (doc_id)) SELECT *, errors = '' AS valid FROM e",
    "metric_summary": "WITH m AS (SELECT event_type, CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value) AS DOUBLE) END AS v FROM events) SELECT event_type, count(v) AS n, min(v) AS least, max(v) AS most, sum(v) AS total FROM m GROUP BY 1",
    "cost_running_budget": """WITH c AS (SELECT event_id, user_id % 5 AS provider, ts, CAST(floor(value * 100) AS BIGINT) AS cost FROM events WHERE event_type = 'purchase'),
        s AS (SELECT event_id, provider, CAST(sum(cost) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM c) SELECT event_id, provider, spent, 100000 - spent AS "left", spent <= 100000 AS inside FROM s""",
    "status_rollup": f"WITH {_V} SELECT platform, stage, count(*) AS n, CAST(sum(tiles) AS BIGINT) AS total FROM v GROUP BY ROLLUP (platform, stage)",
    "tile_offset_prefix": f"WITH {_V} SELECT asset, platform, tiles, CAST(coalesce(sum(tiles) OVER (PARTITION BY platform ORDER BY asset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM v",
    "duplicate_names": """WITH p AS (SELECT p_partkey, p_brand, p_size || CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '_' END || p_partkey % 4 AS name FROM part), c AS (SELECT *, '_' || replace(name, '-', '_') AS clean FROM p)
        SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, clean) AS n FROM c) WHERE n > 1""",
    "sheet_layout": f"""WITH {fx.SPRITES}, s AS (SELECT DISTINCT l_orderkey AS sheet, l_linenumber, l_partkey, l_suppkey, w, h FROM sprites),
        c AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, list_min(list_filter([8, 16, 24, 32, 64], lambda v: v >= max(w) OVER (PARTITION BY sheet))) AS cell_w, list_min(list_filter([8, 16, 24, 32, 64], lambda v: v >= max(h) OVER (PARTITION BY sheet))) AS cell_h FROM s)
        SELECT sheet, l_linenumber, l_partkey, l_suppkey, CAST(i AS INTEGER) AS i, cell_w, cell_h, i % 3 * cell_w + (cell_w - w) // 2 AS x, i // 3 * cell_h + (cell_h - h) // 2 AS y FROM c""",
    "label_left_join": """WITH f AS (SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS type, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END, o_orderkey) AS d FROM orders GROUP BY 1)
        SELECT c_custkey AS id, coalesce(type, 'unknown') AS type, coalesce(nullif(d, ''), 'unknown') AS description FROM customer LEFT JOIN f ON f.id = c_custkey""",
    "size_position_class": f"""WITH {fx.SPRITES}, s AS (SELECT y, h, CASE WHEN l_partkey % 9 = 0 THEN w * 3 ELSE w END AS w FROM sprites),
        c AS (SELECT *, CASE WHEN greatest(w, h) < 12 THEN 'tiny' WHEN greatest(w, h) < 20 THEN 'small' WHEN greatest(w, h) < 40 THEN 'medium' WHEN greatest(w, h) < 64 THEN 'large' WHEN greatest(w, h) < 256 THEN 'huge' ELSE 'medium' END AS size, (y + h / 2.0::DOUBLE) / 224 AS p FROM s),
        q AS (SELECT *, CASE WHEN p >= 0 AND p < 0.3 THEN 'top' WHEN p >= 0.3 AND p < 0.7 THEN 'middle' WHEN p >= 0.7 AND p < 1 THEN 'bottom' ELSE 'middle' END AS place FROM c)
        SELECT size, place, CASE WHEN size = 'tiny' THEN 'projectile' WHEN size = 'small' THEN 'item' WHEN size IN ('large', 'huge') THEN 'boss' WHEN place = 'top' THEN 'ui' WHEN place = 'bottom' THEN 'item' ELSE 'character' END AS type,
        CASE WHEN w::DOUBLE / h > 1.3 THEN 'run' WHEN w::DOUBLE / h < 0.7 THEN 'jump' WHEN size = 'tiny' THEN 'fly' ELSE 'idle' END AS action, count(*) AS n FROM q GROUP BY ALL""",
    "bbox_defaults": f"""WITH {fx.SPRITES}, s AS (SELECT DISTINCT w, h, (['player', 'bullet', 'pickup', 'boss', 'door'])[l_suppkey % 5 + 1] AS kind FROM sprites), g AS (SELECT *, CASE kind {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in dims.BOX_TYPES.items())} ELSE 'other' END AS g FROM s),
        b AS (SELECT *, {_BOX(0, 'w')} AS hit_w, {_BOX(1, 'h')} AS hit_h, {_BOX(2, 'w')} AS hurt_w, {_BOX(3, 'h')} AS hurt_h, {_BOX(4, 'h')} AS top, {_BOX(5, 'h')} AS hurt_top, CAST(floor(w * 15 / 100.0) AS INTEGER) AS inner_x, CAST(floor(h * 15 / 100.0) AS INTEGER) AS inner_y FROM g)
        SELECT kind, w, h, (w - hit_w) // 2 AS hit_x, CASE WHEN g = 'character' THEN top ELSE (h - hit_h) // 2 END AS hit_y, hit_w, hit_h, (w - hurt_w) // 2 AS hurt_x, CASE WHEN g = 'character' THEN hurt_top ELSE (h - hurt_h) // 2 END AS hurt_y, hurt_w, hurt_h,
        inner_x, inner_y, greatest(1, w - 2 * inner_x) AS inner_w, greatest(1, h - 2 * inner_y) AS inner_h FROM b""",
    "label_infer": f"""WITH n AS (SELECT p_partkey, {_PICK(('enemy', 'player', 'bg', 'slime'), 1)} || '_' || {_PICK(('slime', 'Cyber-ninja', 'blue'), 3)} || '-' || {_PICK(('attack', 'idle', 'f01', 'pickup'), 5)} || {_PICK(('', '_f12', '_frame3', '_red', '_x'), 7)} || '.png' AS file FROM part),
        p AS (SELECT *, string_split(replace(replace(lower(file), '.png', ''), '-', '_'), '_') AS parts FROM n),
        k AS (SELECT *, list_filter(parts, lambda x: x IN {_IN(X.CATEGORIES)}) AS c, list_filter(parts, lambda x: x IN {_IN(X.STATES)} AND x NOT IN {_IN(X.CATEGORIES)}) AS s, list_filter(parts, lambda x: regexp_full_match(x, 'f(rame)?[0-9]+')) AS f,
            list_filter(parts, lambda x: x NOT IN {_IN(X.CATEGORIES)} AND x NOT IN {_IN(X.STATES)} AND NOT regexp_full_match(x, 'f(rame)?[0-9]+')) AS r FROM p),
        l AS (SELECT p_partkey, file, coalesce(c[-1], 'item') AS category, array_to_string([r[1]] || list_filter(r[2:], lambda x: x NOT IN {_IN(X.VARIANTS)}), '_') AS name, s[-1] AS state, CAST(regexp_extract(f[-1], '([0-9]+)$', 1) AS INTEGER) AS frame, list_filter(r[2:], lambda x: x IN {_IN(X.VARIANTS)})[-1] AS variant FROM k)
        SELECT *, concat_ws('_', category, name, state, CASE WHEN frame IS NOT NULL THEN 'f' || lpad(CAST(frame AS VARCHAR), 2, '0') END, variant) || '.png' AS standard,
        CASE {' '.join(f"WHEN regexp_matches(lower(file), '{'|'.join(w)}') THEN '{k}'" for k, w in dims.NAME_HINTS.items())} END AS hint FROM l""",
    "readable_sizes": """WITH d AS (SELECT doc_id, n_chars * n_chars * 64 AS b, n_chars // 4 * 0.25::DOUBLE AS s FROM documents) SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1fB', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1fKB', b / 1024.0::DOUBLE) WHEN b < 1073741824 THEN printf('%.1fMB', b / 1048576.0::DOUBLE)
        WHEN b < 1099511627776 THEN printf('%.1fGB', b / 1073741824.0::DOUBLE) ELSE printf('%.1fTB', b / 1099511627776.0::DOUBLE) END AS size,
        CASE WHEN s < 1 THEN printf('%.0fms', s * 1000) WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || printf('m %.0fs', s - floor(s / 60) * 60) ELSE CAST(floor(s / 3600) AS BIGINT) || 'h ' || CAST(floor((s - floor(s / 3600) * 3600) / 60) AS BIGINT) || 'm' END AS duration FROM d""",
}
