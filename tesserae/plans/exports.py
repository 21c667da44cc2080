"""Generated sources and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import exports as ops
from ..sources import doccomments as comments
from . import fixtures as fx

_PLATFORMS = (("nes", 2, 256), ("genesis", 4, 180), ("gba", 8, 1024))


def animation_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.frames(spark, sf_dir).select(F.concat(F.lit("Hero"), (F.col("seq") % 40).cast("string")).alias("sprite"), F.concat(F.lit("a"), F.col("seq").cast("string")).alias("anim"), "frame", (F.col("frame") * 4).alias("index"), "ticks", "loop")
    return ops.animation_header(f)


def machine_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.edges(spark, sf_dir)
    states = e.select("fsm", F.col("src").alias("state")).union(e.select("fsm", "dst")).distinct().withColumn("ord", F.length("state"))
    conditions = e.select("fsm", F.concat(F.when(F.length("src") % 2 == 0, "!").otherwise(""), F.when(F.length("dst") % 3 == 0, "event_").otherwise("input_"), F.col("dst")).alias("condition"))
    return ops.machine_header(states, conditions)


def sound_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.table(spark, sf_dir, "part")
    return ops.sound_list(p.select(F.col("p_brand").alias("file"), F.concat(F.lower("p_type"), F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 4).alias("priority")))


def collision_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.cells(spark, sf_dir).groupBy(F.col("map_id").alias("map"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 28).alias("y")).agg((F.max("l_partkey") % 9).cast("int").alias("code"))
    return ops.collision_rows(cells, 36)


def sheet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sprites(spark, sf_dir).groupBy("l_orderkey", "l_partkey").agg(*[F.min(c).alias(c) for c in "xywh"])
    return ops.sheet_frames(s.select(F.col("l_orderkey").alias("sheet"), F.col("l_partkey").alias("ord"), F.concat(F.lit("frame_"), F.col("l_partkey").cast("string")).alias("name"), "x", "y", "w", "h"))


def manifest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.manifest_lines(fx.variants(spark, sf_dir).select((F.col("asset") % 500).alias("asset"), "platform", "stage").groupBy("asset", "platform").agg(F.min("stage").alias("stage")), "asset")


def platform_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fan_out(fx.variants(spark, sf_dir), _PLATFORMS)


def doc_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` wrapped as sources: each is a doc comment, some with one inside, before a function, macro, type, or a blank line."""
    lines = fx.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "t")).withColumn("t", F.trim(F.regexp_replace("t", "[^A-Za-z0-9 .]", "")))
    i, n = F.col("i"), F.col("i").cast("string")
    symbol = F.when(i % 4 == 0, F.concat(F.lit("int f"), n, F.lit("(void);"))).when(i % 4 == 1, F.concat(F.lit("#define M"), n, F.lit(" 1"))).when(i % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("typedef struct S"), n, F.lit(" { int x; } S"), n, F.lit(";")))
    last = F.when(i % 4 == 2, F.concat(F.lit("void g"), n, F.lit("(int x);"))).otherwise(F.concat(F.lit("// plain /** not a doc */ "), F.col("t")))
    said = F.concat(F.lit(" * "), F.col("t"), F.when(i % 3 == 0, " /* aside */").otherwise(""))
    source = lines.select("doc_id", "i", F.posexplode(F.array(F.lit("/**"), said, F.lit(" */"), symbol, last)).alias("k", "line"))
    return comments.doc_comments(source.select("doc_id", (F.col("i").cast("long") * 5 + F.col("k")).alias("no"), "line"), "doc_id", "no").select("doc_id", "comment", "first", "text", "kind", "symbol", "section")


QUERIES = {f.__name__: f for f in (animation_header, machine_header, sound_list, collision_rows, sheet_frames, manifest_lines, doc_comments, platform_fan_out)}

_CODE = "upper(regexp_replace({}, '[^A-Za-z0-9]', '_', 'g'))"
_ROW = "CAST({} AS VARCHAR) AS file, CAST({} AS INTEGER) AS section, {} AS item, CAST({} AS BIGINT) AS place, {} AS line"


def _row(file: str, section: int, item: str, place: str, line: str) -> str:
    return "SELECT " + _ROW.format(file, section, item, place, line)


ORACLE_SQL = {
    "animation_header": f"""WITH {fx.FRAMES}, f AS (SELECT 'Hero' || seq % 40 AS sprite, 'a' || seq AS anim, frame, ticks, loop FROM frames), a AS (SELECT sprite, anim, lower(sprite || '_' || anim) AS n, count(*) AS k, bool_or(loop) AS loop FROM f GROUP BY ALL)
        {_row("sprite", 0, "anim", "0", "'extern const AnimationFrame anim_' || n || '[];'")} FROM a UNION ALL {_row("sprite", 0, "anim", "1", "'extern const Animation animation_' || n || ';'")} FROM a
        UNION ALL {_row("sprite", 1, "anim", "-1", "'const AnimationFrame anim_' || n || '[] = {{'".replace("{{", "{"))} FROM a UNION ALL {_row("sprite", 1, "anim", "frame", "'    { ' || frame * 4 || ', ' || ticks || ', 0, 0 },  // frame ' || frame")} FROM f
        UNION ALL {_row("sprite", 1, "anim", str(1 << 40), "'};'")} FROM a UNION ALL {_row("sprite", 1, "anim", str((1 << 40) + 1), "'const Animation animation_' || n || ' = { anim_' || n || ', ' || k || ', ' || CASE WHEN loop THEN 'TRUE' ELSE 'FALSE' END || ' };'")} FROM a
        UNION ALL {_row("sprite", 2, "''", "0", "'#define ' || upper(sprite) || '_ANIM_COUNT ' || count(*)")} FROM a GROUP BY sprite""",
    "machine_header": f"""WITH {fx.EDGES}, s AS (SELECT fsm, state, row_number() OVER (PARTITION BY fsm ORDER BY length(state), state) - 1 AS k FROM (SELECT fsm, src AS state FROM edges UNION SELECT fsm, dst FROM edges)),
        g AS (SELECT DISTINCT fsm, dst AS flag FROM edges WHERE length(dst) % 3 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY fsm ORDER BY flag) - 1 AS k FROM g)
        {_row("fsm", 0, "''", "k", f"'    ' || fsm || '_ANIM_' || {_CODE.format('state')} || ' = ' || k || ','")} FROM s UNION ALL {_row("fsm", 0, "''", "count(*)", "'    ' || fsm || '_ANIM_COUNT'")} FROM s GROUP BY fsm
        UNION ALL {_row("fsm", 1, "''", "k", f"'#define ' || fsm || '_INPUT_' || {_CODE.format('flag')} || ' (1 << ' || k || ')'")} FROM n""",
    "sound_list": f"""WITH e AS (SELECT p_brand AS f, lower(p_type) || '-' || p_partkey AS name, p_size % 4 AS pr, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part), c AS (SELECT *, {_CODE.format("name")} AS code FROM e)
        {_row("f", 0, "''", "k", "'WAV ' || code || ' " + '"converted/' + "' || name || '.pcm" + '" XGM' + "'")} FROM c UNION ALL {_row("f", 1, "''", "k", "'    SFX_' || code || ' = ' || k || ','")} FROM c UNION ALL {_row("f", 2, "''", "k", "'    ' || pr || ',  // ' || code")} FROM c""",
    "collision_rows": f"""WITH {fx.CELLS}, c AS (SELECT map_id AS m, l_partkey % 40 AS x, l_suppkey % 28 AS y, max(l_partkey) % 9 AS code FROM cells GROUP BY 1, 2, 3), r AS (SELECT m, y, unnest(range(36)) AS x FROM (SELECT DISTINCT m, y FROM c WHERE x < 36))
        {_row("r.m", 0, "''", "r.y", "'    ' || string_agg(CAST(coalesce(code, 0) AS VARCHAR), ', ' ORDER BY r.x) || ','")} FROM r LEFT JOIN c ON c.m = r.m AND c.y = r.y AND c.x = r.x GROUP BY r.m, r.y""",
    "sheet_frames": f"""WITH {fx.SPRITES}, s AS (SELECT l_orderkey, l_partkey AS o, min(x) AS x, min(y) AS y, min(w) AS w, min(h) AS h FROM sprites GROUP BY 1, 2)
        {_row("l_orderkey", 0, "''", "o", "'    { ' || x || ', ' || y || ', ' || w || ', ' || h || ', 0, 0 },  // frame_' || o")} FROM s UNION ALL {_row("l_orderkey", 1, "''", "o", "'{" + '"name":"frame_' + "' || o || '" + '","x":' + "' || x || '" + ',"y":' + "' || y || '" + ',"w":' + "' || w || '" + ',"h":' + "' || h || '}'")} FROM s""",
    "manifest_lines": f"""WITH {fx.VARIANTS}, v AS (SELECT asset % 500 AS asset, platform, min(stage) AS stage FROM variants GROUP BY 1, 2)
        {_row("'manifest'", 0, "''", "asset", "'{" + '"asset":' + "' || asset || '" + ',"variants":{' + "' || string_agg('" + '"' + "' || platform || '" + '":"' + "' || stage || '" + '"' + "', ',' ORDER BY platform) || '}}'")} FROM v GROUP BY asset""",
    "platform_fan_out": f"""WITH {fx.VARIANTS}, p(platform, bits, most) AS (VALUES {", ".join(map(str, _PLATFORMS))}) SELECT asset, p.platform, CASE WHEN tiles <= most THEN tiles * bits * 8 END AS bytes, CASE WHEN tiles > most THEN 'too many tiles: ' || tiles END AS error FROM variants, p""",
    "doc_comments": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents), c AS (SELECT doc_id, i, trim(regexp_replace(t, '[^A-Za-z0-9 .]', '', 'g')) AS t FROM l)
        SELECT doc_id, CAST(i + 1 AS INTEGER) AS comment, CAST(5 * i AS BIGINT) AS first, trim(t || CASE WHEN i % 3 = 0 THEN ' /* aside */' ELSE '' END) AS text, CASE i % 4 WHEN 1 THEN 'macro' WHEN 3 THEN 'type' ELSE 'function' END AS kind,
            CASE i % 4 WHEN 0 THEN 'f' WHEN 1 THEN 'M' WHEN 2 THEN 'g' ELSE 'S' END || i AS symbol, '' AS section FROM c""",
}
