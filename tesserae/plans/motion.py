"""Animation and state-machine queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..operators import motion as ops
from . import fixtures as fx


def anim_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from a part's type, with numbers and some suffixes."""
    suffix = F.when(F.col("p_partkey") % 3 == 0, ".png").otherwise("")
    kinds = F.array(*map(F.lit, ("Walk", "idle", "Attack", "jump", "hero", "")))
    name = F.concat(F.element_at(kinds, (F.col("p_partkey") % 6 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(""), F.when(F.col("p_partkey") % 11 == 0, "x").otherwise(F.col("p_size").cast("string")), suffix)
    return ops.from_names(fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), name.alias("name"), F.floor(F.col("p_partkey") / 256).alias("sheet")), keys=["sheet"])


def frame_at_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.frames(spark, sf_dir)
    moments = frames.select("seq").distinct().select("seq", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(5))).alias("tick"))
    return ops.frame_at(frames, moments, ["seq"])


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.timeline(fx.frames(spark, sf_dir), ["seq"]).select("seq", "frame", "ticks", "start", "end", "total")


def pingpong_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = fx.frames(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    way = F.element_at(F.array(F.lit("forward"), F.lit("reverse"), F.lit("pingpong")), (F.col("seq") % 3 + 1).cast("int"))
    played = F.transform(ops.directions(F.col("frames"), way), lambda x: x.cast("string"))
    return frames.select("seq", way.alias("direction"), F.array_join(played, ",").alias("played"))


def row_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sprites(spark, sf_dir).select("scene", "x", "y", "w", "h").distinct()
    return ops.row_sequences(s, ["scene"]).select("scene", "row", "x", "y", "w", "h", "frame", "frames", "is_animation", "action")


def spatial_sequences(spark: SparkSession, sf_dir: str, size: int = 4) -> DataFrame:
    """Every four parts in order are a sequence; what is left over at the end is dropped."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / size).alias("seq"), (F.col("p_partkey") % size).alias("frame"))
    whole = p.groupBy("seq").count().filter(F.col("count") == size).select("seq")
    return p.join(whole, "seq").select("p_partkey", "seq", "frame")


def tag_frames_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags [from, to] over the frames of their sequence."""
    frames = fx.frames(spark, sf_dir).select("seq", "frame")
    tags = frames.filter("frame % 2 = 0").select("seq", F.col("frame").alias("from"), (F.col("frame") + 2).alias("to"))
    spans = tags.select("seq", "from", "to", F.explode(F.sequence("from", "to")).alias("frame"))  # spans are short
    return spans.join(frames, ["seq", "frame"]).select("seq", "from", "to", "frame")


def _fsm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = fx.edges(spark, sf_dir)
    e = e.select("fsm", "src", F.when(F.col("dst") == "assistant-7", "lost").otherwise(F.col("dst")).alias("dst"), F.when(F.col("src").like("user%"), "anim_complete").otherwise("input_go").alias("condition"))
    names = e.select("fsm", F.col("src").alias("state")).union(e.filter("dst <> 'lost'").select("fsm", F.col("dst").alias("state"))).distinct()
    states = names.select("fsm", "state", (F.length("state") + F.substring_index("state", "-", -1).cast("int")).alias("anim"), (~F.col("state").like("assistant%")).alias("loop"))
    starts = e.select("fsm").distinct().select("fsm", F.lit("system-0").alias("state"))
    return states, e, starts


def fsm_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, starts = _fsm(spark, sf_dir)
    return ops.reachable(edges, starts, ["fsm"])


def fsm_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fsm_problems(*_fsm(spark, sf_dir), "fsm")


def fsm_invalid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fsm_problems(spark, sf_dir).filter("problem = 'no target'").select("fsm", "state")


def fsm_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.edges(spark, sf_dir).select("fsm", "src", "dst", (F.length("dst") % 3).alias("priority"), F.col("dst").alias("ord"))
    c = ops.condition(F.concat(F.when(F.col("fsm") % 2 == 0, "!").otherwise(""), F.when(F.col("priority") == 0, "input_").when(F.col("priority") == 1, "timer_").otherwise(""), F.col("dst")))
    return ops.prioritised(e, ["fsm"]).select("fsm", "src", "dst", "rank", c["kind"].alias("kind"), c["name"].alias("name"), c["negated"].alias("negated"))


QUERIES = {f.__name__: f for f in (anim_from_names, frame_at_tick, timeline, pingpong_frames, row_sequences, spatial_sequences, tag_frames_interval, fsm_reachable, fsm_problems, fsm_invalid_targets, fsm_priorities)}

_TIME = f"{fx.FRAMES}, t AS (SELECT seq, frame, ticks, loop, CAST(sum(ticks) OVER (PARTITION BY seq ORDER BY frame) - ticks AS BIGINT) AS start, CAST(sum(ticks) OVER (PARTITION BY seq ORDER BY frame) AS BIGINT) AS \"end\", CAST(sum(ticks) OVER (PARTITION BY seq) AS BIGINT) AS total FROM frames)"
_FSM = f"""{fx.EDGES}, e AS (SELECT fsm, src, CASE WHEN dst = 'assistant-7' THEN 'lost' ELSE dst END AS dst, CASE WHEN src LIKE 'user%' THEN 'anim_complete' ELSE 'input_go' END AS condition FROM edges),
    names AS (SELECT fsm, src AS state FROM e UNION SELECT fsm, dst FROM e WHERE dst <> 'lost'), states AS (SELECT fsm, state, length(state) + CAST(split_part(state, '-', 2) AS INTEGER) AS anim, NOT state LIKE 'assistant%' AS loop FROM names),
    starts AS (SELECT DISTINCT fsm, 'system-0' AS state FROM e), r AS (SELECT * FROM starts UNION SELECT e.fsm, e.dst FROM r JOIN e ON r.fsm = e.fsm AND r.state = e.src),
    problems AS (SELECT fsm, state, 'no start' AS problem FROM starts ANTI JOIN states USING (fsm, state) UNION ALL SELECT DISTINCT fsm, dst, 'no target' FROM e ANTI JOIN states s ON s.fsm = e.fsm AND s.state = e.dst
        UNION ALL SELECT fsm, state, 'unreachable' FROM states ANTI JOIN r USING (fsm, state) UNION ALL SELECT fsm, state, 'no exit' FROM (SELECT * FROM states WHERE NOT loop) s ANTI JOIN (SELECT * FROM e WHERE condition = 'anim_complete') e ON e.fsm = s.fsm AND e.src = s.state
        UNION ALL SELECT fsm, state, 'shared animation' FROM (SELECT *, count(*) OVER (PARTITION BY fsm, anim) AS n FROM states) WHERE n > 1)"""
_TICKS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.TICKS.items())

ORACLE_SQL = {
    "anim_from_names": rf"""WITH p AS (SELECT p_partkey AS ord, (['Walk', 'idle', 'Attack', 'jump', 'hero', ''])[p_partkey % 6 + 1] || CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE CAST(p_size AS VARCHAR) END
        || CASE WHEN p_partkey % 3 = 0 THEN '.png' ELSE '' END AS name, p_partkey // 256 AS sheet FROM part), s AS (SELECT *, replace(name, '.png', '') AS stem FROM p),
        f AS (SELECT ord, name, sheet, lower(regexp_extract(stem, '^(.+?)[-_]?(\d+)$', 1)) AS action, CAST(regexp_extract(stem, '^(.+?)[-_]?(\d+)$', 2) AS BIGINT) AS number FROM s WHERE regexp_matches(stem, '^(.+?)[-_]?(\d+)$'))
        SELECT *, CAST(row_number() OVER (PARTITION BY sheet, action ORDER BY number, ord) - 1 AS INTEGER) AS frame, CASE action {_TICKS} ELSE 6 END AS ticks, action NOT IN {dims.ONE_SHOT} AS loop FROM f""",
    "timeline": f'WITH {_TIME} SELECT seq, frame, ticks, start, "end", total FROM t',
    "frame_at_tick": f"""WITH {_TIME}, m AS (SELECT seq, unnest(range(0, 61, 5)) AS tick FROM (SELECT DISTINCT seq FROM frames)), a AS (SELECT t.*, tick, CASE WHEN loop THEN tick % total ELSE least(tick, total - 1) END AS moment FROM m JOIN t USING (seq))
        SELECT seq, CAST(tick AS INTEGER) AS tick, frame FROM a WHERE start <= moment AND moment < "end" """,
    "pingpong_frames": f"""WITH {fx.FRAMES}, f AS (SELECT seq, list(frame ORDER BY frame) AS l FROM frames GROUP BY 1), d AS (SELECT seq, l, (['forward', 'reverse', 'pingpong'])[seq % 3 + 1] AS direction FROM f)
        SELECT seq, direction, array_to_string(CASE direction WHEN 'reverse' THEN list_reverse(l) WHEN 'pingpong' THEN l || CASE WHEN len(l) > 2 THEN list_reverse(l[2:len(l) - 1]) ELSE [] END ELSE l END, ',') AS played FROM d""",
    "row_sequences": f"""WITH {fx.SPRITES}, s AS (SELECT DISTINCT scene, x, y, w, h, CAST(floor(y / 8.0) AS BIGINT) AS row FROM sprites),
        f AS (SELECT *, row_number() OVER (PARTITION BY scene, row ORDER BY x, y, w, h) - 1 AS frame, count(*) OVER v AS frames, max(w) OVER v - min(w) OVER v <= 4 AND max(h) OVER v - min(h) OVER v <= 4 AND count(*) OVER v >= 2 AS is_animation FROM s WINDOW v AS (PARTITION BY scene, row))
        SELECT scene, row, x, y, w, h, CAST(frame AS INTEGER) AS frame, frames, is_animation, CASE WHEN NOT is_animation THEN NULL WHEN frames >= 6 THEN 'walk' WHEN frames >= 4 THEN 'run' WHEN frames = 2 THEN 'idle' END AS action FROM f""",
    "spatial_sequences": "SELECT p_partkey, p_partkey // 4 AS seq, p_partkey % 4 AS frame FROM part WHERE p_partkey // 4 IN (SELECT p_partkey // 4 FROM part GROUP BY 1 HAVING count(*) = 4)",
    "tag_frames_interval": f"""WITH {fx.FRAMES}, t AS (SELECT seq, frame AS "from", frame + 2 AS "to" FROM frames WHERE frame % 2 = 0) SELECT seq, "from", "to", frame FROM t JOIN frames USING (seq) WHERE frame BETWEEN "from" AND "to" """,
    "fsm_reachable": f"WITH RECURSIVE {_FSM} SELECT * FROM r",
    "fsm_problems": f"WITH RECURSIVE {_FSM} SELECT * FROM problems",
    "fsm_invalid_targets": f"WITH RECURSIVE {_FSM} SELECT fsm, state FROM problems WHERE problem = 'no target'",
    "fsm_priorities": f"""WITH {fx.EDGES}, p AS (SELECT *, length(dst) % 3 AS priority FROM edges)
        SELECT fsm, src, dst, CAST(row_number() OVER (PARTITION BY fsm, src ORDER BY priority DESC, dst) AS INTEGER) AS rank, CASE priority WHEN 0 THEN 'input' WHEN 1 THEN 'timer' ELSE 'flag' END AS kind, dst AS name, fsm % 2 = 0 AS negated FROM p""",
}
