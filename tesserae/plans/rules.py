"""Rule tables over made-up palettes, sheets, recordings, levels and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators import assets
from ..operators import rules as ops
from . import fixtures as fx

# Texts that Spark and DuckDB read alike; // stands for whole division.
_RAW = {
    "genesis": "CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 2 % 4096 ELSE p_partkey % 8 * 2 + p_size % 8 * 32 END",
    "nes": "CASE WHEN p_partkey % 4 = 0 AND p_size % 2 = 0 THEN 15 ELSE p_size + p_partkey % 17 END",
    "snes": "p_partkey * 331 % 33000",
}


def _spark(sql: str) -> str:
    return sql.replace("//", "div")


def palette_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palettes of 16 entries, every fourth of 4, as raw values of three platforms."""
    p = fx.table(spark, sf_dir, "part").selectExpr("p_partkey div CASE WHEN p_partkey div 16 % 4 = 0 THEN 4 ELSE 16 END AS palette", "p_partkey div 16 % 4 = 0 AS few", "p_partkey", *[f"CAST({sql} AS INT) AS {name}" for name, sql in _RAW.items()])
    listed = [F.array_sort(F.collect_list(F.struct("p_partkey", name)))[name].alias(name) for name in _RAW]
    return p.groupBy("few", "palette").agg(*listed).select("few", "palette", *[ops.palette_errors(F.col(name), name).alias(name) for name in _RAW])


def palette_snap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per palette of 17: is it too large, is its first entry the key colour, which entries aren't levels of the hardware."""
    snapped = (F.col("r") == C.snap(F.col("r"))) & (F.col("g") == C.snap(F.col("g"))) & (F.col("b") == C.snap(F.col("b")))
    own = fx.colours(spark, sf_dir).select(F.floor(F.col("p_partkey") / 17).alias("palette"), (F.col("p_partkey") % 17).cast("int").alias("idx"), *[F.when(F.col("p_partkey") % 2 == 0, C.snap(F.col(c))).otherwise(F.col(c)).alias(c) for c in "rgb"])
    wrong = F.array_sort(F.array_compact(F.collect_list(F.when(~snapped, F.col("idx")))))
    first = F.max((F.col("idx") == 0) & (F.col("r") == 255) & (F.col("g") == 0) & (F.col("b") == 255))
    return own.groupBy("palette").agg((F.count(F.lit(1)) > 16).alias("large"), first.alias("keyed"), F.array_join(wrong.cast("array<string>"), ",").alias("wrong"))


_SHEET = {"width": "64 + o_orderkey % 300", "height": "8 + o_orderkey % 120", "mode": "CASE o_orderkey % 5 WHEN 0 THEN 'RGBA' WHEN 1 THEN 'P' WHEN 2 THEN 'L' ELSE 'RGB' END", "colours": "o_custkey % 24", "keyed": "o_orderkey % 7 <> 0", "w": "8 * (1 + o_custkey % 5)", "h": "8 * (1 + o_orderkey % 3)"}
_AUDIO = {"rate": "CASE o_orderkey % 4 WHEN 0 THEN 8000 WHEN 1 THEN 16000 WHEN 2 THEN 44100 ELSE 11000 + o_custkey % 12000 END", "channels": "1 + o_orderkey % 3", "depth": "8 * (1 + o_custkey % 5)", "frames": "o_orderkey * 37 % 400000"}
_MUSIC = {"version": "256 + o_orderkey % 128", "chips": "o_orderkey * 7 % 256", "size": "1000 + o_custkey * 13"}


def _orders(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{_spark(sql)} AS {name}" for name, sql in columns.items()])


def sheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assets.validated(_orders(spark, sf_dir, _SHEET), ops.sheet_rules(*[F.col(c) for c in _SHEET])).select("o_orderkey", "errors", "warnings", "valid")


def audio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets.validated(_orders(spark, sf_dir, _AUDIO), ops.audio_rules(*[F.col(c) for c in _AUDIO]))
    return rows.select("o_orderkey", "errors", "warnings", "valid", ops.nearest_rate(F.col("rate")).alias("to_rate"))


def chip_music_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assets.validated(_orders(spark, sf_dir, _MUSIC), ops.chip_music_rules(F.col("version"), F.col("chips")))
    return rows.select("o_orderkey", "errors", "valid", ops.packed_music_size(F.col("size"), F.col("chips")).alias("packed"))


_LEVEL = {"level": "c_custkey", "screens": "CAST(1 + c_custkey % 3 AS INTEGER)", "text": "CASE c_custkey % 5 WHEN 0 THEN 'Underground cave' WHEN 1 THEN 'A platform run' WHEN 2 THEN 'cave with spikes, PLATFORMS' WHEN 3 THEN 'hazards' ELSE 'a field' END"}


#: Levels whose cells one task makes.
LEVELS_A_TASK = 2048


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level a customer, dealt into a told number of parts before the cells are made: the levels alone fit in one task, their cells don't."""
    customers = fx.table(spark, sf_dir, "customer")
    return customers.selectExpr(*[f"{sql} AS {name}" for name, sql in _LEVEL.items()]).repartition(-(-customers.count() // LEVELS_A_TASK) or 1, "level")


def level_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each level's grid as text."""
    rows = ops.level_template(_levels(spark, sf_dir), "level", "screens", "text").groupBy("level", "y").agg(F.sort_array(F.collect_list(F.struct("x", "cell")))["cell"].alias("cells"))
    return rows.select("level", "y", F.array_join(F.col("cells").cast("array<string>"), "").alias("cells"))


def level_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels without some of their cells; starts and spawns follow from orders."""
    levels = _levels(spark, sf_dir)
    cells = ops.level_template(levels, "level", "screens", "text").filter("level % 11 <> 0 or x <> 3")
    starts = levels.selectExpr("level", "screens * 16 AS width", "15 AS height", "level * 29 % 240 AS x", "level * 31 % 240 AS y")
    spawns = fx.table(spark, sf_dir, "orders").selectExpr("o_custkey AS level", "o_orderkey % 800 - 20 AS x", "o_orderkey % 260 - 5 AS y")
    return ops.level_issues(starts, cells, spawns, "level")


def layer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir, {"layers": "1 + o_orderkey % 5", "colours": "o_custkey % 24", "rotates": "o_orderkey % 9 = 0", "complexity": "CASE o_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END", "sprites": "o_orderkey % 200"})
    return o.select("o_orderkey", ops.layer_mode(F.col("layers"), F.col("colours"), F.col("rotates")).alias("mode"), ops.suggested_tier(F.col("sprites"), F.col("complexity")).alias("tier"))


_OPCODES = ("lda", "sta", "adc", "inx", "jsr", "bne", "cpx", "asl", "bit", "beq", "nop", "ldx", "jmp", "rts", "rti", "pha", "pla", "php", "plp", "tax", "txs", "clc", "sei", "brk", "bmi", "bpl", "bvc", "bvs", "inc", "sty", "ror")
_OPERANDS = ("#$10", "$20", "$0200", "$20,x", "$0300,x", "temp", "label", "(ptr),y", "($10,x)", "200", "4000,y", "a", "", "(vector)")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of instructions."""
    pick = lambda names, sql: F.element_at(F.array(*map(F.lit, names)), (F.expr(sql) % len(names) + 1).cast("int"))
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("block"), pick(_OPCODES, "l_partkey + l_linenumber").alias("opcode"), pick(_OPERANDS, "l_suppkey * 3 + l_partkey").alias("operand"))


def addressing_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _code(spark, sf_dir).groupBy("opcode", "operand", ops.addressing_mode(F.col("operand")).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def block_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles = spark.createDataFrame([(o, m, n) for o, modes in ops.CYCLES.items() for m, n in modes.items()], "opcode string, mode string, cycles int")
    return ops.block_report(_code(spark, sf_dir).withColumn("block", F.floor(F.col("block") / 4)), ["block"], cycles)


_SOURCE = """CASE WHEN l_linenumber % 5 = 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN '.segment "ZEROPAGE"' ELSE '.segment "CODE"' END WHEN l_partkey % 2 = 0 THEN 'v' || CAST(l_partkey AS STRING) || ': .res ' || CAST(l_suppkey % 9 AS STRING) || ' ; kept' ELSE '  lda temp' END"""


def zero_page_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source lines by order; of several rows of one place the one of the smallest part counts."""
    lines = fx.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m")).selectExpr("l_orderkey", "l_linenumber", "m.l_partkey", "m.l_suppkey")
    return ops.zero_page_bytes(lines.selectExpr("l_orderkey", "l_linenumber", f"{_SOURCE} AS text"), "l_orderkey", "l_linenumber", "text")


QUERIES = {f.__name__: f for f in (palette_rules, palette_snap_check, sheet_rules, audio_rules, chip_music_rules, level_template, level_issues, layer_modes, addressing_modes, block_report, zero_page_bytes)}


# The instruction set by mode and cycles, for the SQL alone: a table of its own, so that a gap in the other one shows.
_BY_MODE = """imm 2: lda ldx ldy adc sbc cmp cpx cpy and ora eor
zp 3: lda ldx ldy sta stx sty adc sbc cmp cpx cpy and ora eor bit
zp 5: inc dec asl lsr rol ror
zpx 4: lda ldy sta sty adc sbc cmp and ora eor
zpx 6: inc dec asl lsr rol ror
zpy 4: ldx stx
abs 3: jmp
abs 4: lda ldx ldy sta stx sty adc sbc cmp cpx cpy and ora eor bit
abs 6: inc dec asl lsr rol ror jsr
absx 4: lda ldy adc sbc cmp and ora eor
absx 5: sta
absx 7: inc dec asl lsr rol ror
absy 4: lda ldx adc sbc cmp and ora eor
absy 5: sta
indx 6: lda sta adc sbc cmp and ora eor
indy 5: lda adc sbc cmp and ora eor
indy 6: sta
ind 5: jmp
acc 2: asl lsr rol ror
rel 2: bcc bcs beq bne bmi bpl bvc bvs
impl 2: inx iny dex dey tax tay txa tya tsx txs clc sec cli sei cld sed clv nop
impl 3: pha php
impl 4: pla plp
impl 6: rts rti
impl 7: brk"""
_CYCLES = ", ".join(f"('{o}', '{head.split()[0]}', {head.split()[1]})" for head, names in (line.split(": ") for line in _BY_MODE.splitlines()) for o in names.split())


def _bad(name: str, cond: str) -> str:
    return f"list_transform(list_filter(range(len(v)), lambda i: {cond.replace('@', 'v[i + 1]')}), lambda i: '{name}:' || i)"


def _palette(name: str) -> str:
    size = "CASE WHEN len(v) > 16 THEN ['size'] ELSE [] END"
    whole = {"genesis": size, "nes": "CASE WHEN len(v) <> 4 THEN ['size'] ELSE [] END || CASE WHEN v[1] <> 15 THEN ['first'] ELSE [] END", "snes": size}[name]
    each = {"genesis": [("range", "@ > 3822"), ("bits", "@ & 273 <> 0")], "nes": [("range", "@ < 0 OR @ > 63")], "snes": [("range", "@ > 32767")]}[name]
    return f"(SELECT array_to_string({whole} || {' || '.join(_bad(*e) for e in each)}, ',') FROM (SELECT v_{name} AS v))"


def _of(columns: dict[str, str]) -> str:
    return "SELECT o_orderkey, " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + " FROM orders"


def _said(rules: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules) + "], lambda t: t IS NOT NULL), ',')"


_GRID = f"""lv AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in _LEVEL.items())} FROM customer), xs AS (SELECT level, screens, lower(text) AS t, unnest(range(screens * 16)) AS x FROM lv), xy AS (SELECT *, unnest(range(15)) AS y FROM xs),
    grid AS (SELECT level, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(CASE WHEN (contains(t, 'hazard') OR contains(t, 'spike')) AND y = 12 AND x IN (6, 7) THEN 3 WHEN contains(t, 'platform') AND (y = 8 AND x BETWEEN 3 AND 5 OR y = 6 AND x BETWEEN 8 AND 10) THEN 2
        WHEN y >= 13 OR (contains(t, 'cave') OR contains(t, 'underground')) AND y < 2 THEN 1 ELSE 0 END AS INTEGER) AS cell FROM xy)"""
_LOW = "CASE WHEN regexp_full_match({0}, '[$][0-9a-f]+') THEN CAST(('0x' || substr({0}, 2)) AS BIGINT) < 256 WHEN regexp_full_match({0}, '[0-9]+') THEN CAST({0} AS BIGINT) < 256 ELSE regexp_matches({0}, 'temp|ptr|counter|index|frame|button') END"
_CODE = f"""code AS (SELECT l_orderkey AS block, [{", ".join(f"'{o}'" for o in _OPCODES)}][(l_partkey + l_linenumber) % {len(_OPCODES)} + 1] AS opcode, [{", ".join(f"'{o}'" for o in _OPERANDS)}][(l_suppkey * 3 + l_partkey) % {len(_OPERANDS)} + 1] AS operand FROM lineitem),
    forms AS (SELECT DISTINCT operand, lower(operand) AS o, CASE WHEN length(operand) > 2 THEN lower(operand)[:-3] ELSE '' END AS base FROM code),
    modes AS (SELECT operand, CASE WHEN o = '' THEN 'impl' WHEN o LIKE '#%' THEN 'imm' WHEN o LIKE '(%,x)' THEN 'indx' WHEN o LIKE '(%),y' THEN 'indy' WHEN o LIKE '(%)' THEN 'ind' WHEN o LIKE '%,x' THEN CASE WHEN {_LOW.format("base")} THEN 'zpx' ELSE 'absx' END
        WHEN o LIKE '%,y' THEN CASE WHEN {_LOW.format("base")} THEN 'zpy' ELSE 'absy' END WHEN o = 'a' THEN 'acc' WHEN {_LOW.format("o")} THEN 'zp' ELSE 'abs' END AS mode FROM forms)"""
_SNAP = "list_sort(list_transform([{1}], lambda v: {{'d': abs({0} - v), 'v': v}}))[1].v"

ORACLE_SQL = {
    "palette_rules": "WITH p AS (SELECT p_partkey // CASE WHEN p_partkey // 16 % 4 = 0 THEN 4 ELSE 16 END AS palette, p_partkey // 16 % 4 = 0 AS few, "
    + ", ".join(f"list(CAST({sql} AS INTEGER) ORDER BY p_partkey) AS v_{name}" for name, sql in _RAW.items())
    + " FROM part GROUP BY 1, 2) SELECT few, palette, "
    + ", ".join(f"{_palette(name)} AS {name}" for name in _RAW)
    + " FROM p",
    "palette_snap_check": f"""WITH {fx.COLOURS}, s AS (SELECT p_partkey, r, g, b, {", ".join(f"{_SNAP.format(c, ', '.join(map(str, C.LEVELS)))} AS s{c}" for c in "rgb")} FROM colours),
        o AS (SELECT p_partkey // 17 AS palette, CAST(p_partkey % 17 AS INTEGER) AS idx, p_partkey % 2 <> 0 AND (r <> sr OR g <> sg OR b <> sb) AS wrong, CASE WHEN p_partkey % 2 = 0 THEN sr ELSE r END AS r, CASE WHEN p_partkey % 2 = 0 THEN sg ELSE g END AS g, CASE WHEN p_partkey % 2 = 0 THEN sb ELSE b END AS b FROM s)
        SELECT palette, count(*) > 16 AS large, bool_or(idx = 0 AND r = 255 AND g = 0 AND b = 255) AS keyed, coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (wrong), '') AS wrong FROM o GROUP BY 1""",
    "sheet_rules": f"""WITH s AS ({_of(_SHEET)}), e AS (SELECT *, {_said([("width", "width < 128"), ("alpha", "mode = 'RGBA'"), ("colours", "mode = 'P' AND colours > 16"), ("frame_width", "w NOT IN (8, 16, 24, 32)"), ("frame_height", "h NOT IN (8, 16, 24, 32)")])} AS errors,
        {_said([("mode", "mode NOT IN ('RGBA', 'P', 'RGB')"), ("key", "mode = 'RGB' AND NOT keyed"), ("columns", "width % w <> 0"), ("rows", "height % h <> 0")])} AS warnings FROM s) SELECT o_orderkey, errors, warnings, errors = '' AS valid FROM e""",
    "audio_rules": f"""WITH s AS ({_of(_AUDIO)}), e AS (SELECT *, {_said([("channels", "channels > 2"), ("depth", "depth NOT IN (8, 16, 24, 32)")])} AS errors,
        {_said([("rate", f"rate NOT IN {ops.SAMPLE_RATES}"), ("stereo", "channels = 2"), ("depth", "depth IN (24, 32)"), ("long", "frames * 1000 // rate > 10000"), ("bank", "frames * 13400 // rate > 65536")])} AS warnings,
        list_sort(list_transform({list(ops.SAMPLE_RATES)}, lambda v: {{'d': abs(rate - v), 'v': v}}))[1].v AS to_rate FROM s) SELECT o_orderkey, errors, warnings, errors = '' AS valid, to_rate FROM e""",
    "chip_music_rules": f"""WITH s AS ({_of(_MUSIC)}), e AS (SELECT *, {_said([("version", "version < 336"), ("no_fm", "chips & 4 = 0"), ("YM2151", "chips & 8 <> 0"), ("YM2203", "chips & 32 <> 0"), ("YM2608", "chips & 64 <> 0"), ("YM2610", "chips & 128 <> 0")])} AS errors FROM s)
        SELECT o_orderkey, errors, errors = '' AS valid, CASE WHEN chips & 16 <> 0 THEN size * 7 // 10 * 12 // 10 ELSE size * 7 // 10 END AS packed FROM e""",
    "level_template": f"WITH {_GRID} SELECT level, y, string_agg(CAST(cell AS VARCHAR), '' ORDER BY x) AS cells FROM grid GROUP BY 1, 2",
    "level_issues": f"""WITH {_GRID}, st AS (SELECT level, screens * 16 AS width, level * 29 % 240 AS x, level * 31 % 240 AS y FROM lv), kept AS (SELECT * FROM grid WHERE level % 11 <> 0 OR x <> 3), n AS (SELECT level, count(*) AS cells FROM kept GROUP BY 1),
        stuck AS (SELECT DISTINCT st.level FROM st JOIN kept g ON g.level = st.level AND g.x = st.x // 16 AND g.y = st.y // 16 AND cell = 1),
        o AS (SELECT o_custkey AS level, o_orderkey % 800 - 20 AS x, o_orderkey % 260 - 5 AS y FROM orders), out AS (SELECT level, count(*) FILTER (o.x < 0 OR o.x >= width * 16) AS sx, count(*) FILTER (o.y < 0 OR o.y >= 240) AS sy FROM o JOIN st USING (level) GROUP BY 1)
        SELECT level, concat_ws(',', CASE WHEN coalesce(cells, 0) <> width * 15 THEN 'size' END, CASE WHEN s IS NOT NULL THEN 'start' END, CASE WHEN sx > 0 THEN 'x:' || sx END, CASE WHEN sy > 0 THEN 'y:' || sy END) AS issues
        FROM st LEFT JOIN n USING (level) LEFT JOIN (SELECT level, 1 AS s FROM stuck) USING (level) LEFT JOIN out USING (level)""",
    "layer_modes": """WITH o AS (SELECT o_orderkey, 1 + o_orderkey % 5 AS l, o_custkey % 24 AS c, o_custkey % 3 AS k, o_orderkey % 200 AS s FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 7 WHEN c > 16 THEN 3 WHEN l <= 2 THEN 1 WHEN l = 4 THEN 0 ELSE 1 END AS mode,
        CASE WHEN s <= 32 AND k < 2 THEN 'MINIMAL' WHEN s <= 128 THEN 'STANDARD' ELSE 'EXTENDED' END AS tier FROM o""",
    "addressing_modes": f"WITH {_CODE} SELECT opcode, operand, mode, count(*) AS n FROM code JOIN modes USING (operand) GROUP BY ALL",
    "block_report": f"""WITH {_CODE}, cycles(opcode, mode, cycles) AS (VALUES {_CYCLES}), least AS (SELECT opcode, min(cycles) AS least FROM cycles GROUP BY 1),
        r AS (SELECT block // 4 AS block, CAST(coalesce(sum(coalesce(cycles, least)), 0) AS BIGINT) AS cycles, count(*) FILTER (opcode LIKE 'b%' AND opcode NOT IN ('bit', 'brk')) AS branches, count(*) FILTER (opcode = 'jsr') AS calls
            FROM code JOIN modes USING (operand) LEFT JOIN cycles USING (opcode, mode) LEFT JOIN least USING (opcode) GROUP BY 1)
        SELECT *, {_said([("cycles", "cycles > 1000"), ("branches", "branches > 10"), ("calls", "calls > 5")])} AS issues FROM r""",
    "zero_page_bytes": f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1), t AS (SELECT l_orderkey, l_linenumber, lower({_SOURCE.replace("STRING", "VARCHAR")}) AS t FROM m),
        s AS (SELECT *, max(CASE WHEN contains(t, '.segment') THEN l_linenumber END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS at FROM t), z AS (SELECT s.*, contains(h.t, 'zeropage') AS inside FROM s LEFT JOIN t h ON h.l_orderkey = s.l_orderkey AND h.l_linenumber = s.at)
        SELECT l_orderkey, CAST(coalesce(sum(CAST(nullif(regexp_extract(t, '[.]res +([0-9]+)', 1), '') AS BIGINT)) FILTER (inside), 0) AS BIGINT) AS bytes FROM z GROUP BY 1""",
}
