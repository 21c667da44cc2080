"""Generated sources: headers, resource lists and JSON lines as rows (file, section, item, place, line), written by :func:`text.write_lines`.

A line is made from a row or a small group of rows (an animation, a machine), so files of any number are made side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("file", "section", "item", "place")


def _lines(df: DataFrame, file: Column, section: int, item: Column, place: Column, line: Column) -> DataFrame:
    return df.select(file.cast("string").alias("file"), F.lit(section).alias("section"), item.cast("string").alias("item"), place.cast("long").alias("place"), line.alias("line"))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def animation_header(frames: DataFrame) -> DataFrame:
    """Frames (sprite, anim, frame, index, ticks, loop) as declarations, frame tables and a count for each sprite."""
    name = F.lower(F.concat_ws("_", "sprite", "anim"))
    anims = frames.groupBy("sprite", "anim").agg(F.count(F.lit(1)).alias("n"), F.max("loop").alias("loop"))
    sprite = F.col("sprite")
    declared = [F.concat(F.lit("extern const AnimationFrame anim_"), name, F.lit("[];")), F.concat(F.lit("extern const Animation animation_"), name, F.lit(";"))]
    head = F.concat(F.lit("const AnimationFrame anim_"), name, F.lit("[] = {"))
    row = F.concat(F.lit("    { "), F.concat_ws(", ", F.col("index").cast("string"), F.col("ticks").cast("string"), F.lit("0"), F.lit("0")), F.lit(" },  // frame "), F.col("frame").cast("string"))
    tail = F.concat(F.lit("const Animation animation_"), name, F.lit(" = { anim_"), name, F.lit(", "), F.col("n").cast("string"), F.lit(", "), F.when(F.col("loop"), "TRUE").otherwise("FALSE"), F.lit(" };"))
    last = F.lit(1 << 40)
    count = anims.groupBy("sprite").agg(F.count(F.lit(1)).alias("n"))
    return _all([
        _lines(anims, sprite, 0, F.col("anim"), F.lit(0), declared[0]), _lines(anims, sprite, 0, F.col("anim"), F.lit(1), declared[1]),
        _lines(anims, sprite, 1, F.col("anim"), F.lit(-1), head), _lines(frames, sprite, 1, F.col("anim"), F.col("frame"), row), _lines(anims, sprite, 1, F.col("anim"), last, F.lit("};")), _lines(anims, sprite, 1, F.col("anim"), last + 1, tail),
        _lines(count, sprite, 2, F.lit(""), F.lit(0), F.concat(F.lit("#define "), F.upper("sprite"), F.lit("_ANIM_COUNT "), F.col("n").cast("string"))),
    ])


def machine_header(states: DataFrame, conditions: DataFrame) -> DataFrame:
    """States (fsm, state, ord) as numbered constants and their count, and the inputs that ``conditions`` (fsm, condition) name as bits, by name."""
    upper = lambda c: F.upper(F.regexp_replace(F.col(c).cast("string"), "[^A-Za-z0-9]", "_"))
    number = F.row_number().over(Window.partitionBy("fsm").orderBy("ord", "state")) - 1
    named = states.withColumn("k", number)
    flag = F.regexp_extract("condition", "^!?input_(.+)$", 1)
    flags = conditions.select("fsm", flag.alias("flag")).filter("flag <> ''").distinct()
    flags = flags.withColumn("k", F.row_number().over(Window.partitionBy("fsm").orderBy("flag")) - 1)
    count = states.groupBy("fsm").agg(F.count(F.lit(1)).alias("n"))
    return _all([
        _lines(named, F.col("fsm"), 0, F.lit(""), F.col("k"), F.concat(F.lit("    "), upper("fsm"), F.lit("_ANIM_"), upper("state"), F.lit(" = "), F.col("k").cast("string"), F.lit(","))),
        _lines(count, F.col("fsm"), 0, F.lit(""), F.col("n"), F.concat(F.lit("    "), upper("fsm"), F.lit("_ANIM_COUNT"))),
        _lines(flags, F.col("fsm"), 1, F.lit(""), F.col("k"), F.concat(F.lit("#define "), upper("fsm"), F.lit("_INPUT_"), upper("flag"), F.lit(" (1 << "), F.col("k").cast("string"), F.lit(")"))),
    ])


def sound_list(effects: DataFrame, folder: str = "converted") -> DataFrame:
    """Effects (file, name, ord, priority) as resource lines (section 0), numbered constants (1) and priorities (2)."""
    code = F.upper(F.regexp_replace("name", "[^A-Za-z0-9]", "_"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("ord")) - 1
    named = effects.withColumn("k", number)
    said = {
        0: F.concat(F.lit("WAV "), code, F.lit(f' "{folder}/'), F.col("name"), F.lit('.pcm" XGM')),
        1: F.concat(F.lit("    SFX_"), code, F.lit(" = "), F.col("k").cast("string"), F.lit(",")),
        2: F.concat(F.lit("    "), F.col("priority").cast("string"), F.lit(",  // "), code),
    }
    return _all([_lines(named, F.col("file"), section, F.lit(""), F.col("k"), line) for section, line in said.items()])


def collision_rows(cells: DataFrame, width: int) -> DataFrame:
    """Cells (map, x, y, code) as one line of codes for each row of ``width`` cells; cells that are not there are 0."""
    rows = cells.filter((F.col("x") >= 0) & (F.col("x") < width)).groupBy("map", "y").agg(F.map_from_entries(F.collect_list(F.struct(F.col("x").cast("int"), "code"))).alias("m"))
    codes = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.element_at("m", x), F.lit(0)).cast("string"))
    return _lines(rows, F.col("map"), 0, F.lit(""), F.col("y"), F.concat(F.lit("    "), F.array_join(codes, ", "), F.lit(",")))


def sheet_frames(frames: DataFrame) -> DataFrame:
    """Frames (sheet, ord, name, x, y, w, h) of a sheet's header, and as JSON objects (section 1)."""
    numbers = F.concat_ws(", ", *[F.col(c).cast("string") for c in ("x", "y", "w", "h")], F.lit("0"), F.lit("0"))
    c = _lines(frames, F.col("sheet"), 0, F.lit(""), F.col("ord"), F.concat(F.lit("    { "), numbers, F.lit(" },  // "), F.col("name")))
    return c.unionByName(_lines(frames, F.col("sheet"), 1, F.lit(""), F.col("ord"), F.to_json(F.struct("name", "x", "y", "w", "h"))))


def manifest_lines(variants: DataFrame, key: str) -> DataFrame:
    """Variants (key, platform, stage) as one JSON object an asset, platforms in order."""
    each = F.array_sort(F.collect_list(F.struct("platform", "stage")))
    said = F.transform(each, lambda v: F.concat(F.lit('"'), v["platform"], F.lit('":"'), v["stage"], F.lit('"')))
    assets = variants.groupBy(key).agg(F.array_join(said, ",").alias("v"))
    return _lines(assets, F.lit("manifest"), 0, F.lit(""), F.col(key), F.concat(F.lit('{"asset":'), F.col(key).cast("string"), F.lit(',"variants":{'), F.col("v"), F.lit("}}")))


def fan_out(assets: DataFrame, platforms: Sequence[tuple[str, int, int]]) -> DataFrame:
    """``assets`` (asset, tiles) for every platform (name, bits a pixel, most tiles): bytes, or an error for that platform alone."""
    kinds = F.array(*[F.struct(F.lit(n).alias("platform"), F.lit(b).alias("bits"), F.lit(m).alias("most")) for n, b, m in platforms])
    out = assets.select("asset", "tiles", F.explode(kinds).alias("p")).select("asset", "tiles", "p.*")
    fits = F.col("tiles") <= F.col("most")
    return out.select("asset", "platform", F.when(fits, F.col("tiles") * F.col("bits") * 8).alias("bytes"), F.when(~fits, F.concat(F.lit("too many tiles: "), F.col("tiles").cast("string"))).alias("error"))
