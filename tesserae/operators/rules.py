"""Rule tables over columns: palettes, sheets, audio, chip music, levels, prompts, tiers, assembly lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, str, Column]

# Widest palettes, the key colour, the least sheet width, valid frame sides, standard sample rates.
KEY_COLOUR = (255, 0, 255)
SHEET_WIDTH, FRAME_SIDES, SHEET_COLOURS = 128, (8, 16, 24, 32), 16
SAMPLE_RATES = (8000, 11025, 13400, 16000, 22050, 32000)
SAMPLE_RATE, BANK_BYTES = 13400, 65536
# Chips of a chip-music file as bits, the one that it must have and those that it must not have.
CHIPS = {"SN76489": 1, "YM2413": 2, "YM2612": 4, "YM2151": 8, "RF5C68": 16, "YM2203": 32, "YM2608": 64, "YM2610": 128}
NEEDED, BANNED = "YM2612", ("YM2151", "YM2203", "YM2608", "YM2610")
# Cells of a level's screen and their codes.
SCREEN_CELLS, CELL_PIXELS = (16, 15), 16
EMPTY, SOLID, PLATFORM, HAZARD = 0, 1, 2, 3


def palette_errors(values: Column, platform: str) -> Column:
    """Names of what is wrong with a palette of raw values (array of int), each followed by the entry's number if it is about one."""
    n = F.size(values)

    def each(name: str, bad) -> Column:  # noqa: ANN001
        places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(bad(F.get(values, i)), F.lit(False)))
        return F.transform(places, lambda i: F.concat(F.lit(f"{name}:"), i.cast("string")))

    whole = lambda name, bad: F.when(bad, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    found = {
        "genesis": lambda: [whole("size", n > 16), each("range", lambda v: v > 0xEEE), each("bits", lambda v: v.bitwiseAND(0x111) != 0)],
        "nes": lambda: [whole("size", n != 4), whole("first", F.coalesce(F.get(values, F.lit(0)) != 0x0F, F.lit(False))), each("range", lambda v: (v < 0) | (v > 0x3F))],
        "snes": lambda: [whole("size", n > 16), each("range", lambda v: v > 0x7FFF)],
    }[platform]()
    return F.array_join(F.concat(*found), ",")


def sheet_rules(width: Column, height: Column, mode: Column, colours: Column, keyed: Column, w: Column, h: Column) -> list[Rule]:
    """Before a sheet is compiled: width, mode, colours of indexed sheets, key colour of true-colour ones, frames of valid and dividing sides."""
    valid = lambda c: c.isin(*FRAME_SIDES)
    return [
        ("error", "width", width < SHEET_WIDTH), ("error", "alpha", mode == "RGBA"), ("error", "colours", (mode == "P") & (colours > SHEET_COLOURS)),
        ("error", "frame_width", ~valid(w)), ("error", "frame_height", ~valid(h)),
        ("warning", "mode", ~mode.isin("RGBA", "P", "RGB")), ("warning", "key", (mode == "RGB") & ~keyed), ("warning", "columns", width % w != 0), ("warning", "rows", height % h != 0),
    ]


def nearest_rate(rate: Column) -> Column:
    return F.array_min(F.array(*[F.struct(F.abs(rate - r).alias("d"), F.lit(r).alias("r")) for r in SAMPLE_RATES]))["r"]


def audio_rules(rate: Column, channels: Column, depth: Column, frames: Column) -> list[Rule]:
    """Duration in whole milliseconds, size after conversion to the standard rate, both rounded down."""
    return [
        ("error", "channels", channels > 2), ("error", "depth", ~depth.isin(8, 16, 24, 32)), ("warning", "rate", ~rate.isin(*SAMPLE_RATES)), ("warning", "stereo", channels == 2),
        ("warning", "depth", depth.isin(24, 32)), ("warning", "long", F.floor(frames * 1000 / rate) > 10_000), ("warning", "bank", F.floor(frames * F.lit(SAMPLE_RATE) / rate) > BANK_BYTES),
    ]


def chip_music_rules(version: Column, chips: Column) -> list[Rule]:
    """``version`` as in the header (0x150 and up), ``chips`` as bits."""
    has = lambda name: chips.bitwiseAND(CHIPS[name]) != 0
    return [("error", "version", version < 0x150), ("error", "no_fm", ~has(NEEDED)), *[("error", name, has(name)) for name in BANNED]]


def packed_music_size(size: Column, chips: Column) -> Column:
    """Seven tenths of the file, and a fifth more with samples; rounded down at each step."""
    base = F.floor(size * 7 / 10)
    return F.when(chips.bitwiseAND(CHIPS["RF5C68"]) != 0, F.floor(base * 12 / 10)).otherwise(base)


def level_template(levels: DataFrame, key: str, screens: str, text: str) -> DataFrame:
    """(key, x, y, cell): ground in the last two rows; a ceiling, platforms and hazards where words of ``text`` ask for them, which are looked for once a level."""
    across, down = SCREEN_CELLS
    said = lambda *words: F.lower(F.col(text)).rlike("|".join(words))
    asked = [said("hazard", "spike").alias("__hazard"), said("platform").alias("__platform"), said("cave", "underground").alias("__cave")]
    grid = levels.select(key, *asked, F.explode(F.sequence(F.lit(0), F.col(screens) * across - 1)).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"))
    x, y = F.col("x"), F.col("y")
    cell = (
        F.when(F.col("__hazard") & (y == down - 3) & x.isin(6, 7), HAZARD)
        .when(F.col("__platform") & (((y == 8) & x.between(3, 5)) | ((y == 6) & x.between(8, 10))), PLATFORM)
        .when((y >= down - 2) | (F.col("__cave") & (y < 2)), SOLID)
        .otherwise(EMPTY)
    )
    return grid.select(key, "x", "y", cell.alias("cell"))


def level_issues(levels: DataFrame, cells: DataFrame, spawns: DataFrame, key: str) -> DataFrame:
    """(key, issues): missing cells, a start (x, y in pixels) inside a solid cell, and how many spawns (x, y) lie outside; none is empty.

    ``levels`` has key, width and height (cells), x and y of the start. Joins are merged: Spark takes cells that come out of lists for few.
    """
    counted = cells.groupBy(key).agg(F.count(F.lit(1)).alias("cells"))
    at = levels.select(key, F.floor(F.col("x") / CELL_PIXELS).alias("x"), F.floor(F.col("y") / CELL_PIXELS).alias("y"))
    stuck = at.join(cells.filter(F.col("cell") == SOLID).hint("merge"), [key, "x", "y"], "left_semi").select(key, F.lit(True).alias("stuck"))
    size = levels.select(key, (F.col("width") * CELL_PIXELS).alias("w"), (F.col("height") * CELL_PIXELS).alias("h"))
    outside = spawns.join(size, key).groupBy(key).agg(F.sum(((F.col("x") < 0) | (F.col("x") >= F.col("w"))).cast("long")).alias("sx"), F.sum(((F.col("y") < 0) | (F.col("y") >= F.col("h"))).cast("long")).alias("sy"))
    j = levels.select(key, (F.col("width") * F.col("height")).alias("want")).join(counted.hint("merge"), key, "left").join(stuck.hint("merge"), key, "left").join(outside.hint("merge"), key, "left")
    said = [F.when(F.coalesce("cells", F.lit(0)) != F.col("want"), "size"), F.when(F.col("stuck"), "start")] + [F.when(F.col(c) > 0, F.concat(F.lit(f"{c[1]}:"), F.col(c).cast("string"))) for c in ("sx", "sy")]
    return j.select(key, F.array_join(F.array_compact(F.array(*said)), ",").alias("issues"))


def layer_mode(layers: Column, colours: Column, rotates: Column) -> Column:
    return F.when(rotates, 7).when(colours > 16, 3).when(layers <= 2, 1).when(layers == 4, 0).otherwise(1)


def suggested_tier(sprites: Column, complexity: Column) -> Column:
    return F.when((sprites <= 32) & complexity.isin("low", "medium"), "MINIMAL").when(sprites <= 128, "STANDARD").otherwise("EXTENDED")


# Cycles of an instruction by addressing mode, all 56 instructions.
_READ = {"imm": 2, "zp": 3, "zpx": 4, "abs": 4, "absx": 4, "absy": 4, "indx": 6, "indy": 5}
_SHIFT = {"acc": 2, "zp": 5, "zpx": 6, "abs": 6, "absx": 7}
_STEP = {"zp": 5, "zpx": 6, "abs": 6, "absx": 7}
CYCLES = {
    "lda": _READ, "ldx": {"imm": 2, "zp": 3, "zpy": 4, "abs": 4, "absy": 4}, "ldy": {"imm": 2, "zp": 3, "zpx": 4, "abs": 4, "absx": 4},
    "sta": {"zp": 3, "zpx": 4, "abs": 4, "absx": 5, "absy": 5, "indx": 6, "indy": 6}, "stx": {"zp": 3, "zpy": 4, "abs": 4}, "sty": {"zp": 3, "zpx": 4, "abs": 4},
    "adc": _READ, "sbc": _READ, "cmp": _READ, "cpx": {"imm": 2, "zp": 3, "abs": 4}, "cpy": {"imm": 2, "zp": 3, "abs": 4}, "inc": _STEP, "dec": _STEP,
    "inx": {"impl": 2}, "iny": {"impl": 2}, "dex": {"impl": 2}, "dey": {"impl": 2}, "and": _READ, "ora": _READ, "eor": _READ, "bit": {"zp": 3, "abs": 4},
    "asl": _SHIFT, "lsr": _SHIFT, "rol": _SHIFT, "ror": _SHIFT,
    "bcc": {"rel": 2}, "bcs": {"rel": 2}, "beq": {"rel": 2}, "bne": {"rel": 2}, "bmi": {"rel": 2}, "bpl": {"rel": 2}, "bvc": {"rel": 2}, "bvs": {"rel": 2},
    "jmp": {"abs": 3, "ind": 5}, "jsr": {"abs": 6}, "rts": {"impl": 6}, "rti": {"impl": 6}, "pha": {"impl": 3}, "pla": {"impl": 4}, "php": {"impl": 3}, "plp": {"impl": 4},
    "tax": {"impl": 2}, "tay": {"impl": 2}, "txa": {"impl": 2}, "tya": {"impl": 2}, "tsx": {"impl": 2}, "txs": {"impl": 2},
    "clc": {"impl": 2}, "sec": {"impl": 2}, "cli": {"impl": 2}, "sei": {"impl": 2}, "cld": {"impl": 2}, "sed": {"impl": 2}, "clv": {"impl": 2}, "nop": {"impl": 2}, "brk": {"impl": 7},
}
ZERO_PAGE_NAMES = ("temp", "ptr", "counter", "index", "frame", "button")


def addressing_mode(operand: Column) -> Column:
    """The mode that an operand's form tells; names of a few kinds, and numbers under 256, are taken to lie in the zero page."""
    o = F.lower(operand)

    def low(s: Column) -> Column:
        number = F.when(s.rlike("^[$][0-9a-f]+$"), F.conv(F.substring(s, 2, 16), 16, 10).cast("long")).when(s.rlike("^[0-9]+$"), s.cast("long"))
        return F.coalesce(number < 256, s.rlike("|".join(ZERO_PAGE_NAMES)))

    base = F.substring(o, F.lit(1), F.length(o) - 2)
    return (
        F.when(F.coalesce(o, F.lit("")) == "", "impl").when(o.startswith("#"), "imm").when(o.rlike(r"^\(.*,x\)$"), "indx").when(o.rlike(r"^\(.*\),y$"), "indy").when(o.rlike(r"^\(.*\)$"), "ind")
        .when(o.endswith(",x"), F.when(low(base), "zpx").otherwise("absx")).when(o.endswith(",y"), F.when(low(base), "zpy").otherwise("absy")).when(o == "a", "acc").when(low(o), "zp").otherwise("abs")
    )


def block_report(lines: DataFrame, keys: Sequence[str], cycles: DataFrame) -> DataFrame:
    """Per block of (keys, opcode, operand): cycles (the mode's, else the instruction's least), branches, calls, and the issues that they raise.

    ``cycles`` has opcode, mode, cycles; a small table of the instruction set.
    """
    least = cycles.groupBy("opcode").agg(F.min("cycles").alias("least"))
    seen = lines.withColumn("mode", addressing_mode(F.col("operand"))).join(F.broadcast(cycles), ["opcode", "mode"], "left").join(F.broadcast(least), "opcode", "left")
    branch = F.col("opcode").startswith("b") & ~F.col("opcode").isin("bit", "brk")
    r = seen.groupBy(*keys).agg(F.coalesce(F.sum(F.coalesce("cycles", "least")), F.lit(0)).alias("cycles"), F.sum(branch.cast("long")).alias("branches"), F.sum((F.col("opcode") == "jsr").cast("long")).alias("calls"))
    issues = [F.when(F.col("cycles") > 1000, "cycles"), F.when(F.col("branches") > 10, "branches"), F.when(F.col("calls") > 5, "calls")]
    return r.withColumn("issues", F.array_join(F.array_compact(F.array(*issues)), ","))


def zero_page_bytes(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, bytes): what ``.res`` reserves in zero-page segments of a source; the segment of a line is the last one named before or on it."""
    low = F.trim(F.lower(F.col(text)))
    named = F.when(low.contains('.segment "zeropage"'), True).when(low.contains(".segment"), False)
    inside = F.last(named, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    size = F.regexp_extract(low, r"\.res\s+([0-9]+)", 1)
    seen = lines.withColumns({"__in": F.coalesce(inside, F.lit(False)), "__n": F.when(size != "", size.cast("long")).otherwise(0)})
    return seen.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("__in"), F.col("__n"))), F.lit(0)).alias("bytes"))
