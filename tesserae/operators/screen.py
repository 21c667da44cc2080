"""Scanline load by running sums, transfer budgets, overlay classes and hints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def scanline_load(sprites: DataFrame, keys: Sequence[str], height: int = dims.SCREEN_LINES) -> DataFrame:
    """Per group and scanline: sprites on it and their widths' sum.

    A sprite covers the lines [y, y + h) inside [0, height). It sends what begins at its first line and what ends after its last one; running
    sums over a group's lines, ``height`` + 1 at most, give the loads, and lines are written out only behind the shuffles. What follows by
    ``keys`` finds the groups together.
    """
    top, end = F.greatest(F.lit(0), F.col("y")), F.least(F.lit(height), F.col("y") + F.col("h"))
    at = lambda line, sign: F.struct(line.alias("line"), F.lit(sign).alias("sign"))
    ends = sprites.filter(top < end).select(*keys, "w", F.explode(F.array(at(top, 1), at(end, -1))).alias("at")).select(*keys, F.col("at.line").alias("scanline"), F.col("at.sign").alias("sign"), "w")
    wide = F.col("w").isNotNull().cast("int")
    steps = ends.groupBy(*keys, "scanline").agg(F.sum("sign").alias("sprites"), F.sum(F.col("sign") * wide).alias("wide"), F.coalesce(F.sum(F.col("sign") * F.col("w")), F.lit(0)).alias("pixels"))
    line = Window.partitionBy(*keys).orderBy("scanline")
    runs = steps.select(*keys, "scanline", *[F.sum(c).over(line).alias(c) for c in ("sprites", "wide", "pixels")], F.lead("scanline").over(line).alias("next")).filter("sprites > 0")
    return runs.select(*keys, F.explode(F.sequence("scanline", F.col("next") - 1)).alias("scanline"), "sprites", F.when(F.col("wide") > 0, F.col("pixels")).alias("pixels"))


def violations(load: DataFrame, per_line: int = dims.PER_LINE, pixels: int = dims.LINE_PIXELS) -> DataFrame:
    """Lines over a limit: how many sprites are lost, and whether the widths are too many."""
    over = F.greatest(F.col("sprites") - per_line, F.lit(0).cast("long"))
    return load.withColumn("lost", over).withColumn("too_wide", F.col("pixels") > pixels).filter("lost > 0 or too_wide")


def overlay_class(load: DataFrame, groups: DataFrame, key: str, height: int = dims.SCREEN_LINES) -> DataFrame:
    """Every line of every group with a class from 0 (empty) to 4 (20 sprites or more). A group's lines meet it as one list, and are written out last."""
    lines = load.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("scanline", "sprites"))).alias("lines"))
    full = groups.select(key).distinct().join(lines.hint("merge"), key, "left").select(key, "lines", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("scanline"))
    n = F.coalesce(F.try_element_at("lines", F.col("scanline")), F.lit(0))
    return full.select(key, "scanline", n.alias("n")).select(key, "scanline", F.when(F.col("n") == 0, 0).when(F.col("n") <= 10, 1).when(F.col("n") <= 15, 2).when(F.col("n") < dims.PER_LINE, 3).otherwise(4).alias("heat"))


def worst_line(load: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The line with the most sprites of each group, the uppermost on ties."""
    return load.groupBy(*keys).agg(F.max(F.struct("sprites", (-F.col("scanline")).alias("up"))).alias("m")).select(*keys, (-F.col("m.up")).alias("scanline"), F.col("m.sprites").alias("sprites"))


def transfer(tiles: DataFrame, keys: Sequence[str], bytes_col: str) -> DataFrame:
    """Per group: bytes, tenths of lines of a transfer, per mille of the blank, and whether it fits, is near the end (75 %) or not."""
    total = tiles.groupBy(*keys).agg(F.sum(bytes_col).alias("bytes"))
    lines = F.col("bytes") / dims.DMA_LINE
    verdict = F.when(lines > dims.BLANK_LINES, "over").when(lines > dims.BLANK_LINES * 0.75, "near").otherwise("fits")
    return total.select(*keys, "bytes", F.floor(lines * 10).alias("tenths"), F.floor(lines * 1000 / dims.BLANK_LINES).alias("per_mille"), verdict.alias("verdict"))


def hints(load: DataFrame, sprites: DataFrame, key: str) -> DataFrame:
    """Per group: counts of bad lines and wide ones, and the hints that they call for."""
    lines = load.groupBy(key).agg(F.sum((F.col("sprites") > dims.PER_LINE).cast("long")).alias("bad"), F.sum((F.col("pixels") > dims.LINE_PIXELS).cast("long")).alias("wide"), F.max("sprites").alias("most"))
    total = sprites.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    j = total.join(lines, key, "left").fillna(0, ["bad", "wide", "most"])
    over = F.col("most") - dims.PER_LINE
    found = F.array_compact(
        F.array(
            F.when(F.col("bad") > 0, "stagger"), F.when(over > 5, "combine"), F.when(F.col("bad") > 10, "redesign"),
            F.when(F.col("total") > dims.PER_SCREEN * 0.8, "background"), F.when(F.col("wide") > 0, "narrow"), F.when((F.col("bad") > 0) | (F.col("total") > dims.PER_SCREEN), "multiplex"),
        )
    )
    return j.select(key, "total", "bad", "wide", "most", F.array_join(found, ",").alias("hints"))
