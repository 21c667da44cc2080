"""Pixel tables (image, x, y, r, g, b, a): effects, outlines, seams and style measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C

RGB = ("r", "g", "b")


def _lerp(a: Column, b: Column, share: float) -> Column:
    """Between two whole values, towards zero."""
    return F.floor(a + (b - a) * share).cast("int")


def tint(pixels: DataFrame, colour: tuple[int, int, int], share: float) -> DataFrame:
    """Visible pixels drawn towards a colour; a share of 1 is a flash or a silhouette."""
    return pixels.withColumns({c: F.when(F.col("a") > 0, _lerp(F.col(c), F.lit(v), share)).otherwise(F.col(c)) for c, v in zip(RGB, colour, strict=True)})


def swapped(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Colours that ``palette`` (r, g, b, to_r, to_g, to_b) names, replaced."""
    j = pixels.join(palette, list(RGB), "left")
    return j.select(*[c for c in pixels.columns if c not in RGB], *[F.coalesce(f"to_{c}", c).alias(c) for c in RGB])


def outline(pixels: DataFrame, key: str, size: int = 1) -> DataFrame:
    """Places (key, x, y) outside the visible pixels within a disc of ``size`` of one: offsets of every visible pixel less the visible ones."""
    disc = [(dx, dy) for dx in range(-size, size + 1) for dy in range(-size, size + 1) if 0 < dx * dx + dy * dy <= size * size]
    seen = pixels.filter("a > 0").select(key, "x", "y")
    near = seen.select(key, F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in disc])).alias("p"))
    return near.select(key, "p.x", "p.y").distinct().join(seen, [key, "x", "y"], "left_anti")


def seam(pixels: DataFrame, key: str, width: int, blend: int) -> DataFrame:
    """The first ``blend`` columns drawn towards those at the right end, most at the edge, so that copies side by side meet."""
    right = pixels.filter(F.col("x") >= width - blend).select(key, (F.col("x") - (width - blend)).alias("x"), "y", *[F.col(c).alias(f"__{c}") for c in RGB])
    j = pixels.join(right, [key, "x", "y"], "left")
    share = 1 - F.col("x") / F.lit(float(blend))
    return j.select(*[c for c in pixels.columns if c not in RGB], *[F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(F.floor(F.col(c) + (F.col(f"__{c}") - F.col(c)) * share).cast("int")).alias(c) for c in RGB])


def style(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per image: distinct greys and the shading class that they tell (flat, simple, smooth, detailed), contrast, and mean saturation in thousandths."""
    grey = F.floor(C.luma(*[F.col(c) for c in RGB]) / 1000)
    p = pixels.withColumn("__g", grey).withColumn("__s", C.saturation(*[F.col(c) for c in RGB]))
    s = p.groupBy(*keys).agg(F.countDistinct("__g").alias("greys"), (F.max("__g") - F.min("__g")).alias("contrast"), F.floor(F.avg(F.floor(F.col("__s") * 1000))).alias("saturation"))
    n = F.col("greys")
    return s.withColumn("shading", F.when(n <= 4, "flat").when(n <= 8, "simple").when(n <= 16, "smooth").otherwise("detailed"))


def frame_banks(frames: DataFrame, keys: Sequence[str], frame: str, value: str, count: int) -> DataFrame:
    """Values of ``count`` banks per tile: tiles with fewer frames repeat their last one."""
    tiles = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(frame, value))).alias("__f"))
    banks = tiles.select(*keys, "__f", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bank"))
    return banks.select(*keys, "bank", F.get("__f", F.least(F.col("bank"), F.size("__f") - 1))[value].alias(value))


def mirrored_plan(own: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All eight directions of each group: own ones (direction, sheet), else the mirror image of a direction that is there (flipped), else none."""
    grid = own.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("direction"))
    source = own.select(*keys, F.pmod(4 - F.col("direction"), F.lit(8)).alias("direction"), F.col("sheet").alias("__mirror"))
    j = grid.join(own, [*keys, "direction"], "left").join(source, [*keys, "direction"], "left")
    return j.select(*keys, "direction", F.coalesce("sheet", "__mirror").alias("sheet"), (F.col("sheet").isNull() & F.col("__mirror").isNotNull()).alias("flipped"))
