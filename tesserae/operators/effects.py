"""Outline classes, mirrored parts, raw colours; safety of paths, addresses and arguments; animations attached to sprites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import colour as C
from ..functions import tiles as T

RGB = ("r", "g", "b")


def outline_class(pixels: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, style, r, g, b): what the visible pixels of an image's edge tell, corners counting twice.

    black or coloured by the most frequent colour (of several the smallest), selective for over three colours unless that one is black,
    none without any.
    """
    edges = F.when(F.col("x").isin(0, width - 1), 1).otherwise(0) + F.when(F.col("y").isin(0, height - 1), 1).otherwise(0)
    seen = pixels.withColumn("n", edges).filter("n > 0 and a > 128").groupBy(key, *RGB).agg(F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), *RGB))
    found = seen.groupBy(key).agg(F.count(F.lit(1)).alias("colours"), best.alias("c"))
    j = pixels.select(key).distinct().join(found, key, "left")
    black = (F.col("c.r") == 0) & (F.col("c.g") == 0) & (F.col("c.b") == 0)
    style = F.when(F.col("c").isNull(), "none").when(black, "black").when(F.col("colours") > 3, "selective").otherwise("coloured")
    return j.select(key, style.alias("style"), *[F.col(f"c.{c}").alias(c) for c in RGB])


def mirrored_part(px: Column, side: int = 8) -> Column:
    """struct(symmetry, part, whole) of a square tile: the part that mirroring needs (a quarter, the left or the upper half, or all), and the tile made of it again."""
    kind = T.symmetry(px, size=side * side)
    half, places = side // 2, F.sequence(F.lit(0), F.lit(side * side - 1))
    x, y = (lambda i: F.pmod(i, F.lit(side))), (lambda i: F.floor(i / side).cast("int"))
    narrow, low = kind.isin("radial", "horizontal"), kind.isin("radial", "vertical")
    kept = F.filter(places, lambda i: (~narrow | (x(i) < half)) & (~low | (y(i) < half)))
    part = F.transform(kept, lambda i: F.get(px, i))
    wide = F.when(narrow, half).otherwise(side)
    near = lambda v, folded: F.when(folded & (v >= half), side - 1 - v).otherwise(v)
    whole = F.transform(places, lambda i: F.get(part, (near(y(i), low) * wide + near(x(i), narrow)).cast("int")))
    return F.struct(kind.alias("symmetry"), part.alias("part"), whole.alias("whole"))


def raw_colour(target: Column, r: Column, g: Column, b: Column) -> Column:
    """A colour as a platform's number: rgb24, genesis (9 bits), snes (15 bits), gameboy (four shades) or nes (the nearest of the fixed 64); null for others."""
    fixed = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(RGB, rgb, strict=True)], F.lit(k).alias("k")) for k, rgb in enumerate(dims.FIXED_64)])
    nearest = F.array_min(F.transform(fixed, lambda p: F.struct(C.distance([r, g, b], [p[c] for c in RGB], "rgb").alias("d"), p["k"].alias("k"))))["k"]
    return F.when(target == "rgb24", C.pack24(r, g, b)).when(target == "genesis", C.pack9(r, g, b)).when(target == "snes", C.pack15(r, g, b)).when(target == "gameboy", C.shade2(r, g, b)).when(target == "nes", nearest)


def safe_address(url: Column) -> Column:
    """Whether an address is http or https and doesn't name this host or a private network."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z]+://(?:[^/?#]*@)?([^/:?#]*)", 1))
    return url.rlike("^(?:http|https)://") & ~host.isin("localhost", "127.0.0.1", "0.0.0.0") & ~host.startswith("192.168.") & ~host.startswith("10.")


def safe_path(path: Column) -> Column:
    """Whether a path stays inside its folder: neither absolute nor climbing out at any point."""
    return ~path.rlike(r"^(?:[/\\]|[A-Za-z]:)") & ~path.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)") & ~path.contains("\x00")


def safe_argument(value: Column) -> Column:
    """Shell characters, leading dashes and white space at the ends gone."""
    return F.btrim(F.regexp_replace(F.regexp_replace(value, "[;|&$`<>()\n\r\t]", ""), "^-+", ""))


def attached(sprites: DataFrame, animations: DataFrame, name: str = "name") -> DataFrame:
    """Animations (name, anim, frames, loop, ticks) on the sprites (name) they name: (name, anims, known); ``known`` is false for names without a sprite."""
    listed = F.array_sort(F.collect_list(F.struct("anim", "frames", "loop", "ticks")))
    said = F.array_join(F.transform(listed, lambda a: F.concat_ws(":", a["anim"], a["frames"].cast("string"), a["loop"].cast("string"), a["ticks"].cast("string"))), ",")
    by_name = animations.groupBy(name).agg(said.alias("anims"))
    known = sprites.select(name, F.lit(True).alias("known")).distinct()
    j = known.join(by_name, name, "full_outer")
    return j.select(name, F.coalesce("anims", F.lit("")).alias("anims"), F.coalesce("known", F.lit(False)).alias("known"))


def small_enough(changes: DataFrame, size: str, megabytes: float) -> DataFrame:
    """Changes of files up to a size; those of unknown size go. For streams and tables."""
    return changes.filter(F.col(size) <= megabytes * 1024 * 1024)
