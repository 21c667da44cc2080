"""Deduplication of tiles, exact or modulo flips, and what follows from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles as T
from .ordering import numbered


def keyed(tiles: DataFrame, px: str = "px", flips: str = "hv", width: int = 8, size: int | None = None) -> DataFrame:
    """``tiles`` with key, key_h, key_v, key_hv (null where ``flips`` lacks them) and ck, the smallest of them: equal for tiles that flips make equal."""
    p = F.col(px)
    out = {"key": T.key(p), "key_h": T.key(T.flip_h(p, width, size)) if "h" in flips else None, "key_v": T.key(T.flip_v(p, width, size)) if "v" in flips else None, "key_hv": T.key(T.flip_hv(p)) if flips == "hv" else None}
    out = {k: F.lit(None).cast("string") if v is None else v for k, v in out.items()}
    return tiles.withColumns(out).withColumn("ck", F.least("key", F.coalesce("key_h", "key"), F.coalesce("key_v", "key"), F.coalesce("key_hv", "key")))


def _looks(tiles: DataFrame, px: str) -> DataFrame:
    """px and key of distinct tiles, the key made of these only."""
    return tiles.select(px).distinct().withColumn("key", T.key(F.col(px)))


def dedup(tiles: DataFrame, ordinal: Sequence[str], px: str = "px", flips: str = "hv", width: int = 8, size: int | None = None) -> DataFrame:
    """Per tile: the ordinal columns, key, ck, rep (the key of its class's first tile) and kind: unique, exact, h, v or hv.

    The first tile of a class in the order of (ordinal, key) represents it; another is of the first of exact, h, v, hv whose flip makes it
    the representative. Enabled flips form a group, so classes are what a greedy first-seen pass finds. Flips are made for distinct tiles
    only; tiles themselves travel as their ordinal and key, to the first of each key and back to the verdict on their key. A key that a
    large share of all tiles has is one row on the other side, which AQE broadcasts or splits. ``size``: how many pixels every tile has,
    if that is known.
    """
    tile = tiles.select(*ordinal, px, T.key(F.col(px)).alias("key"))
    return dedup_keyed(tile.drop(px), _looks(tiles, px), ordinal, px, flips, width, size)


def dedup_keyed(tile: DataFrame, looks: DataFrame, ordinal: Sequence[str], px: str = "px", flips: str = "hv", width: int = 8, size: int | None = None) -> DataFrame:
    """:func:`dedup` of tiles that are given as ``tile`` (the ordinal columns and key) and ``looks`` (px and key, a row for each key)."""
    classes = keyed(looks, px, flips, width, size).drop(px)
    seen = tile.groupBy("key").agg(F.min(F.struct(*ordinal)).alias("seen"))
    own = F.struct("seen", "key")
    first = classes.join(seen, "key").withColumn("first", F.min(own).over(Window.partitionBy("ck")))
    kind = F.when(F.col("key") == F.col("first.key"), "exact").when(F.col("key_h") == F.col("first.key"), "h").when(F.col("key_v") == F.col("first.key"), "v").otherwise("hv")
    verdict = first.select("key", "ck", F.col("first.key").alias("rep"), F.col("first.seen").alias("first"), kind.alias("kind"))
    joined = tile.join(verdict, "key")
    is_first = (F.struct(*ordinal) == F.col("first")) & (F.col("key") == F.col("rep"))
    return joined.select(*ordinal, "key", "ck", "rep", F.when(is_first, "unique").otherwise(F.col("kind")).alias("kind"))


def bank(deduped: DataFrame, ordinal: Sequence[str], block: Column) -> DataFrame:
    """The unique tiles: ck, the representative's ordinal, and tile_id in first-seen order."""
    return numbered(deduped.filter("kind = 'unique'").select("ck", *ordinal, "key"), "tile_id", block, [*ordinal, "key"]).drop("key")


def stats(deduped: DataFrame, bytes_per_tile: int = 256) -> DataFrame:
    """One row: tiles, unique ones and matches by kind, savings in per cent and bytes."""
    count = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    s = deduped.agg(F.count(F.lit(1)).alias("n_tiles"), *[F.coalesce(count(k), F.lit(0)).alias(f"n_{k}") for k in ("unique", "exact", "h", "v", "hv")])
    saved = F.when(F.col("n_tiles") > 0, F.floor((F.col("n_tiles") - F.col("n_unique")) * 10000 / F.col("n_tiles"))).otherwise(0)
    return s.withColumn("saved_bp", saved.cast("long")).withColumn("bytes", F.col("n_unique") * bytes_per_tile)


def name_table(deduped: DataFrame, bank_rows: DataFrame, ordinal: Sequence[str], palette: Column, priority: Column, base: int = 0) -> DataFrame:
    """Per tile its name-table word in hex, big-endian: number in the bank, flips, palette and priority."""
    j = deduped.join(bank_rows.select("ck", "tile_id"), "ck")
    h, v = F.col("kind").isin("h", "hv"), F.col("kind").isin("v", "hv")
    return j.select(*ordinal, "key", T.word_hex(T.name_word(F.col("tile_id") + base, h, v, palette, priority)).alias("word"))


def rebuild(deduped: DataFrame, tiles: DataFrame, ordinal: Sequence[str], convert: Column, px: str = "px", width: int = 8) -> DataFrame:
    """Tile-wise conversion: the ordinal columns, key, the new ``px`` and new_key, its key.

    ``convert`` (of ``px``), the flips of the result and their keys are made once for each unique tile; every tile takes what its class and kind name.
    """
    m = F.col("__made")
    unique = deduped.filter("kind = 'unique'").select("ck", "key").join(_looks(tiles, px), "key").select("ck", convert.alias("__made"))
    flips = F.create_map(*[x for k, v in (("unique", m), ("exact", m), ("h", T.flip_h(m, width)), ("v", T.flip_v(m, width)), ("hv", T.flip_hv(m))) for x in (F.lit(k), v)])
    made = unique.select("ck", F.explode(flips).alias("kind", px)).withColumn("new_key", T.key(F.col(px)))
    return deduped.join(made, ["ck", "kind"]).select(*ordinal, "key", px, "new_key")
