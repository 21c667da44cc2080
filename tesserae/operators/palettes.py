"""Palette operators: nearest entries, histograms, coverage, membership, ordered dithering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import BLACK, BLACKS, FIXED_64
from ..functions import colour as C

RGB = ("r", "g", "b")


#: Entries of a palette that goes to every executor.
MOST = 4096


def rgb(df_alias: str = "") -> list[Column]:
    return [F.col(f"{df_alias}{c}") for c in RGB]


def nearest_join(colours: DataFrame, palette: DataFrame, metric: str = "rgb", first_index: int = 0) -> DataFrame:
    """``colours`` with the nearest row of ``palette`` (idx, r, g, b) and its squared distance; the smallest idx on ties.

    A palette is small by its nature; it is gathered into one array and broadcast as one row, so that the search is a fold over that array
    and no pairs are made. One of over ``MOST`` entries is an error.
    """
    listed = F.array_sort(F.collect_list(F.struct("idx", *RGB)))
    entries = palette.filter(F.col("idx") >= first_index).limit(MOST + 1).agg(listed.alias("__palette"))
    entries = entries.select(F.when(F.size("__palette") <= MOST, F.col("__palette")).otherwise(F.raise_error(F.lit(f"a palette has {MOST} entries at most"))).alias("__palette"))
    joined = colours.crossJoin(F.broadcast(entries))  # one row
    best = F.array_min(F.transform("__palette", lambda p: F.struct(C.distance(rgb(), [p[c] for c in RGB], metric).alias("d"), p["idx"].alias("idx"))))
    return joined.withColumn("__best", best).select(*colours.columns, F.col("__best.idx").alias("idx"), F.col("__best.d").alias("distance"))


def top_colours(colours: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """The ``k`` most frequent colours of each group, the first seen on ties: keys, r, g, b, n, place."""
    counts = colours.groupBy(*keys, *RGB).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "__first")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("__first")


def weighted_top(colours: DataFrame, keys: Sequence[str], order: str, k: int = 20) -> DataFrame:
    """The heaviest colours after cutting channels to four bits; a pixel weighs 1 + 2 saturation, counted in thousandths and rounded down."""
    cut = colours.select(*keys, order, *[(F.floor(F.col(c) / 16) * 16).cast("int").alias(c) for c in RGB], F.floor(1000 + 2000 * C.saturation(*rgb())).cast("long").alias("w"))
    sums = cut.groupBy(*keys, *RGB).agg(F.sum("w").alias("weight"), F.min(order).alias("__first"))
    win = Window.partitionBy(*keys).orderBy(F.desc("weight"), "__first")
    return sums.withColumn("place", F.row_number().over(win)).filter(F.col("place") <= k).drop("__first")


def fixed_palette(top: DataFrame, keys: Sequence[str], size: int = 4) -> DataFrame:
    """Numbers of the fixed palette for each group of :func:`weighted_top`: idx, score, brightness, band and pick.

    Each colour goes to its nearest number (all blacks are one), scores are summed. Bands: under 60 dark, under 160 middle, else bright.
    Picks in order: the best dark one (or black), up to two middle ones, the best bright one, then the rest by score.
    """
    near = C.nearest(rgb(), FIXED_64)["i"]
    idx = F.when(near.isin(*BLACKS), BLACK).otherwise(near)
    scored = top.withColumn("idx", idx).groupBy(*keys, "idx").agg(F.sum("weight").alias("score"), F.min("place").alias("__seen"))
    channel = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in FIXED_64]), F.col("idx") + 1)
    bright = F.floor(C.luma(channel(0), channel(1), channel(2)) / 1000)
    scored = scored.withColumn("brightness", bright).withColumn("band", F.when(bright < 60, "dark").when(bright < 160, "middle").otherwise("bright"))
    in_band = F.row_number().over(Window.partitionBy(*keys, "band").orderBy(F.desc("score"), "__seen"))
    wave = F.when((F.col("band") == "dark") & (F.col("__rank") == 1), 0).when((F.col("band") == "middle") & (F.col("__rank") <= 2), 1).when((F.col("band") == "bright") & (F.col("__rank") == 1), 2).otherwise(3)
    picked = scored.withColumn("__rank", in_band).withColumn("__wave", wave)
    pick = F.row_number().over(Window.partitionBy(*keys).orderBy("__wave", F.desc("score"), "__seen"))
    return picked.withColumn("pick", pick).filter(F.col("pick") <= size).select(*keys, "idx", "score", "brightness", "band", "pick")


def coverage(colours: DataFrame, palette: Sequence[tuple[int, int, int]], keys: Sequence[str], limit: int = 2000) -> DataFrame:
    """Per group: pixels, those within the squared distance ``limit`` of the palette, and the sum of squared distances."""
    d = C.nearest(rgb(), palette)["d"]
    return colours.withColumn("__d", d).groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), F.sum((F.col("__d") < limit).cast("long")).alias("matched"), F.sum(F.col("__d").cast("long")).alias("error"))


def members(colours: DataFrame, allowed: DataFrame, keep: bool = True) -> DataFrame:
    """Colours that ``allowed`` (r, g, b) has, or lacks."""
    return colours.join(allowed.select(*RGB).distinct(), list(RGB), "left_semi" if keep else "left_anti")


def snapped(top: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Colours of :func:`top_colours` at the eight hardware levels; those that fall together keep their best place."""
    s = top.select(*keys, *[C.snap(F.col(c)).alias(c) for c in RGB], "n", "place")
    return s.groupBy(*keys, *RGB).agg(F.min("place").alias("place"), F.sum("n").alias("n"))


def bayer(size: int) -> list[list[int]]:
    """The ordered-dither matrix of 2, 4 or 8, by doubling."""
    m = [[0, 2], [3, 1]]
    while len(m) < size:
        m = [[4 * v + add for v, add in [(v, a) for a in pair for v in row]] for pair in ((0, 2), (3, 1)) for row in m]
    return m


def ordered_dither(pixels: DataFrame, palette: Sequence[tuple[int, int, int]], size: int = 4, x: str = "x", y: str = "y", spread: float | None = None, alpha: str | None = None) -> DataFrame:
    """``pixels`` with ``idx``: the nearest entry after adding (matrix - 1/2) * ``spread``, clamped; by default the spread is 255 / (entries - 1).

    With ``alpha``, pixels of less than 128 are entry 0.
    """
    flat = [v / size**2 for row in bayer(size) for v in row]
    spread = 255.0 / max(1, len(palette) - 1) if spread is None else spread
    at = (F.col(y) % size * size + F.col(x) % size + 1).cast("int")
    threshold = F.element_at(F.array(*[F.lit((v - 0.5) * spread) for v in flat]), at)
    # Columns of their own: every entry's distance reads them twice, and written out there they make code that is too long to be compiled.
    moved = pixels.withColumn("__threshold", threshold).withColumns({f"__{c}": F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c) + F.col("__threshold"))) for c in RGB})
    near = moved.withColumn("__near", C.nearest([F.col(f"__{c}") for c in RGB], palette)["i"])
    idx = F.col("__near") if alpha is None else F.when(F.col(alpha) < 128, F.lit(0)).otherwise(F.col("__near"))
    return near.select(*pixels.columns, idx.alias("idx"))


def key_quantised(colours: DataFrame, key: str, order: str, keyed: tuple[int, int, int], size: int = 16) -> DataFrame:
    """(key, r, g, b, n, idx): distinct colours of each image with their place in a palette of ``size``: the most frequent colours, the first seen on ties; others take the nearest.

    Where an image has the colour ``keyed`` (what is transparent), that is place 0 and no other colour takes it.
    """
    counts = colours.groupBy(key, *RGB).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    is_key = (F.col("r") == keyed[0]) & (F.col("g") == keyed[1]) & (F.col("b") == keyed[2])
    marked = counts.withColumns({"is_key": is_key, "has": F.max(is_key.cast("int")).over(Window.partitionBy(key))})
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    ranked = marked.filter(~F.col("is_key")).withColumn("place", place).filter(F.col("place") <= size - F.col("has"))
    palettes = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col("place") - 1 + F.col("has")).alias("idx"), *RGB))).alias("palette"))  # ``size`` entries at most
    best = F.array_min(F.transform("palette", lambda p: F.struct(C.distance(rgb(), [p[c] for c in RGB]).alias("d"), p["idx"].alias("idx"))))["idx"]
    return marked.join(palettes, key, "left").select(key, *RGB, "n", F.when(F.col("is_key"), F.lit(0)).otherwise(best).alias("idx"))


def hardware_mapped(near: DataFrame, palette: DataFrame, key: str, hardware: Sequence[tuple[int, int, int]], metric: str = "rgb") -> DataFrame:
    """``near`` (key, r, g, b, idx) with hw: colours through their image's palette (key, idx, r, g, b) to the hardware entry that is nearest to the palette's, so that equal indexes stay equal."""
    entry = palette.select(key, "idx", C.nearest(rgb(), hardware, metric)["i"].alias("hw"))
    return near.join(entry, [key, "idx"]).select(key, *RGB, "idx", "hw")
