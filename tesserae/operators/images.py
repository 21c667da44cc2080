"""From images to tiles, maps and other sizes: tiles of an image, background maps, rotation, scaling, background removal, brightness and colour classes.

Pixel tables have (key, x, y, r, g, b, a); a tile is one array of 64 values, row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RGB = ("r", "g", "b")
SIDE = 8


def tiles_of(pixels: DataFrame, key: str, value: Column, width: int, height: int, pad: bool, blank: int = 0) -> DataFrame:
    """(key, tx, ty, px): tiles of an image. At the right and lower edge, partial ones are left out, or filled with ``blank`` where ``pad``."""
    seen = pixels if pad else pixels.filter((F.col("x") < width // SIDE * SIDE) & (F.col("y") < height // SIDE * SIDE))
    place = (F.col("y") % SIDE * SIDE + F.col("x") % SIDE).cast("int")
    tiles = seen.select(key, F.floor(F.col("x") / SIDE).cast("int").alias("tx"), F.floor(F.col("y") / SIDE).cast("int").alias("ty"), place.alias("place"), value.alias("value"))
    held = tiles.groupBy(key, "tx", "ty").agg(F.collect_list(F.struct("place", F.coalesce("value", F.lit(blank)).alias("value"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))
    rest = F.transform(F.array_except(every, F.col("m")["place"]), lambda i: F.struct(i.alias("place"), F.lit(blank).alias("value")))
    whole = F.when(F.size("m") == SIDE * SIDE, F.col("m")).otherwise(F.concat("m", rest))
    return held.select(key, "tx", "ty", F.sort_array(whole)["value"].alias("px"))


def background_map(tiles: DataFrame, key: str, columns: int, rows: int, most: int = 256) -> DataFrame:
    """(key, cell, tile): tile numbers of a screen of ``columns`` x ``rows`` cells, in the order of first use from 1.

    Cells outside of the image hold the blank tile. Numbers from ``most`` on don't fit: those cells show number 0.
    """
    look = F.md5(F.array_join(F.col("px").cast("array<string>"), ",")).alias("look")
    cell = F.when((F.col("tx") < columns) & (F.col("ty") < rows), F.struct((F.col("ty") * columns + F.col("tx")).cast("int").alias("cell"), look))
    held = tiles.groupBy(key).agg(F.collect_list(cell).alias("own"))  # a screen's cells at most, and all by image: no join
    blank = F.md5(F.lit(",".join(["0"] * SIDE * SIDE))).alias("look")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(columns * rows - 1)), F.col("own")["cell"]), lambda i: F.struct(i.alias("cell"), blank))
    seen = held.select(key, F.explode(F.concat("own", rest)).alias("c")).select(key, "c.cell", "c.look")
    first = seen.withColumn("first", F.min("cell").over(Window.partitionBy(key, "look")))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("first"))
    return first.select(key, "cell", F.when(number < most, number).otherwise(0).alias("tile"))


def rotated(px: Column, quarters: int, side: int = SIDE) -> Column:
    """A square of values turned clockwise by quarters: each place takes the value of the place that comes to it."""
    n, last = F.lit(side), side - 1
    x, y = (lambda i: F.pmod(i, n)), (lambda i: F.floor(i / side).cast("int"))
    source = {
        0: lambda i: i,
        1: lambda i: (last - x(i)) * side + y(i),
        2: lambda i: side * side - 1 - i,
        3: lambda i: x(i) * side + (last - y(i)),
    }[quarters % 4]
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.get(px, source(i)))


def rotations(tiles: DataFrame, keys: Sequence[str], px: str = "px") -> DataFrame:
    """(keys, angle, px): the four quarter turns of every tile."""
    turns = F.explode(F.array(*[F.struct(F.lit(90 * q).alias("angle"), rotated(F.col(px), q).alias("px")) for q in range(4)])).alias("t")
    return tiles.select(*keys, turns).select(*keys, "t.angle", "t.px")


def scaled(pixels: DataFrame, key: str, width: int, height: int, to_width: int, to_height: int, cover: bool = False) -> DataFrame:
    """The image in a box of another size, its sides in proportion, its middle in the middle, nearest pixels; the rest of the box is clear.

    It fits inside the box, or covers it where ``cover``. A broadcast table leads from pixels to the places that show them, so that only
    those are gathered by image, a box of them at most.
    """
    ratios = [(to_width, width), (to_height, height)]
    up, down = (max if cover else min)(ratios, key=lambda r: r[0] / r[1])
    w, h = max(1, width * up // down), max(1, height * up // down)
    left, top = (to_width - w) // 2, (to_height - h) // 2
    shown: dict[tuple[int, int], list[int]] = {}
    for y in range(max(0, top), min(to_height, top + h)):
        for x in range(max(0, left), min(to_width, left + w)):
            shown.setdefault(((2 * (x - left) + 1) * width // (2 * w), (2 * (y - top) + 1) * height // (2 * h)), []).append(y * to_width + x)
    places = pixels.sparkSession.createDataFrame([(*at, to) for at, to in shown.items()], "x int, y int, to array<int>")
    told = F.when(F.col("to").isNotNull(), F.struct("to", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*RGB, "a")]))
    held = pixels.join(F.broadcast(places), ["x", "y"], "left").groupBy(key).agg(F.collect_list(told).alias("own"))
    rest = F.array_except(F.sequence(F.lit(0), F.lit(to_width * to_height - 1)), F.flatten(F.col("own")["to"]))
    clear = F.struct(rest.alias("to"), *[F.lit(0).cast(pixels.schema[c].dataType).alias(c) for c in (*RGB, "a")])
    box = held.select(key, F.explode(F.concat("own", F.array(clear))).alias("p")).select(key, F.explode("p.to").alias("i"), *[f"p.{c}" for c in (*RGB, "a")])
    return box.select(key, (F.col("i") % to_width).cast("int").alias("x"), F.floor(F.col("i") / to_width).cast("int").alias("y"), *RGB, "a")


def _cleared(pixels: DataFrame, where: Column) -> DataFrame:
    return pixels.withColumns({c: F.when(where, 0).otherwise(F.col(c)) for c in (*RGB, "a")})


def without_colour(pixels: DataFrame, colour: tuple[int, int, int] = (0, 0, 0), tolerance: int = 30) -> DataFrame:
    """Pixels within ``tolerance`` of a colour, all channels together, made clear."""
    return _cleared(pixels, sum((F.abs(F.col(c) - v) for c, v in zip(RGB, colour, strict=True)), F.lit(0)) <= tolerance)


def without_dark(pixels: DataFrame, threshold: int = 50) -> DataFrame:
    """Pixels whose mean channel is at most ``threshold`` made clear."""
    return _cleared(pixels, F.col("r") + F.col("g") + F.col("b") <= 3 * threshold)


def keyed(pixels: DataFrame, colour: tuple[int, int, int] = (255, 0, 255), least: int = 128) -> DataFrame:
    """Opaque pixels in place of alpha: those under ``least`` take the key colour."""
    clear = F.col("a") < least
    return pixels.withColumns({c: F.when(clear, v).otherwise(F.col(c)) for c, v in zip(RGB, colour, strict=True)}).withColumn("a", F.lit(255))


def grey(r: Column, g: Column, b: Column) -> Column:
    """Weighted grey of 8 bits, rounded."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 0x8000, 16)


def tile_brightness(pixels: DataFrame, key: str, dark: int = 100) -> DataFrame:
    """(key, tx, ty, solid, bright, region) of every tile.

    solid: the mean grey is under ``dark``. bright: over six tenths of the pixels are opaque (alpha over 200) and brighter than 128; region
    says how much of the tile can be passed: full under three tenths of such pixels, partial under seven, else none.
    """
    tx, ty = (F.floor(F.col(c) / SIDE).cast("int") for c in "xy")
    lit = ((F.col("r") + F.col("g") + F.col("b") > 384) & (F.col("a") > 200)).cast("long")
    t = pixels.groupBy(key, tx.alias("tx"), ty.alias("ty")).agg(F.sum(grey(*map(F.col, RGB))).alias("grey"), F.sum(lit).alias("lit"), F.count(F.lit(1)).alias("n"))
    region = F.when(10 * F.col("lit") < 3 * F.col("n"), "full").when(10 * F.col("lit") < 7 * F.col("n"), "partial").otherwise("none")
    return t.select(key, "tx", "ty", (F.col("grey") < dark * F.col("n")).alias("solid"), (10 * F.col("lit") > 6 * F.col("n")).alias("bright"), region.alias("region"))


def two_colours(pixels: DataFrame, key: str) -> DataFrame:
    """``pixels`` with every tile in its two most frequent colours (of equal counts the larger r, g, b); others take the nearer one, the more frequent if equal."""
    at = {"tx": F.floor(F.col("x") / SIDE).cast("int"), "ty": F.floor(F.col("y") / SIDE).cast("int")}
    seen = pixels.withColumns(at)
    counts = seen.groupBy(key, "tx", "ty", *RGB).agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("x", "y")).alias("at"))
    tile = Window.partitionBy(key, "tx", "ty").orderBy(*[F.col(c).desc() for c in ("n", *RGB)]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = counts.withColumns({f"{c}{k}": F.nth_value(c, k).over(tile) for k in (1, 2) for c in RGB})
    apart = lambda k: sum(((F.col(c) - F.col(f"{c}{k}")) * (F.col(c) - F.col(f"{c}{k}")) for c in RGB), F.lit(0))
    second = F.coalesce(apart(2) < apart(1), F.lit(False))
    near = top.select(key, F.explode("at").alias("p"), *[F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in RGB])
    return near.select(key, "p.x", "p.y", *RGB)


def brightness_band(r: Column, g: Column, b: Column) -> Column:
    """0 to 3 by the mean channel, rounded down: under 32, 96, 192 and above."""
    mean = F.floor((r + g + b) / 3)
    return F.when(mean < 32, 0).when(mean < 96, 1).when(mean < 192, 2).otherwise(3)


def budget(tiles: Column, capacity: int, bits: int = 4, side: int = SIDE) -> Column:
    """struct(used, fits, most): bytes of so many tiles, whether ``capacity`` holds them, and how many it holds."""
    each = side * side * bits // 8
    return F.struct((tiles * each).alias("used"), (tiles * each <= capacity).alias("fits"), F.lit(capacity // each).alias("most"))


def hit_palette(palette: DataFrame, colour: tuple[int, int, int] = (238, 238, 238)) -> DataFrame:
    """(… idx, r, g, b): all but entry 0 in one colour, in the middles of eight steps a channel."""
    return palette.withColumns({c: F.when(F.col("idx") == 0, F.col(c)).otherwise(v // 32 * 32 + 16) for c, v in zip(RGB, colour, strict=True)})


def damage_palette(palette: DataFrame, colour: tuple[int, int, int] = (255, 0, 0), share: float = 0.3) -> DataFrame:
    """(… idx, r, g, b): all but entry 0 drawn towards a colour, rounded towards zero."""
    drawn = lambda c, v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(c) * F.lit(1 - share) + F.lit(v * share)).cast("int")))
    return palette.withColumns({c: F.when(F.col("idx") == 0, F.col(c)).otherwise(drawn(c, v)) for c, v in zip(RGB, colour, strict=True)})
