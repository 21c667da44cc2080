"""Map cells, the tileset that holds a cell's number (an as-of join), collision codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import tiles as T


def split(cells: DataFrame, raw: str = "raw") -> DataFrame:
    gid, h, v, d = T.split_cell(F.col(raw))
    return cells.withColumns({"gid": gid, "flip_h": h, "flip_v": v, "flip_d": d})


def with_ends(tilesets: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Tilesets with ``end``: the next set's first number, or null for the last."""
    order = Window.partitionBy(*scope).orderBy("first_gid") if scope else Window.orderBy("first_gid")
    return tilesets.withColumn("end", F.lead("first_gid").over(order))


def as_of(cells: DataFrame, tilesets: DataFrame, most: int = 100_000, block: int = 14) -> DataFrame:
    """``cells`` with the set (first_gid, tile_count) whose first number is the greatest not over ``gid``; null for none and for gid 0.

    An equality join on blocks of 2**block numbers, in each of which a set that reaches into it is listed, with the interval as residual.
    Up to ``most`` sets the listing is broadcast (sets and blocks bound its rows), beyond that both sides are shuffled by block.
    """
    last = F.coalesce(F.col("end") - 1, F.lit(T.CELL_MASK))
    listed = with_ends(tilesets).withColumn("__block", F.explode(F.sequence(F.shiftright("first_gid", block), F.shiftright(last, block))))
    if tilesets.limit(most + 1).count() <= most:
        listed = F.broadcast(listed)
    c = cells.withColumn("__block", F.shiftright("gid", block))
    on = (c["__block"] == listed["__block"]) & (F.col("gid") >= F.col("first_gid")) & (F.col("end").isNull() | (F.col("gid") < F.col("end"))) & (F.col("gid") > 0)
    return c.join(listed, on, "left").select(*cells.columns, "first_gid", "tile_count")


def collision(cells: DataFrame, properties: DataFrame, default: Column | None = None) -> DataFrame:
    """``cells`` of :func:`as_of` with ``code``: the tile's own property, else ``default`` or, by default, its number in the set where that is a code, else solid.

    Empty cells have no collision; cells of no set are solid (or ``default``).
    """
    local = F.col("gid") - F.col("first_gid")
    c = cells.withColumn("local_id", local)
    j = c.join(properties.withColumnRenamed("collision", "__own"), ["first_gid", "local_id"], "left")
    other = F.when(local < len(dims.COLLISIONS), local).otherwise(dims.SOLID) if default is None else default
    lost = F.lit(dims.SOLID) if default is None else default
    code = F.when(F.col("gid") == 0, 0).when(F.col("first_gid").isNull(), lost).otherwise(F.coalesce("__own", other)).cast("int")
    return j.withColumn("code", code).select(*c.columns, "code")


def contained(cells: DataFrame) -> DataFrame:
    """Of :func:`as_of`: whether the number lies inside the set's count."""
    return cells.withColumn("inside", F.coalesce((F.col("gid") >= F.col("first_gid")) & (F.col("gid") - F.col("first_gid") < F.col("tile_count")), F.lit(False)))


def validate(maps: DataFrame, most_cells: int = 512, most_tiles: int = 2047) -> DataFrame:
    """``maps`` (width, height, tiles, tile_width, tile_height) with ``problems``, comma-joined."""
    rules = F.array(F.when(F.greatest("width", "height") > most_cells, "size"), F.when(F.col("tiles") > most_tiles, "tiles"), F.when((F.col("tile_width") != 8) | (F.col("tile_height") != 8), "tile size"))
    return maps.withColumn("problems", F.array_join(F.array_compact(rules), ","))
