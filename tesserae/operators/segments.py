"""Segmentation of sheets: content, background, rows and columns of sprites, text regions, grid frames, strips and their loop seam.

Pixel tables have (key, x, y, r, g, b, a). Windows run inside one sheet's rows or columns only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def is_content(threshold: int = 30) -> Column:
    """Opaque for the greater part, and one channel brighter than ``threshold``."""
    return (F.col("a") >= 128) & (F.greatest(*RGB) > threshold)


def border_crop(pixels: DataFrame, width: int, height: int, rows: tuple[int, int] = (10, 90), columns: tuple[int, int] = (2, 98)) -> DataFrame:
    """Pixels between these percents of rows and columns, rounded down, the upper ends excluded; places count from the corner that is left."""
    (top, bottom), (left, right) = ([n * p // 100 for p in s] for n, s in ((height, rows), (width, columns)))
    kept = pixels.filter((F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right))
    return kept.withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def background(pixels: DataFrame, key: str, width: int, height: int, tolerance: int = 30) -> DataFrame:
    """(key, r, g, b) of every sheet: the most frequent of its four corners (the first in reading order of several), clear ones as black.

    Null where two or three corners are farther than ``tolerance`` from the first one, in all four channels together.
    """
    x, y = F.col("x"), F.col("y")
    corners = pixels.filter(x.isin(0, width - 1) & y.isin(0, height - 1))
    clear = F.col("a") == 0
    one = F.struct((F.when(y > 0, 2).otherwise(0) + F.when(x > 0, 1).otherwise(0)).alias("ord"), *[F.when(clear, 0).otherwise(F.col(c)).alias(c) for c in RGB], F.when(clear, 0).otherwise(255).alias("a"))
    four = corners.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("c"))
    apart = lambda s: sum((F.abs(s[c] - F.col("c")[0][c]) for c in (*RGB, "a")), F.lit(0))
    same = lambda s, t: (s["r"] == t["r"]) & (s["g"] == t["g"]) & (s["b"] == t["b"]) & (s["a"] == t["a"])
    votes = F.transform("c", lambda s: F.struct(F.size(F.filter("c", lambda t: same(s, t))).alias("votes"), (-s["ord"]).alias("ord"), s.alias("s")))
    odd = F.size(F.filter("c", lambda s: apart(s) > tolerance))
    return four.select(key, F.when(odd <= 1, F.array_max(votes)["s"]).alias("s")).select(key, *[f"s.{c}" for c in RGB])


def islands(points: DataFrame, keys: Sequence[str], pos: str, gap: int = 0) -> DataFrame:
    """(keys, start, end): runs of places that at most ``gap`` missing places interrupt."""
    w = Window.partitionBy(*keys).orderBy(pos)
    d = points.select(*keys, pos).distinct()
    d = d.withColumn("__new", F.coalesce(F.col(pos) - F.lag(pos).over(w) > gap + 1, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(w))
    return d.groupBy(*keys, "__run").agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("__run")


def _lines(mask: DataFrame, key: str) -> DataFrame:
    """(key, y, xs): the content of each row of a sheet, so that pixels are shuffled once."""
    return mask.groupBy(key, "y").agg(F.collect_set("x").alias("xs"))


def _columns(lines: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, top, bottom, x, first, last, above): for each column of a run of rows the first and last row with content, and the last above ``bottom`` (null for none). Runs meet rows by (key, y), merged: estimates are far too small for rows that come out of lists."""
    rows = runs.select(key, "top", "bottom", F.explode(F.sequence("top", "bottom")).alias("y"))
    inside = lines.join(rows.hint("merge"), [key, "y"]).select(key, "top", "bottom", "y", F.explode("xs").alias("x"))
    return inside.groupBy(key, "top", "bottom", "x").agg(F.min("y").alias("first"), F.max("y").alias("last"), F.max(F.when(F.col("y") < F.col("bottom"), F.col("y"))).alias("above"))


def _column_runs(columns: DataFrame, key: str, gap: int = 0) -> DataFrame:
    """``columns`` with start and end of their run of columns, which at most ``gap`` missing ones interrupt."""
    keys = [key, "top", "bottom"]
    w = Window.partitionBy(*keys).orderBy("x")
    marked = columns.withColumn("__new", F.coalesce(F.col("x") - F.lag("x").over(w) > gap + 1, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(w))
    run = Window.partitionBy(*keys, "__run")
    return marked.withColumns({"start": F.min("x").over(run), "end": F.max("x").over(run)}).drop("__new", "__run")


def _boxed(columns: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """(key, x, y, w, h): what the columns of a run span."""
    span = lambda a, b: F.max(b) - F.min(a) + 1
    return columns.groupBy(key, "top", "start").agg(F.min("x").alias("x"), F.min(low).alias("y"), span("x", "x").alias("w"), span(low, high).alias("h")).select(key, "x", "y", "w", "h")


def closed_boxes(mask: DataFrame, key: str, width: int, height: int, least: int = 4) -> DataFrame:
    """(key, x, y, w, h) of sprites: runs of rows with content, in them runs of columns, both over ``least`` long and neither at the far edge."""
    lines = _lines(mask, key)
    runs = islands(lines, [key], "y").filter((F.col("end") - F.col("start") >= least) & (F.col("end") < height - 1)).withColumnsRenamed({"start": "top", "end": "bottom"})
    columns = _column_runs(_columns(lines, runs, key), key)
    return _boxed(columns.filter((F.col("end") - F.col("start") >= least) & (F.col("end") < width - 1)), key, "first", "last")


def tolerant_boxes(mask: DataFrame, key: str, width: int, height: int, least: int = 16, row_gap: int = 15, column_gap: int = 12, step: int = 4) -> DataFrame:
    """(key, x, y, w, h) of sprites where small gaps don't part rows or columns; runs up to the far edge count.

    Rows are looked at in every ``step``-th column. A run that a gap ends excludes its last row and column, as does the box; boxes of one
    row or column are none.
    """
    lines = _lines(mask, key)
    rows = islands(lines.filter(F.exists("xs", lambda x: x % step == 0)), [key], "y", row_gap)
    trailing = F.col("end") + row_gap + 1 > height - 1
    rows = rows.select(key, F.col("start").alias("top"), F.when(trailing, height - 1).otherwise(F.col("end")).alias("bottom"), F.when(trailing, height - F.col("start")).otherwise(F.col("end") - F.col("start")).alias("size"))
    columns = _column_runs(_columns(lines, rows.filter(F.col("size") >= least), key), key, column_gap)
    stop = F.when(F.col("end") + column_gap + 1 > width - 1, F.col("end") + 1).otherwise(F.col("end"))
    kept = columns.filter((stop - F.col("start") >= least) & (F.col("x") < stop) & F.col("above").isNotNull())
    return _boxed(kept, key, "first", "above").filter("w > 1 and h > 1")


#: What makes a region look like a label, in whole numbers of w, h, y, n (content pixels) and height (of the sheet).
TEXT_RULES = {
    "wide_aspect": "2 * w > 7 * h and h < 50",
    "sparse_text_density": "100 * n < 15 * w * h and 2 * w > 5 * h",
    "edge_positioned_text": "h < 45 and w > 2 * h and (y < 60 or y > height - 80)",
    "very_short_label": "h < 20 and w > 40",
    "tiny_artifact": "w < 30 and h < 30",
    "short_wide_label": "h < 40 and 2 * w > 5 * h",
}


def text_regions(boxes: DataFrame, mask: DataFrame, key: str, height: int) -> DataFrame:
    """``boxes`` with n (content pixels inside) and reasons: the rules by which each is a text label, comma-joined; none for sprites."""
    rows = boxes.select("*", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("__y"))
    inside = rows.join(_lines(mask, key).withColumnRenamed("y", "__y").hint("merge"), [key, "__y"]).withColumn("n", F.size(F.filter("xs", lambda v: (v >= F.col("x")) & (v < F.col("x") + F.col("w")))))
    counted = boxes.join(inside.groupBy(key, "x", "y", "w", "h").agg(F.sum("n").alias("n")).hint("merge"), [key, "x", "y", "w", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("height", F.lit(height))
    reasons = F.array_compact(F.array(*[F.when(F.expr(rule), name) for name, rule in TEXT_RULES.items()]))
    return counted.select(key, "x", "y", "w", "h", "n", F.array_join(reasons, ",").alias("reasons"))


def grid_frames(pixels: DataFrame, key: str, width: int, height: int, w: int, h: int, margin: int = 0, padding: int = 0, least_alpha: int = 10) -> DataFrame:
    """(key, row, col, x, y, alpha, frame): cells of a grid whose alphas add up to ``least_alpha``; frames count the kept ones in reading order."""
    col, row = F.floor((F.col("x") - margin) / (w + padding)).cast("int"), F.floor((F.col("y") - margin) / (h + padding)).cast("int")
    cells = pixels.filter((F.col("x") >= margin) & (F.col("y") >= margin)).withColumns({"col": col, "row": row})
    cells = cells.withColumns({"x": F.col("x") - margin - F.col("col") * (w + padding), "y": F.col("y") - margin - F.col("row") * (h + padding)}).filter(f"x < {w} and y < {h}")
    cells = cells.filter((margin + F.col("col") * (w + padding) + w <= width - margin) & (margin + F.col("row") * (h + padding) + h <= height - margin))
    kept = cells.groupBy(key, "row", "col").agg(F.sum("a").alias("alpha")).filter(F.col("alpha") >= least_alpha)
    number = F.row_number().over(Window.partitionBy(key).orderBy("row", "col")) - 1
    return kept.select(key, "row", "col", (margin + F.col("col") * (w + padding)).alias("x"), (margin + F.col("row") * (h + padding)).alias("y"), "alpha", number.alias("frame"))


def crop_boxes(boxes: DataFrame, width: int, height: int, padding: int) -> DataFrame:
    """``boxes`` with the crop (left, top, right, bottom) that leaves ``padding`` around them inside the sheet."""
    return boxes.withColumns({
        "left": F.greatest(F.lit(0), F.col("x") - padding), "top": F.greatest(F.lit(0), F.col("y") - padding),
        "right": F.least(F.lit(width), F.col("x") + F.col("w") + padding), "bottom": F.least(F.lit(height), F.col("y") + F.col("h") + padding),
    })


def strip_frames(pixels: DataFrame, width: int, count: int) -> DataFrame:
    """``pixels`` with the frame of a strip of ``count`` equal frames and the column in it; columns that are left over go."""
    each = width // count
    return pixels.filter(F.col("x") < each * count).withColumn("frame", F.floor(F.col("x") / each).cast("int")).withColumn("x", F.col("x") % each)


def seamless_loop(frames: DataFrame, key: str, last: int, limit: int = 50, share: float = 0.3) -> DataFrame:
    """The ``last`` frame's pixels, drawn towards the first frame by ``share`` where the two differ by over ``limit`` on average.

    The two meet by grouping on their place, not by a join, whose side Spark would take for small and broadcast.
    """
    first, end = F.col("frame") == 0, F.col("frame") == last
    own = lambda where, prefix: [F.max(F.when(where, F.col(c))).alias(f"{prefix}{c}") for c in RGB]
    there = lambda where: F.max(F.when(where, 1))
    both = frames.filter(first | end).groupBy(key, "x", "y").agg(*own(end, ""), *own(first, "f"), (there(first) + there(end)).alias("both")).filter("both = 2").drop("both")
    apart = sum((F.abs(F.col(c) - F.col(f"f{c}")) for c in RGB), F.lit(0))
    image = Window.partitionBy(key)
    far = F.sum(apart).over(image) > limit * 3 * F.count(F.lit(1)).over(image)
    drawn = [F.when(F.col("blended"), F.floor(F.col(c) * F.lit(1 - share) + F.col(f"f{c}") * F.lit(share)).cast("int")).otherwise(F.col(c)).alias(c) for c in RGB]
    return both.withColumn("blended", far).select(key, "x", "y", *drawn, "blended")
