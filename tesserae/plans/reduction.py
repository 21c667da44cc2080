"""Sheets reduced to a budget of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reduction as ops
from .segments import SHEETS, H, W, sheets

BUDGET = 40
#: A number that tells an image's pixels and their places.
_TOLD = "aggregate(transform(px, (c, i) -> cast(c as bigint) % 1000003 * (i % 65521 + 1)), 0L, (a, v) -> (a + v) % 1000000007)"


def tile_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ops.reduced(ops.images_of(sheets(spark, sf_dir), "image", W), "image", W, H, BUDGET)
    return done.select("image", "before", "after", "steps", "fits", F.expr(_TOLD).alias("told"))


def tile_reduction_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step alone: distinct tiles modulo flips before and after a blur, and the pixels after it."""
    done = ops.reduced(ops.images_of(sheets(spark, sf_dir), "image", W), "image", W, H, 0, steps=("blur",))
    return done.select("image", "before", "after", F.expr(_TOLD).alias("told"))


QUERIES = {f.__name__: f for f in (tile_reduction, tile_reduction_step)}

_BITS = lambda c: f"(({c}) & {256 - (1 << 5)})"
_BLUR = lambda c: f"((coalesce(lag({c}) OVER w, {c}) + {c} * 6 + coalesce(lead({c}) OVER w, {c}) + 4) >> 3)"
_COUNT = f"""SELECT image, count(DISTINCT least(t, h, v, q)) AS n FROM (SELECT image, list(c ORDER BY y, x) AS t, list(c ORDER BY y, x DESC) AS h, list(c ORDER BY y DESC, x) AS v, list(c ORDER BY y DESC, x DESC) AS q FROM (SELECT *, r * 65536 + g * 256 + b AS c FROM %s) GROUP BY image, x // {ops.SIDE}, y // {ops.SIDE}) GROUP BY image"""

ORACLE_SQL = {
    "tile_reduction_step": f"""WITH {SHEETS}, p AS (SELECT image, x, y, {", ".join(f"{_BITS(c)} AS {c}" for c in "rgb")} FROM px),
        a AS (SELECT image, x, y, {", ".join(f"{_BLUR(c)} AS {c}" for c in "rgb")} FROM p WINDOW w AS (PARTITION BY image, y ORDER BY x)),
        d AS (SELECT image, x, y, {", ".join(f"{_BITS(_BLUR(c))} AS {c}" for c in "rgb")} FROM a WINDOW w AS (PARTITION BY image, x ORDER BY y)),
        b AS ({_COUNT % "p"}), f AS ({_COUNT % "d"}), s AS (SELECT image, CAST(sum(CAST(r * 65536 + g * 256 + b AS BIGINT) % 1000003 * ((y * {W} + x) % 65521 + 1)) % 1000000007 AS BIGINT) AS told FROM d GROUP BY image)
        SELECT image, CAST(b.n AS INTEGER) AS before, CAST(f.n AS INTEGER) AS after, told FROM b JOIN f USING (image) JOIN s USING (image)""",
}
