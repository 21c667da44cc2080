"""Manifests, validation, metrics and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def usage(variants: DataFrame) -> DataFrame:
    """Per platform: assets, tiles, palettes in use, and the limits of its tier."""
    spec = lambda k: dims.lookup(F.col("tier"), {t[0]: t[k] for t in dims.TIERS}, 0)
    used = variants.groupBy("platform").agg(F.count(F.lit(1)).alias("assets"), F.sum("tiles").alias("tiles"), F.countDistinct("palette").alias("palettes"))
    used = used.withColumn("tier", dims.tier(F.col("platform")))
    return used.withColumn("tiles_ok", F.col("tiles") <= spec(5)).withColumn("palettes_ok", F.col("palettes") <= spec(3))


def palette_users(variants: DataFrame) -> DataFrame:
    """Per platform and palette: how many assets use it, and the first of them."""
    return variants.groupBy("platform", "palette").agg(F.count(F.lit(1)).alias("assets"), F.min("asset").alias("first"))


def unfinished(variants: DataFrame, done: str) -> DataFrame:
    """Variants that aren't at their last stage."""
    return variants.filter(F.col("stage") != done)


def changed(now: DataFrame, before: DataFrame, key: str, hash_col: str = "hash") -> DataFrame:
    """Rows of ``now`` that are new or whose hash differs, with why."""
    j = now.join(before.select(key, F.col(hash_col).alias("__old")), key, "left")
    why = F.when(F.col("__old").isNull(), "new").when(~F.col("__old").eqNullSafe(F.col(hash_col)), "changed")
    return j.withColumn("why", why).filter("why is not null").drop("__old")


def validated(rows: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """``rows`` with errors and warnings (comma-joined names) and valid; a rule is (``error`` or ``warning``, name, failing condition). A null condition doesn't fail."""
    of = lambda kind: F.array_join(F.array_compact(F.array(*[F.when(c, n) for k, n, c in rules if k == kind], F.lit(None).cast("string"))), ",")
    return rows.withColumn("errors", of("error")).withColumn("warnings", of("warning")).withColumn("valid", F.col("errors") == "")


def limit_rules(used: Column, limit: Column, name: str) -> list[tuple[str, str, Column]]:
    """Over the limit is an error, over nine tenths of it a warning."""
    return [("error", name, used > limit), ("warning", name, (used <= limit) & (used * 10 > limit * 9))]


def summary(metrics: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, least, most and sum of the values that are numbers."""
    v = F.expr(f"try_cast({value} as double)")
    return metrics.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v).alias("total"))


def ledger(costs: DataFrame, keys: Sequence[str], order: Sequence[str], budget: float) -> DataFrame:
    """Each cost with the sum spent so far in its group, what is left, and whether it is still inside the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("spent", F.sum("cost").over(w)).withColumn("left", F.lit(budget).cast("decimal(38,6)") - F.col("spent")).withColumn("inside", F.col("left") >= 0)


def status_counts(rows: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Counts and sums by all levels, by each prefix of them, and in all; missing levels are null (an extension: a rollup)."""
    return rows.rollup(*levels).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def prefix_offsets(sheets: DataFrame, keys: Sequence[str], order: Sequence[str], size: str) -> DataFrame:
    """Each row's first place: the sizes of all before it in its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sheets.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def duplicate_names(rows: DataFrame, key: str, clean: Column) -> DataFrame:
    """Rows whose cleaned names meet others of their group."""
    n = rows.withColumn("clean", clean)
    return n.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key, "clean"))).filter("__n > 1").drop("__n")


def sheet_layout(frames: DataFrame, keys: Sequence[str], order: Sequence[str], columns: int, valid: tuple[int, ...]) -> DataFrame:
    """Uniform cells of the smallest valid size that holds every frame: row and column, cell size, and where a frame lies centred."""
    from ..functions.geometry import to_valid

    w = Window.partitionBy(*keys)
    cell_w, cell_h = to_valid(F.max("w").over(w), valid), to_valid(F.max("h").over(w), valid)
    f = frames.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("cell_w", cell_w).withColumn("cell_h", cell_h)
    at = lambda index, cell, size: (F.floor(index) * F.col(cell) + F.floor((F.col(cell) - F.col(size)) / 2)).cast("long")
    return f.withColumn("x", at(F.col("i") % columns, "cell_w", "w")).withColumn("y", at(F.col("i") / columns, "cell_h", "h"))


def first_labels(items: DataFrame, labels: DataFrame, key: str, order: str) -> DataFrame:
    """Items with the first label of their key; items without one and empty descriptions keep ``unknown``."""
    first = labels.groupBy(key).agg(F.min_by(F.struct("type", "description"), order).alias("__l"))
    j = items.join(first, key, "left")
    return j.withColumn("type", F.coalesce("__l.type", F.lit("unknown"))).withColumn("description", F.coalesce(F.nullif(F.col("__l.description"), F.lit("")), F.lit("unknown"))).drop("__l")


def classify(sprites: DataFrame, height: int) -> DataFrame:
    """A sprite's size class, place on the screen, type and action from its box alone."""
    size = dims.band(F.greatest("w", "h"), dims.SIZES, "medium")
    place = dims.band((F.col("y") + F.col("h") / 2) / height, dims.HEIGHTS, "middle")
    s = sprites.withColumn("size", size).withColumn("place", place)
    kind = F.when(F.col("size") == "tiny", "projectile").when(F.col("size") == "small", "item").when(F.col("size").isin("large", "huge"), "boss").when(F.col("place") == "top", "ui").when(F.col("place") == "bottom", "item").otherwise("character")
    aspect = F.when(F.col("h") > 0, F.col("w") / F.col("h")).otherwise(1.0)
    return s.withColumn("type", kind).withColumn("action", F.when(aspect > 1.3, "run").when(aspect < 0.7, "jump").when(F.col("size") == "tiny", "fly").otherwise("idle"))


def highest_tier(assets: DataFrame, platforms: str) -> DataFrame:
    """Assets with the highest tier among their platforms (an array); the middle one for none."""
    tiers = F.transform(F.col(platforms), dims.tier)
    return assets.withColumn("tier", F.coalesce(F.array_max(tiers), F.lit(2)))
