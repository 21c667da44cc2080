"""Numbers in order, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str, block: Column, order: Sequence[str | Column]) -> DataFrame:
    """``df`` with ``name``: each row's place, from 0, by ``block`` and within it by ``order``.

    ``block`` must grow with the order, such as the order's leading number shifted right. Rows are ranked inside their block, and only the
    blocks' sizes are summed in one place, so a block should hold many rows.
    """
    within = Window.partitionBy("__block").orderBy(*order)
    ranked = df.withColumn("__block", block).withColumn("__rank", F.row_number().over(within))
    sizes = df.groupBy(block.alias("__block")).count()
    before = sizes.select("__block", F.coalesce(F.sum("count").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranked.join(before, ranked["__block"].eqNullSafe(before["__block"])).withColumn(name, F.col("__before") + F.col("__rank") - 1).drop("__block", "__rank", "__before")


def islands(df: DataFrame, keys: Sequence[str], order: str, starts: Column) -> DataFrame:
    """``df`` with ``island``: a number that grows by one in each group wherever ``starts`` is true in the given order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w))
