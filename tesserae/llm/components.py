"""Connected components by alternating large-star and small-star rounds of joins; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Hang neighbours on the smallest node around: those larger than the node itself (large star), or those smaller and the node (small star). Rows may repeat.

    One shuffle by node: a window tells the smallest neighbour, and no edges are joined back to it.
    """
    if both:
        around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    hung = around.withColumn("m", F.least("a", F.min("b").over(Window.partitionBy("a"))))
    if both:
        return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))
    return hung.select(ends.alias("e")).select("e.*").filter("a <> b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: any ordered type) to (node, root): every node of an edge and the smallest node that it reaches.

    Null ends and loops are ignored; no edges give an empty result. Each round writes its edges to the shared folder. More than
    ``rounds`` rounds raise an error (the number needed grows as the square of the logarithm of the largest component at most).
    """
    now = stored(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = stored(_star(_star(now, True), False).distinct(), "edges")
        # A round only ever replaces edges by edges between smaller nodes, so one that changes nothing has hung all nodes on the smallest: stars.
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
