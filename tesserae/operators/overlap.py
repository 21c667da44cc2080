"""Boxes that overlap: candidate pairs by grid cells, votes of several models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import overlap


def pairs(boxes: DataFrame, keys: Sequence[str], ident: Sequence[str], least: float = 0.6, cell: int = 64) -> DataFrame:
    """Pairs (a before b in ``ident`` order) of one group whose intersection over union is over ``least``: keys, a, b, inner, outer.

    Boxes are listed in the grid cells that they touch and joined on the cell; a pair counts in the cell of its intersection's corner only,
    so that it is found once. Work grows with the boxes of a cell, not with those of a group.
    """
    span = lambda c, s: F.sequence(F.floor(F.col(c) / cell), F.floor((F.col(c) + F.greatest(F.col(s) - 1, F.lit(0))) / cell))
    base = boxes.select(*keys, F.struct(*ident).alias("id"), "x", "y", "w", "h")
    listed = base.withColumn("cx", F.explode(span("x", "w"))).withColumn("cy", F.explode(span("y", "h")))
    on = [*keys, "cx", "cy"]
    b = listed.select(*on, *[F.col(c).alias(f"__{c}") for c in ("id", "x", "y", "w", "h")])
    j = listed.join(b, on).filter("id < __id")
    inner, outer = overlap(*[F.col(c) for c in "xywh"], *[F.col(f"__{c}") for c in "xywh"])
    corner = (F.floor(F.greatest("x", "__x") / cell) == F.col("cx")) & (F.floor(F.greatest("y", "__y") / cell) == F.col("cy"))
    j = j.filter(corner).withColumn("inner", inner).withColumn("outer", outer)
    return j.filter((F.col("outer") > 0) & (F.col("inner") > F.lit(least) * F.col("outer"))).select(*keys, F.col("id").alias("a"), F.col("__id").alias("b"), "inner", "outer")


def consensus(boxes: DataFrame, key: str, order: Sequence[str], least: float = 0.6) -> DataFrame:
    """Greedy groups of each image in the given order: members overlap the leader (not each other). Per group: votes, mean box (rounded down), type, accepted.

    The most frequent type wins, the first seen on ties. Two votes accept a group, or one where only one model saw the image. An image is
    a task's group here: its detections are few by nature.
    """

    def whole(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(list(order), kind="stable")
        x, y, w, h = (df[c].to_numpy(np.int64) for c in "xywh")
        kind, models = df["type"].to_numpy(object), df["model"].nunique()
        free, out = np.ones(len(df), bool), []
        for i in range(len(df)):
            if not free[i]:
                continue
            iw, ih = np.minimum(x + w, x[i] + w[i]) - np.maximum(x, x[i]), np.minimum(y + h, y[i] + h[i]) - np.maximum(y, y[i])
            inner = np.where((iw < 0) | (ih < 0), 0, iw * ih)
            own = free & (inner / np.maximum(w * h + w[i] * h[i] - inner, 1) > least)
            own[i] = True
            free &= ~own
            names = kind[own].tolist()
            votes = len(names)
            out.append((df[key].iloc[0], i, votes, *(int(v[own].sum() // votes) for v in (x, y, w, h)), max(dict.fromkeys(names), key=names.count), votes >= 2 or models == 1))
        return pd.DataFrame(out, columns=[key, "leader", "votes", "x", "y", "w", "h", "type", "accepted"])

    kind = boxes.schema[key].dataType.simpleString()
    return boxes.groupBy(key).applyInPandas(whole, f"{key} {kind}, leader long, votes long, x long, y long, w long, h long, type string, accepted boolean")


def uncontained(boxes: DataFrame, keys: Sequence[str], ident: Sequence[str], cell: int = 64) -> DataFrame:
    """Boxes that no other box of their group contains; boxes that are equal remove each other. Containers are found in the cell of a box's corner."""
    span = lambda c, s: F.sequence(F.floor(F.col(c) / cell), F.floor((F.col(c) + F.greatest(F.col(s) - 1, F.lit(0))) / cell))
    base = boxes.withColumn("__id", F.struct(*ident))
    outer = base.select(*keys, F.col("__id").alias("__o"), *[F.col(c).alias(f"__{c}") for c in "xywh"], F.explode(span("x", "w")).alias("__cx"), F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.greatest(F.col("h") - 1, F.lit(0))) / cell)).alias("__rows"))
    outer = outer.withColumn("__cy", F.explode("__rows")).drop("__rows")
    inner = base.withColumn("__cx", F.floor(F.col("x") / cell)).withColumn("__cy", F.floor(F.col("y") / cell))
    on = [inner[k] == outer[k] for k in (*keys, "__cx", "__cy")]
    inside = (F.col("__o") != F.col("__id")) & (F.col("x") >= F.col("__x")) & (F.col("y") >= F.col("__y")) & (F.col("x") + F.col("w") <= F.col("__x") + F.col("__w")) & (F.col("y") + F.col("h") <= F.col("__y") + F.col("__h"))
    for c in on:
        inside = inside & c
    return inner.join(outer, inside, "left_anti").select(*boxes.columns)
