"""Palettes by clustering: k-means in CIELAB over many images at once, and octrees."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from .storage import stored

RGB = ("r", "g", "b")
#: A channel of CIELAB in whole hundredths, so that distances to a colour and sums of colours are exact.
UNIT = 100
#: Bytes of centroids that are broadcast; more are joined by shuffles.
BROADCAST = 8 << 20


def lab_units() -> list[Column]:
    return [F.floor(c * UNIT + 0.5).cast("long").alias(n) for c, n in zip(C.lab(*[F.col(c) for c in RGB]), ("l", "a", "bb"), strict=True)]


def counted(colours: DataFrame, key: str) -> DataFrame:
    """key, r, g, b, l, a, bb and n: the distinct colours of each image with their pixels; the map side combines."""
    return colours.groupBy(key, *RGB).agg(F.count(F.lit(1)).alias("n")).select(key, *RGB, *lab_units(), "n")


def starts(counts: DataFrame, key: str, size: int) -> DataFrame:
    """key and centroids: of each image's distinct colours in the order of lightness (then a, b, the channels), ``size`` evenly spaced ones with both ends; all where there are fewer."""
    by = f"over (partition by {key} order by l, a, bb, r, g, b)"
    ranked = counts.select("*", F.expr(f"row_number() {by} - 1").alias("k"), F.expr(f"count(*) over (partition by {key})").alias("all"))
    steps = F.least(F.lit(size), F.col("all"))
    # Row k is seed i where k = floor(i (all - 1) / (steps - 1)): the smallest such i is ceil(k (steps - 1) / (all - 1)).
    seed = F.when(F.col("all") == 1, F.lit(0)).otherwise(F.floor((F.col("k") * (steps - 1) + F.col("all") - 2) / F.greatest(F.col("all") - 1, F.lit(1))))
    place = F.when(steps == 1, F.lit(0)).otherwise(F.floor(seed * (F.col("all") - 1) / F.greatest(steps - 1, F.lit(1))))
    kept = ranked.withColumns({"seed": seed.cast("int"), "place": place}).filter((F.col("k") == F.col("place")) & (F.col("seed") < steps))
    centre = F.struct(*[F.col(c).cast("double").alias(c) for c in ("l", "a", "bb")]).alias("c")
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seed", centre))).alias("s")).select(key, F.transform("s", lambda s: s["c"]).alias("centroids"))


def assigned(counts: DataFrame, centroids: DataFrame, key: str, small: bool) -> DataFrame:
    """``counts`` with idx and d: the nearest centroid of the image (the lower number on ties) and its squared distance. A colour meets its image's centroids in one row."""
    joined = counts.join(F.broadcast(centroids) if small else centroids, key)
    away = lambda p: sum(((F.col(c) - p[c]) * (F.col(c) - p[c]) for c in ("a", "bb")), (F.col("l") - p["l"]) * (F.col("l") - p["l"]))
    best = F.array_min(F.transform("centroids", lambda p, i: F.struct(away(p).alias("d"), i.alias("idx"))))
    return joined.withColumn("__best", best).select(*counts.columns, "centroids", F.col("__best.idx").alias("idx"), F.col("__best.d").alias("d"))


def moved(near: DataFrame, key: str) -> DataFrame:
    """key, centroids, before and error: every centroid at the mean of its colours, weighted by pixels; one without any stays. Sums of an entry leave each task as one row."""
    sums = near.groupBy(key, "idx").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("l", "a", "bb")], F.sum(F.col("d") * F.col("n")).alias("e"), F.first("centroids").alias("before"))
    mean = F.struct(*[(F.col(c).cast("double") / F.col("n")).alias(c) for c in ("l", "a", "bb")])
    held = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", mean))).alias("means"), F.first("before").alias("before"), F.sum("e").alias("error"))
    return held.select(key, F.transform("before", lambda p, i: F.coalesce(F.element_at("means", i), p)).alias("centroids"), "before", "error")


def kmeans(colours: DataFrame, key: str, size: int = 16, rounds: int = 12, trace: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Lloyd's rounds in CIELAB for all images together: (counts with idx and d, key with centroids).

    An image leaves the loop when its centroids stay; the others go on for at most ``rounds``. Each round shuffles one row for each image,
    entry and task, and its centroids are a stored table; they are broadcast while they fit in ``BROADCAST`` bytes and joined by a shuffle
    beyond, where Spark splits a skewed image. Rows with a null channel don't count. ``trace`` gets each round's error sum of all images.
    """
    counts = stored(counted(colours.filter(" and ".join(f"{c} is not null" for c in RGB)), key), "kmeans-colours")
    live = stored(starts(counts, key, size), "kmeans-centroids")
    done = None
    for _ in range(rounds):
        images = live.count()
        small = images * size * 24 <= BROADCAST
        after = stored(moved(assigned(counts, live, key, small), key), "kmeans-centroids")
        if trace is not None:
            trace.append({r[0]: r[1] for r in after.select(key, "error").collect()})
        still = after.filter(F.col("centroids") == F.col("before")).select(key, "centroids")
        done = still if done is None else done.unionByName(still)
        live = after.filter(F.col("centroids") != F.col("before")).select(key, "centroids")
        if live.isEmpty():
            break
    last = stored(live if done is None else done.unionByName(live), "kmeans-centroids")
    return assigned(counts, last, key, last.count() * size * 24 <= BROADCAST).drop("centroids"), last


def kmeans_palette(colours: DataFrame, key: str, size: int = 16, rounds: int = 12) -> DataFrame:
    """key, idx, r, g, b, pixels and error (squared distances in CIELAB): the centroids as colours. One that no colour is nearest to has no row."""
    near, centroids = kmeans(colours, key, size, rounds)
    sums = near.groupBy(key, "idx").agg(F.sum("n").alias("pixels"), (F.sum(F.col("d") * F.col("n")) / UNIT**2).alias("error"))
    at = centroids.select(key, F.posexplode("centroids").alias("idx", "c"))
    rgb = C.from_lab(*[F.col(f"c.{c}") / UNIT for c in ("l", "a", "bb")])
    return sums.join(at, [key, "idx"]).select(key, "idx", *[c.alias(n) for c, n in zip(rgb, RGB, strict=True)], "pixels", "error")


def octree_palette(colours: DataFrame, key: str, size: int = 16, depth: int = 5) -> DataFrame:
    """key, idx, r, g, b (means, rounded down) and pixels: an octree's leaves.

    The tree starts as its root; while it has room, the leaf with most pixels (the lower cell on ties) is split into its children that hold
    any, down to ``depth`` bits a channel. Spark sums the cells first, so an image comes to its task as 8**depth rows at most.
    """
    cell = lambda c: F.shiftright(c, 8 - depth)
    cells = colours.filter(" and ".join(f"{c} is not null" for c in RGB)).groupBy(key, *[cell(c).alias(f"c{c}") for c in RGB]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in RGB])

    def one(df: pd.DataFrame) -> pd.DataFrame:
        at, n, total = df[["cr", "cg", "cb"]].to_numpy(np.int64), df["n"].to_numpy(np.int64), df[list(RGB)].to_numpy(np.int64)
        heap = [(-int(n.sum()), 0, (0, 0, 0), np.arange(len(df)))]
        full: list = []
        while heap:
            _, level, place, rows = heapq.heappop(heap)
            if level == depth:
                full.append((place, rows))
                continue
            own = at[rows] >> (depth - 1 - level)
            children = {}
            for k in np.unique(own, axis=0):
                children[tuple(int(v) for v in k)] = rows[(own == k).all(axis=1)]
            if len(heap) + len(full) + len(children) > size:
                full.append((place, rows))
                continue
            for k, mine in children.items():
                heapq.heappush(heap, (-int(n[mine].sum()), level + 1, k, mine))
        found = sorted(((-int(n[r].sum()), *(total[r].sum(axis=0) // n[r].sum()).tolist()) for _, r in full))
        return pd.DataFrame([(df[key].iloc[0], k, r, g, b, -m) for k, (m, r, g, b) in enumerate(found)], columns=[key, "idx", *RGB, "pixels"])

    kind = colours.schema[key].dataType.simpleString()
    return cells.groupBy(key).applyInPandas(one, f"{key} {kind}, idx int, r long, g long, b long, pixels long")
