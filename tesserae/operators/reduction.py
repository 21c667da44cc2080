"""Tile reduction to a budget: images are simplified step by step until their distinct tiles, modulo flips, fit.

An image is one row with one array of colours, row by row. Images are bounded, so each is simplified inside its row, in numpy: expressions over
arrays would evaluate a whole array for every element of the next one. Nothing is shuffled but the pixels that make up an image.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 8


def colour(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def images_of(pixels: DataFrame, key: str, width: int) -> DataFrame:
    """(key, px) of pixel rows (key, x, y, r, g, b): colours as 24-bit numbers."""
    at = (F.col("y") * width + F.col("x")).alias("i")
    held = pixels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, colour(F.col("r"), F.col("g"), F.col("b")).alias("c")))).alias("s"))
    return held.select(key, F.transform("s", lambda s: s["c"]).alias("px"))


def posterised(px: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` bits of every channel."""
    return px & (256 - (1 << (8 - bits)))


def blurred(px: np.ndarray) -> np.ndarray:
    """Weights 1, 6, 1 across and then down, each rounded; the edge is repeated."""
    for axis in (1, 0):
        p = np.pad(px, [(int(axis == k), int(axis == k)) for k in range(3)], "edge")
        n = px.shape[axis]
        a, b, c = (np.take(p, range(k, k + n), axis) for k in range(3))
        px = (a + 6 * b + c + 4) >> 3
    return px


def tiles(px: np.ndarray) -> np.ndarray:
    """(tiles, 8, 8) numbers of colours."""
    h, w, _ = px.shape
    whole = px[..., 0] << 16 | px[..., 1] << 8 | px[..., 2]
    return whole.reshape(h // SIDE, SIDE, w // SIDE, SIDE).swapaxes(1, 2).reshape(-1, SIDE, SIDE)


def distinct_tiles(px: np.ndarray) -> int:
    """Tiles that no mirroring makes equal."""
    t = tiles(px)
    return len({min(f.tobytes() for f in (k, k[:, ::-1], k[::-1], k[::-1, ::-1])) for k in t})


def few_colours(px: np.ndarray, keep: int) -> np.ndarray:
    """Every tile in its ``keep`` (1 or 2) most frequent colours, of equal ones the larger number first; other pixels take the nearer, the more frequent on ties."""
    out = px.copy()
    h, w, _ = px.shape
    for k, own in enumerate(tiles(px)):
        y, x = k // (w // SIDE) * SIDE, k % (w // SIDE) * SIDE
        values, counts = np.unique(own, return_counts=True)
        top = values[np.lexsort((-values, -counts))][:keep]
        rgb = np.stack([top >> 16, top >> 8 & 255, top & 255], axis=1)
        away = ((px[y : y + SIDE, x : x + SIDE, None, :] - rgb) ** 2).sum(axis=3)
        out[y : y + SIDE, x : x + SIDE] = rgb[away.argmin(axis=2)]
    return out


def step(px: np.ndarray, kind: str, bits: int) -> np.ndarray:
    """An image simplified: ``blur`` (and the top ``bits`` bits again), ``two`` or ``one`` (colours a tile), or a number of bits a channel."""
    if kind == "blur":
        return posterised(blurred(px), bits)
    return few_colours(px, 1 if kind == "one" else 2) if kind in ("one", "two") else posterised(px, int(kind))


#: From what is hardly seen to what is plainly seen.
STEPS = ("blur", "two", "2", "blur", "two", "1", "one")


def reduced(images: DataFrame, key: str, width: int, height: int, budget: int, bits: int = 3, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """(key, px, before, after, steps, fits): every image after the least number of steps with which its distinct tiles fit in ``budget``.

    An image starts with the top ``bits`` bits of its channels. One that no step makes fit keeps the last one's form and is flagged.
    ``width`` and ``height`` are multiples of eight.
    """
    if width % SIDE or height % SIDE:
        raise ValueError("an image has whole tiles")

    def one(px: np.ndarray) -> tuple:
        v = np.asarray(px, np.int64)
        now = posterised(np.stack([v >> 16, v >> 8 & 255, v & 255], axis=1).reshape(height, width, 3), bits)
        before = after = distinct_tiles(now)
        done = 0
        while after > budget and done < len(steps):
            now = step(now, steps[done], bits)
            after, done = distinct_tiles(now), done + 1
        return (now[..., 0] << 16 | now[..., 1] << 8 | now[..., 2]).ravel().astype(np.int32), before, after, done

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [one(p) for p in batch["px"]]
            yield pd.DataFrame({key: batch[key], "px": [f[0] for f in found], "before": [f[1] for f in found], "after": [f[2] for f in found], "steps": [f[3] for f in found]})

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "px").mapInPandas(each, f"{key} {kind}, px array<int>, before int, after int, steps int").withColumn("fits", F.col("after") <= budget)
