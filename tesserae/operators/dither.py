"""Error diffusion over whole images, colour reduction by median cut, and connected regions: one image at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where an error goes (down, right) and its share.
FLOYD_STEINBERG = ((0, 1, 7 / 16), (1, -1, 3 / 16), (1, 0, 5 / 16), (1, 1, 1 / 16))
ATKINSON = ((0, 1, 1 / 8), (0, 2, 1 / 8), (1, -1, 1 / 8), (1, 0, 1 / 8), (1, 1, 1 / 8), (2, 0, 1 / 8))
KERNELS = {"floyd_steinberg": FLOYD_STEINBERG, "atkinson": ATKINSON}


def diffuse(pixels: np.ndarray, palette: np.ndarray, kernel: Sequence[tuple[int, int, float]]) -> np.ndarray:
    """Places in ``palette`` (n, 3) for ``pixels`` (images, height, width, 3). Images go side by side, pixels in order: each depends on those before."""
    images, height, width, _ = pixels.shape
    work, out = pixels.astype(np.float32), np.zeros((images, height, width), np.int32)
    palette = palette.astype(np.float32)
    for y in range(height):
        for x in range(width):
            old = np.clip(work[:, y, x], 0, 255)
            best = ((old[:, None] - palette) ** 2).sum(axis=2).argmin(axis=1)
            out[:, y, x] = best
            error = old - palette[best]
            for dy, dx, share in kernel:
                if y + dy < height and 0 <= x + dx < width:
                    work[:, y + dy, x + dx] += error * np.float32(share)
    return out


def dithered(images: DataFrame, palette: Sequence[tuple[int, int, int]], how: str, width: int, px: str = "px") -> DataFrame:
    """``images`` with ``idx``: palette places of ``px`` (an array of grey values or of r, g, b in turn, row by row). Images of a batch that are of one size go together."""
    colours, kernel = np.array(palette), KERNELS[how]

    def each(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            found: list = [None] * len(batch)
            sizes: dict[int, list[int]] = {}
            for k, p in enumerate(batch[px]):
                if p is not None and len(p):
                    sizes.setdefault(len(p), []).append(k)
            for size, own in sizes.items():
                flat = np.array([batch[px].iloc[k] for k in own], np.float32)
                deep = 3 if size % (3 * width) == 0 and size > width * width else 1
                shaped = flat.reshape(len(own), -1, width, deep)
                for k, idx in zip(own, diffuse(np.repeat(shaped, 3, axis=3) if deep == 1 else shaped, colours, kernel), strict=True):
                    found[k] = idx.ravel()
            yield batch.assign(idx=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", idx array<int>"
    return images.mapInPandas(each, schema)


def median_cut(colours: DataFrame, key: str, size: int = 16) -> DataFrame:
    """Per image up to ``size`` colours (key, idx, r, g, b, pixels): boxes of distinct colours are halved at the median of their widest channel, ceil(log2 size) times, and averaged (rounded down)."""
    counts = colours.groupBy(key, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    depth = max(0, (size - 1).bit_length())

    def one(df: pd.DataFrame) -> pd.DataFrame:
        c = df.sort_values(["r", "g", "b"])[["r", "g", "b", "n"]].to_numpy(np.int64)
        boxes = [c]
        for _ in range(depth):
            halves = []
            for b in boxes:
                if len(b) < 2:
                    halves.append(b)
                    continue
                channel = int(np.argmax(np.ptp(b[:, :3], axis=0)))
                b = b[np.argsort(b[:, channel], kind="stable")]
                halves += [b[: len(b) // 2], b[len(b) // 2 :]]
            boxes = halves
        rows = [(df[key].iloc[0], k, *(b[:, :3].sum(axis=0) // len(b)).tolist(), int(b[:, 3].sum())) for k, b in enumerate(boxes[:size] if len(boxes) > size else boxes)]
        return pd.DataFrame(rows, columns=[key, "idx", "r", "g", "b", "pixels"])

    kind = colours.schema[key].dataType.simpleString()
    return counts.groupBy(key).applyInPandas(one, f"{key} {kind}, idx int, r long, g long, b long, pixels long")


def region(width: int, px: Sequence[int], tolerance: int = 10) -> list[bool]:
    """What a flood from the four corners reaches: pixels within ``tolerance`` of the corner that they are reached from."""
    a = np.array(px).reshape(-1, width)
    hit = np.zeros(a.shape, bool)
    for cy, cx in ((0, 0), (0, -1), (-1, 0), (-1, -1)):
        like = np.abs(a - a[cy, cx]) <= tolerance
        grown = np.zeros(a.shape, bool)
        grown[cy, cx] = True
        while True:
            more = grown.copy()
            more[1:] |= grown[:-1]
            more[:-1] |= grown[1:]
            more[:, 1:] |= grown[:, :-1]
            more[:, :-1] |= grown[:, 1:]
            more &= like
            if (more == grown).all():
                break
            grown = more
        hit |= grown
    return hit.ravel().tolist()


def background(images: DataFrame, width: int, tolerance: int = 10, px: str = "px") -> DataFrame:
    """``images`` with ``outside``: which pixels the flood from the corners reaches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", outside array<boolean>"
    flood: Callable = lambda p: None if p is None else region(width, p, tolerance)

    def each(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield batch.assign(outside=batch[px].map(flood))

    return images.mapInPandas(each, schema)
