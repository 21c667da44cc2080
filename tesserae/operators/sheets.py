"""Packing frames into sheets and sounds into banks: sequential folds, one sheet at a time."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

PLACED = "x long, y long, page long"


def _row(sizes: list[tuple[int, int]], width: int, pad: int) -> list[tuple[int, int]]:
    """In the given order, from left to right, a new row where the width ends."""
    out, x, y, tall = [], pad, pad, 0
    for w, h in sizes:
        if x + w + pad > width:
            x, y, tall = pad, y + tall + pad, 0
        out.append((x, y))
        x, tall = x + w + pad, max(tall, h)
    return out


def _shelf(sizes: list[tuple[int, int]], width: int, pad: int) -> list[tuple[int, int]]:
    """Tallest first, each on the shelf that it leaves least room above, or on a new one."""
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    shelves: list[list[int]] = []  # top, height, next x
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i][1]):
        w, h = sizes[i]
        fits = [s for s in shelves if h <= s[1] and s[2] + w + pad <= width]
        if fits:
            shelf = min(fits, key=lambda s: s[1] - h)
        else:
            shelf = [shelves[-1][0] + shelves[-1][1] + pad if shelves else pad, h, pad]
            shelves.append(shelf)
        out[i] = (shelf[2], shelf[0])
        shelf[2] += w + pad
    return out


def _rects(sizes: list[tuple[int, int]], width: int, pad: int, height: int) -> list[tuple[int, int] | None]:
    """Largest first into the free rectangle with the least room beside the shorter side; what is left splits to the right and below."""
    out: list[tuple[int, int] | None] = [None] * len(sizes)
    free = [(pad, pad, width - pad, height - pad)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i][0] * sizes[i][1]):
        w, h = sizes[i][0] + pad, sizes[i][1] + pad
        fits = [(min(r[2] - w, r[3] - h), k) for k, r in enumerate(free) if w <= r[2] and h <= r[3]]
        if not fits:
            continue
        x, y, rw, rh = free.pop(min(fits)[1])
        out[i] = (x, y)
        free += [r for r in ((x + w, y, rw - w, rh), (x, y + h, w, rh - h)) if r[2] > 0 and r[3] > 0]
        within = lambda a, b: a[0] >= b[0] and a[1] >= b[1] and a[0] + a[2] <= b[0] + b[2] and a[1] + a[3] <= b[1] + b[3]
        free = [a for k, a in enumerate(free) if not any(k != m and within(a, b) for m, b in enumerate(free))]
    return out


def packed(frames: DataFrame, key: str, order: str, how: str = "shelf", width: int = 256, pad: int = 1, height: int = 1 << 30) -> DataFrame:
    """``frames`` (w, h) with page, x and y; ``how``: row, shelf or rects.

    Frames that a page has no room for go on to further pages of the same size; a frame that is larger than a page has null places. The
    folds are sequential, so the frames of one ``key`` are a task's group.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + ", " + PLACED

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order, kind="stable")
        sizes = list(zip(df["w"].tolist(), df["h"].tolist(), strict=True))
        placed: list[tuple[int, int, int] | None] = [None] * len(sizes)
        left, page = list(range(len(sizes))), 0
        while left:
            own = [sizes[i] for i in left]
            places = _rects(own, width, pad, height) if how == "rects" else {"row": _row, "shelf": _shelf}[how](own, width, pad)
            fits = [p is not None and p[0] + s[0] + pad <= width and p[1] + s[1] + pad <= height for p, s in zip(places, own, strict=True)]
            if not any(fits):
                break
            for i, p, ok in zip(left, places, fits, strict=True):
                if ok:
                    placed[i] = (*p, page)
            left, page = [i for i, ok in zip(left, fits, strict=True) if not ok], page + 1
        column = lambda k: pd.array([p and p[k] for p in placed], "Int64")
        return df.assign(x=column(0), y=column(1), page=column(2))

    return frames.groupBy(key).applyInPandas(one, schema)


def banks(sounds: DataFrame, key: str, order: str, capacity: int = 32_768, size: str = "bytes") -> DataFrame:
    """``sounds`` with ``bank``: largest first, into the first bank of the group with room; what is larger than a bank has one of its own."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sounds.schema) + ", bank long"

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values([size, order], ascending=[False, True], kind="stable")
        used: list[int] = []
        found = []
        for n in df[size].tolist():
            k = next((k for k, u in enumerate(used) if u + n <= capacity), len(used))
            if k == len(used):
                used.append(0)
            used[k] += n
            found.append(k)
        return df.assign(bank=found)

    return sounds.groupBy(key).applyInPandas(one, schema)


def power_of_two(n: int) -> int:
    return 1 if n <= 1 else 1 << math.ceil(math.log2(n))
