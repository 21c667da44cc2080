"""Tile reduction against a plain loop over one image."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tesserae.operators import reduction as ops

W, H = 32, 24


def tile_of(px, tx, ty):
    return [px[(ty * 8 + y) * W + tx * 8 + x] for y in range(8) for x in range(8)]


def unique(px):
    seen = set()
    for ty in range(H // 8):
        for tx in range(W // 8):
            lines = [tile_of(px, tx, ty)[k * 8 : k * 8 + 8] for k in range(8)]
            forms = [lines, [r[::-1] for r in lines], lines[::-1], [r[::-1] for r in lines[::-1]]]
            seen.add(min(tuple(c for r in f for c in r) for f in forms))
    return len(seen)


def plainly(px, kind, bits):
    keep = lambda b: [tuple(v >> (8 - b) << (8 - b) for v in c) for c in px]
    if kind == "blur":
        mix = lambda a, b, c: tuple((i + 6 * j + k + 4) >> 3 for i, j, k in zip(a, b, c, strict=True))
        at = lambda p, x, y: p[min(max(y, 0), H - 1) * W + min(max(x, 0), W - 1)]
        across = [mix(at(px, x - 1, y), at(px, x, y), at(px, x + 1, y)) for y in range(H) for x in range(W)]
        px = [mix(at(across, x, y - 1), at(across, x, y), at(across, x, y + 1)) for y in range(H) for x in range(W)]
        return [tuple(v >> (8 - bits) << (8 - bits) for v in c) for c in px]
    if kind in ("one", "two"):
        out = list(px)
        for ty in range(H // 8):
            for tx in range(W // 8):
                own = tile_of(px, tx, ty)
                top = [c for c, _ in sorted(Counter(own).items(), key=lambda e: (-e[1], [-v for v in e[0]]))][: 1 if kind == "one" else 2]
                for k, c in enumerate(own):
                    away = [sum((a - b) ** 2 for a, b in zip(c, t, strict=True)) for t in top]
                    out[(ty * 8 + k // 8) * W + tx * 8 + k % 8] = top[away.index(min(away))] if kind == "two" else top[0]
        return out
    return keep(int(kind))


@pytest.fixture(scope="module")
def images(spark):
    rng = random.Random(8)
    make = {
        "noise": lambda x, y: tuple(rng.randrange(256) for _ in range(3)),
        "flat": lambda x, y: (40, 80, 120),
        "slope": lambda x, y: (x * 8, y * 9, (x + y) * 4),
        "spots": lambda x, y: (200, 30, 30) if rng.random() < 0.06 else (20, 20, 60),
        "tiles": lambda x, y: (x % 8 * 30, y % 8 * 30, 90),
    }
    data = {k: [f(x, y) for y in range(H) for x in range(W)] for k, f in make.items()}
    rows = [(k, i % W, i // W, *c) for k, px in data.items() for i, c in enumerate(px)]
    return data, spark.createDataFrame(rows, "image string, x int, y int, r int, g int, b int").repartition(4)


@pytest.mark.parametrize("budget", [1, 4, 9, 100])
def test_loop(images, budget):
    """Every image stops at the first step that fits, or is flagged; pixels agree."""
    data, df = images
    rows = {r.image: r for r in ops.reduced(ops.images_of(df, "image", W), "image", W, H, budget).collect()}
    assert set(rows) == set(data)
    for k, px in data.items():
        now = [tuple(v >> 5 << 5 for v in c) for c in px]
        before, steps = unique(now), 0
        for kind in ops.STEPS:
            if unique(now) <= budget:
                break
            now, steps = plainly(now, kind, 3), steps + 1
        r = rows[k]
        assert (r.before, r.after, r.steps, r.fits) == (before, unique(now), steps, unique(now) <= budget)
        assert [(c >> 16, c >> 8 & 255, c & 255) for c in r.px] == now


def test_no_images(spark):
    df = spark.createDataFrame([], "image string, px array<int>")
    assert ops.reduced(df, "image", W, H, 4).count() == 0
    with pytest.raises(ValueError):
        ops.reduced(df, "image", 12, 8, 4)
