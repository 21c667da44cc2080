"""Clustered palettes against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tesserae.functions.colour import WHITE, XYZ
from tesserae.operators import clusters
from tesserae.plans import clusters as plans


def lab(rgb):
    linear = [((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in rgb]
    x, y, z = (sum(c * w for c, w in zip(linear, row, strict=True)) / white for row, white in zip(XYZ, WHITE, strict=True))
    root = lambda t: t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116
    return tuple(math.floor(v * 100 + 0.5) for v in (116 * root(y) - 16, 500 * (root(x) - root(y)), 200 * (root(y) - root(z))))


def plain(pixels, size, rounds):
    """Centroid numbers of all colours, and the error sum of every round."""
    count = Counter(pixels)
    colours = sorted(((*lab(c), *c), c) for c in count)
    n = len(colours)
    steps = min(size, n)
    books = [tuple(map(float, colours[0 if steps == 1 else i * (n - 1) // (steps - 1)][0][:3])) for i in range(steps)]
    errors = []
    for left in range(rounds, -1, -1):
        near = {}
        for key, c in colours:
            near[c] = min(((key[0] - b[0]) ** 2 + (key[1] - b[1]) ** 2 + (key[2] - b[2]) ** 2, k) for k, b in enumerate(books))
        errors.append(sum(d * count[c] for c, (d, _) in near.items()))
        after = []
        for k, b in enumerate(books):
            own = [(key, count[c]) for key, c in colours if near[c][1] == k]
            total = sum(m for _, m in own)
            after.append(tuple(sum(key[i] * m for key, m in own) / total for i in range(3)) if own else b)
        if not left or after == books:
            return {c: k for c, (_, k) in near.items()}, errors
        books = after


@pytest.fixture(scope="module")
def pixels():
    rng = random.Random(4)
    images = {k: [tuple(min(255, max(0, int(rng.gauss(m, 25)))) for m in rng.choice(((200, 40, 40), (30, 90, 200), (240, 240, 230), (10, 10, 10)))) for _ in range(300)] for k in range(4)}
    images[4] = [(9, 9, 9)] * 50
    images[5] = [(0, 0, 0), (255, 255, 255), (0, 0, 0)]
    images[6] = [(k % 7 * 30, 0, 0) for k in range(100)]
    return images


@pytest.mark.parametrize("small", [True, False])
def test_every_assignment(spark, pixels, small, monkeypatch):
    if not small:
        monkeypatch.setattr(clusters, "BROADCAST", 0)
    df = spark.createDataFrame([(k, *c) for k, own in pixels.items() for c in own] + [(1, None, 2, 3)], "image int, r int, g int, b int").repartition(5)
    trace: list = []
    near, _ = clusters.kmeans(df, "image", 6, 20, trace)
    got: dict = {}
    for r in near.collect():
        got.setdefault(r.image, {})[(r.r, r.g, r.b)] = r.idx
    for k, own in pixels.items():
        want, errors = plain(own, 6, 20)
        assert got[k] == want
        seen = [t[k] for t in trace if k in t]
        assert seen == pytest.approx(errors[: len(seen)]) and all(b <= a * (1 + 1e-12) for a, b in zip(seen, seen[1:], strict=False))
    assert all(set(b) <= set(a) for a, b in zip(trace, trace[1:], strict=False)), "an image that has settled comes back"


def test_empty(spark):
    df = spark.createDataFrame([], "image int, r int, g int, b int")
    assert clusters.kmeans_palette(df, "image").count() == 0 and clusters.octree_palette(df, "image").count() == 0


def test_octree(spark, pixels):
    df = spark.createDataFrame([(k, *c) for k, own in pixels.items() for c in own], "image int, r int, g int, b int")
    rows = clusters.octree_palette(df, "image", 8).collect()
    for k, own in pixels.items():
        mine = [r for r in rows if r.image == k]
        assert len(mine) <= 8 and sum(r.pixels for r in mine) == len(own)
        distinct = set(own)
        if len(distinct) <= 8:
            assert {(r.r, r.g, r.b) for r in mine} == distinct


def test_octree_query_keeps_all_pixels(spark, sf_dir):
    assert plans.octree_palette(spark, sf_dir).selectExpr("sum(pixels)").first()[0] == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_hundredths_are_rounded_as_in_sql(spark):
    import duckdb
    from pyspark.sql import functions as F

    values = [2498.865, 1.005, 1.015, 2.675, 0.125, 10.5, 3.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(plans._hundredths(F.col("v"))).collect()]
    assert got == [duckdb.connect().execute(f"SELECT round({v!r}::DOUBLE, 2)").fetchone()[0] for v in values]
