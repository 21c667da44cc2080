"""Layers, glows, resampling and turns against plain loops over one image."""

from __future__ import annotations

import math
import random

import pytest

from tesserae.operators import compositing as ops

W, H = 11, 7


def mixed(under, over, mask):
    t = under * (255 - mask) + over * mask + 128
    return ((t >> 8) + t) >> 8


def pasted(under, over):
    return tuple(mixed(u, o, over[3]) for u, o in zip(under, over, strict=True))


@pytest.fixture(scope="module")
def images(spark):
    rng = random.Random(2)
    pick = lambda: (rng.choice((0, 40, 250)), rng.randrange(256), rng.choice((60, 9)), rng.choice((0, 0, 0, 1, 90, 127, 128, 200, 255, 255)))
    data = {k: {(x, y): pick() for x in range(W) for y in range(H)} for k in range(3)}
    df = spark.createDataFrame([(k, x, y, *c) for k, own in data.items() for (x, y), c in own.items()], "image int, x int, y int, r int, g int, b int, a int").repartition(3)
    return data, df


def found(df):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.image, {})[(r.x, r.y)] = (r.r, r.g, r.b, r.a)
    return out


CLEAR = (0, 0, 0, 0)


@pytest.mark.parametrize("dx, dy", [(2, 3), (-1, 2), (0, 0), (3, -2)])
def test_shadow(images, dx, dy):
    data, df = images
    got = found(ops.shadow(df, "image", dx, dy, (10, 20, 30, 100)))
    for k, own in data.items():
        want = {}
        for x in range(W + abs(dx)):
            for y in range(H + abs(dy)):
                c = CLEAR
                cast = own.get((x - max(0, dx), y - max(0, dy)), CLEAR)
                if cast[3]:
                    c = pasted(c, ((10, 20, 30) if cast[3] >= 128 else cast[:3]) + (cast[3] * 100 // 255,))
                c = pasted(c, own.get((x - max(0, -dx), y - max(0, -dy)), CLEAR))
                if c[3]:
                    want[(x, y)] = c
        assert got[k] == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_glow(images, radius):
    data, df = images
    colour = (250, 9, 60)
    got = found(ops.glow(df, "image", radius, colour))
    for k, own in data.items():
        want = {}
        solid = [p for p, c in own.items() if c[3] >= 128]
        for x in range(-radius, W + radius):
            for y in range(-radius, H + radius):
                c = own.get((x, y), CLEAR)
                out = pasted(CLEAR, (colour if c[3] >= 128 else c[:3]) + (c[3],))
                for r in range(radius, 0, -1):
                    near = c[3] < 128 and any(math.hypot(x - px, y - py) <= r + 0.5 and max(abs(x - px), abs(y - py)) <= r for px, py in solid)
                    ring = pasted((*colour, 255) if near else CLEAR, c)
                    if ring[:3] == colour:
                        ring = (*colour, min(ring[3], int(255 * (r / radius) * 0.5)))
                    out = pasted(out, ring)
                out = pasted(out, c)
                if out[3]:
                    want[(x + radius, y + radius)] = out
        assert got[k] == want


def rows_made(df) -> dict[str, int]:
    """The most rows that the operators of each name make when ``df`` runs."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    most: dict = {}
    todo = [execution.executedPlan()]
    while todo:
        node = todo.pop()
        made = node.metrics().get("numOutputRows")
        if made.isDefined():
            most[node.nodeName()] = max(most.get(node.nodeName(), 0), made.get().value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_a_glow_makes_no_row_for_each_place_around_a_pixel(spark, images):
    """Pixels are told to the few bands of lines that they reach; lines come as text from the task that makes them."""
    df = images[1]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seen = df.filter("a > 0").count()
        for name in ("glow", "glow_lines"):
            made = rows_made(getattr(ops, name)(df, "image", 2, (250, 9, 60)))
            assert 0 < made["Generate"] <= seen
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_glows_of_large_and_odd_images(spark):
    """Images over many bands and blocks, far apart, with places that are there twice, channels beyond a byte, no key, or nothing to be seen in a band, against a plain loop; lines as text are the same pixels in order."""
    rng = random.Random(5)
    places = [(x, y) for x in (-3, -1, 0, 1, 4093, 4095, 4096, 4100, 9_000_000) for y in (-5, -1, 0, 123, 126, 127, 128, 131, 255, 256, 70_000)]
    many = [(x, y, rng.choice((250, -40, 300)), rng.randrange(256), 60, rng.choice((1, 90, 128, 255, 255))) for x, y in places + places[::3] if rng.random() < 0.8]
    rows = [(k, *p) for k in (None, 7) for p in many]
    df = spark.createDataFrame([*rows, (7, None, 1, 1, 1, 1, 255), (7, 5, 5, 9, 9, 9, 0), (8, 1, 1, 9, 9, 9, None), (9, 1, 1, None, 9, 9, 255), (10, 1, 1, 9, 9, 9, 1), (9, 9, 122, 1, 2, 3, 90)], "image int, x int, y int, r int, g int, b int, a int").repartition(3)
    radius, colour = 3, (250, 9, 60)
    own: dict = {}
    for x, y, *c in many:
        own[x, y] = tuple(map(max, own.get((x, y), (-999,) * 4), c))
    solid = {p for p, c in own.items() if c[3] >= 128}
    around = {(x + dx, y + dy) for x, y in solid for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1)}
    want = {}
    for x, y in around | set(own):
        c = own.get((x, y), CLEAR)
        out = pasted(CLEAR, (colour if c[3] >= 128 else c[:3]) + (c[3],))
        for r in range(radius, 0, -1):
            near = c[3] < 128 and any((x + dx, y + dy) in solid for dx in range(-r, r + 1) for dy in range(-r, r + 1) if math.hypot(dx, dy) <= r + 0.5)
            ring = pasted((*colour, 255) if near else CLEAR, c)
            if ring[:3] == colour:
                ring = (*colour, min(ring[3], int(255 * (r / radius) * 0.5)))
            out = pasted(out, ring)
        out = pasted(out, c)
        if out[3]:
            want[(x + radius, y + radius)] = out
    got = found(ops.glow(df, "image", radius, colour))
    assert set(got) == {None, 7, 9} and got[None] == got[7] == want and got[9][4, 4] == (0, 9, 9, 255)
    lines = {(r.image, r.y): r.line for r in ops.glow_lines(df, "image", radius, colour).collect()}
    for k, own in got.items():
        told: dict = {}
        for (x, y), c in sorted(own.items()):
            told.setdefault(y, []).append(f"{x}:{','.join(map(str, c))}")
        assert {y: line for (i, y), line in lines.items() if i == k} == {y: " ".join(t) for y, t in told.items()}


def test_weights():
    """Each place's weights make up one; the same size changes nothing; enlarging uses three places on each side at most."""
    for size, to in ((96, 40), (40, 96), (7, 7), (5, 1), (1, 4), (100, 99)):
        rows = ops.lanczos(size, to)
        for out in range(to):
            own = [(k, w) for o, k, w in rows if o == out]
            assert abs(sum(w for _, w in own) - (1 << ops.BITS)) <= len(own) and all(0 <= k < size for k, _ in own)
            assert size > to or len(own) <= 6
            if size == to:
                assert [(k, w) for k, w in own if w] == [(out, 1 << ops.BITS)]
    with pytest.raises(ValueError):
        ops.lanczos(1 << 12, 1 << 10, 200)


@pytest.mark.parametrize("to", [(5, 3), (16, 9), (11, 7), (4, 12)])
def test_resampled(images, to):
    data, df = images
    got = found(ops.resampled(df, "image", (W, H), to))
    byte = lambda v: max(0, min(255, (v + (1 << (ops.BITS - 1))) >> ops.BITS))
    across, down = ops.lanczos(W, to[0]), ops.lanczos(H, to[1])
    for k, own in data.items():
        now = {p: tuple(mixed(0, v, c[3]) for v in c[:3]) + (c[3],) for p, c in own.items()}
        lines = {(x, y): tuple(byte(sum(now[(i, y)][n] * w for o, i, w in across if o == x)) for n in range(4)) for x in range(to[0]) for y in range(H)}
        whole = {(x, y): tuple(byte(sum(lines[(x, i)][n] * w for o, i, w in down if o == y)) for n in range(4)) for x in range(to[0]) for y in range(to[1])}
        assert got[k] == {p: c if c[3] in (0, 255) else (*(min(255, v * 255 // c[3]) for v in c[:3]), c[3]) for p, c in whole.items()}


def test_pixels_tell_few_rows_that_the_jvm_compiles(spark, sf_dir, images, monkeypatch):
    """A pixel is not told to each place that takes from it, and the methods that Spark generates are within what the JVM compiles (8000 bytes)."""
    import re

    from tesserae.plans import compositing as plans

    sides = (*range(1, 40), 96, 97, 256)
    for size, to in ((s, t) for s in sides for t in sides):
        told: dict = {}
        for out, _, w in ops.lanczos(size, to):
            told[out] = told.get(out, 0) + abs(w)
        assert max(told.values()) < 2 << ops.BITS  # two channels share a long
    data, df = images
    tables = []
    monkeypatch.setattr(ops.F, "broadcast", lambda d: tables.append(d) or d)
    ops.resampled(df, "image", (96, 96), (40, 28))
    across = tables[0].groupBy("x").count().agg({"count": "avg"}).first()[0]
    assert across < 2.5 < len(ops.lanczos(96, 40)) / 96
    monkeypatch.undo()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = plans.image_resampled(spark, sf_dir)
        code = spark._jvm.PythonSQLUtils.explainString(query._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_turns(images):
    """Quarter turns are exact; an eighth turn's canvas holds the whole image, and its middle stays."""
    data, df = images
    rows = ops.turned(df, "image", (W, H), (0, 45, 90, 180, 270)).collect()
    of = lambda k, angle: {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in rows if r.image == k and r.degrees == angle}
    for k, own in data.items():
        assert of(k, 0) == own
        assert of(k, 180) == {(W - 1 - x, H - 1 - y): c for (x, y), c in own.items()}
        assert of(k, 90) == {(H - 1 - y, x): c for (x, y), c in own.items()}
        assert of(k, 270) == {(y, W - 1 - x): c for (x, y), c in own.items()}
        eighth = of(k, 45)
        (wide, high), _ = ops.turn(W, H, 45)
        assert (wide, high) == (13, 13) and 0.8 * W * H < len(eighth) < 1.2 * W * H
        assert eighth[(6, 6)] in {own[(x, y)] for x in (4, 5, 6) for y in (2, 3, 4)}
