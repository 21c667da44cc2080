"""Operators that SQL can't state, against plain loops."""

from __future__ import annotations

import random
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.functions import geometry, text
from tesserae.operators import codecs, dither, motion, overlap, sequential, sheets, tiles
from tesserae.plans import folds


def longest(data: bytes, pos: int, window: int, most: int) -> tuple[int, int]:
    best, where = 0, 0
    for k in range(max(0, pos - window), pos):
        n = 0
        while n < min(most, len(data) - pos) and data[k + n] == data[pos + n]:
            n += 1
        if n > best:
            best, where = n, k
    return (where, best) if best >= 3 else (0, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"abc", b"aaaa", b"xyzxyz", bytes(5), bytes(range(20))]), max_size=60).map(b"".join))
def test_codecs_return_their_input(data):
    for pack, unpack in codecs.CODECS.values():
        assert unpack(pack(data)) == data
    match = codecs.Matcher(data, 40, 18)
    for pos in range(len(data)):
        assert match.at(pos) == longest(data, pos, 40, 18)


def test_codec_formats():
    assert codecs.rle_pack(b"aabbbbc") == bytes([0x80, ord("a"), 0x82, ord("b"), 0, ord("c")])
    assert codecs.rle_pack(b"xaab") == b"\x03xaab" and codecs.rle_pack(b"z" * 131) == bytes([0xFF, ord("z"), 0x80, ord("z")])
    assert codecs.lz_low_pack(b"") == b"\xff" and codecs.lz_low_pack(b"abcabcabc") == bytes([0b11110111]) + b"abc" + bytes([3, 3])
    assert codecs.lz_word_pack(b"abcabcabc") == bytes([0b0111]) + b"abc" + bytes([0, 2 << 4 | 3])
    tileset = bytes((16 * i + j) & 255 for i in range(4) for j in range(32))
    assert all(u(p(tileset)) == tileset for p, u in codecs.CODECS.values())


def test_codec_columns(spark):
    rows = spark.createDataFrame([(1, bytearray(b"aaaa" * 200)), (2, bytearray(b"")), (3, None)], "id int, data binary")
    out = {(r.id, r.codec): r for r in codecs.compared(rows, "id", "data").collect()}
    assert all(out[1, c].whole and out[1, c].size < 200 for c in codecs.CODECS) and out[3, "rle"].size is None
    assert [r[0] for r in spark.createDataFrame([("aaaabbbb",), ("abcdaaaa" * 2 + "x" * 0 + "bcdefghijklmnopqrstuvwx",), ("",)], "t string").select(codecs.choice(F_col("t"))).collect()] == ["rle", "rle" if 8 * 4 > 39 else "lz_low", "none"]


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


@pytest.mark.parametrize("how", ["floyd_steinberg", "atkinson"])
def test_diffusion(how):
    rng = np.random.default_rng(1)
    px, palette = rng.integers(0, 256, (3, 6, 5, 3)), np.array([(0, 0, 0), (255, 255, 255), (200, 30, 40)])
    got = dither.diffuse(px, palette, dither.KERNELS[how])
    for image, want in zip(px, got, strict=True):
        work = image.astype(np.float32)
        for y in range(6):
            for x in range(5):
                old = np.clip(work[y, x], 0, 255)
                k = int(((palette - old) ** 2).sum(axis=1).argmin())
                assert k == want[y, x]
                for dy, dx, share in dither.KERNELS[how]:
                    if y + dy < 6 and 0 <= x + dx < 5:
                        work[y + dy, x + dx] += (old - palette[k]).astype(np.float32) * np.float32(share)


def test_flood_from_corners():
    px = [0, 0, 0, 0, 0, 9, 9, 0, 0, 9, 0, 0, 5, 9, 9, 0]
    assert dither.region(4, px, 0) == [v == 0 and k != 10 or (k in (10, 11)) or k == 12 for k, v in enumerate(px)]


def inside(a, b):
    return a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]


@pytest.mark.parametrize("how", ["row", "shelf", "rects"])
def test_packed_frames_do_not_meet(spark, how):
    rng = random.Random(2)
    rows = [(s, k, rng.choice((8, 16, 24, 60)), rng.choice((8, 16, 40))) for s in range(3) for k in range(60)]
    out = sheets.packed(spark.createDataFrame(rows, "sheet int, ord int, w int, h int"), "sheet", "ord", how, 256, 1, 1024).collect()
    assert len(out) == 180 and all(r.x is not None for r in out)
    for s in range(3):
        own = [(r.x, r.y, r.w, r.h) for r in out if r.sheet == s]
        assert all(x + w < 256 and not any(inside((x, y, w, h), o) for o in own if o != (x, y, w, h)) for x, y, w, h in own)


def test_row_and_shelf_places():
    assert sheets._row([(10, 5), (10, 8), (10, 5)], 24, 1) == [(1, 1), (12, 1), (1, 10)]
    assert sheets._shelf([(10, 5), (10, 8), (10, 8), (10, 4)], 24, 1) == [(1, 10), (1, 1), (12, 1), (12, 10)]
    # right of the first are 12 x 23, below it 11 x 12: the shorter side leaves 7 or 6
    assert sheets._rects([(4, 4), (10, 10)], 24, 1, 24) == [(1, 12), (1, 1)]


def test_banks(spark):
    rows = [(0, k, n) for k, n in enumerate((20, 30, 25, 10, 5, 70))]
    out = {r.ord: r.bank for r in sheets.banks(spark.createDataFrame(rows, "game int, ord int, bytes long"), "game", "ord", 50).collect()}
    assert out == {5: 0, 1: 1, 2: 2, 0: 1, 3: 2, 4: 2}


def test_limits_and_breakers(spark):
    rng = random.Random(3)
    rows = [(k % 3, k, k + rng.random() * 5, rng.random() < 0.6) for k in range(600)]
    df = spark.createDataFrame(rows, "w int, id int, at double, ok boolean").repartition(5)
    allowed = {r.id: r.allowed for r in sequential.rate_limited(df, ["w"], ["at"], 4, 30.0).collect()}
    states = {r.id: r.state for r in sequential.circuit_broken(df, ["w"], ["at"], 2, 20.0).collect()}
    for w in range(3):
        times, run, opened = deque(), 0, None
        for _, k, at, ok in sorted((r for r in rows if r[0] == w), key=lambda r: r[2]):
            while times and at - times[0] > 30:
                times.popleft()
            assert allowed[k] == (len(times) < 4)
            if allowed[k]:
                times.append(at)
            if opened is not None and at - opened < 20:
                assert states[k] == "open"
                continue
            if opened is not None:
                run, opened = 0, None
            assert states[k] == ("ok" if ok else "error")
            run = 0 if ok else run + 1
            if run >= 2:
                opened = at


def test_streams_equal_batches(spark, sf_dir):
    from tesserae.plans import streams

    for name, batch in (("stream_rate_limit", folds.rate_limit), ("stream_circuit_breaker", folds.circuit_breaker)):
        column = "allowed" if "rate" in name else "state"
        got = {r.event_id: r[column] for r in getattr(streams, name)(spark, sf_dir).collect()}
        assert got == {r.event_id: r[column] for r in batch(spark, sf_dir).collect()}
    closed = {(r.path, r["first"]): r.n for r in streams.stream_debounce(spark, sf_dir).collect()}
    whole = {(r.path, r["first"]): r.n for r in folds.debounce_sessions(spark, sf_dir).collect()}
    assert closed and closed.items() <= whole.items() and len(whole) - len(closed) < 0.2 * len(whole)


def test_consensus_follows_the_leader(spark, sf_dir):
    from tesserae.plans import fixtures

    boxes = fixtures.boxes(spark, sf_dir)
    got = sorted(map(tuple, overlap.consensus(boxes, "image", ["ord", "model"]).collect()))
    images: dict = {}
    for r in boxes.collect():
        images.setdefault(r.image, []).append(r)
    want = []
    for image, own in images.items():
        own.sort(key=lambda r: (r.ord, r.model))
        used = set()
        for i, a in enumerate(own):
            if i in used:
                continue
            group = []
            for j, b in enumerate(own):
                w, h = min(a.x + a.w, b.x + b.w) - max(a.x, b.x), min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
                inner = w * h if w >= 0 and h >= 0 else 0
                if j not in used and (i == j or inner / (a.w * a.h + b.w * b.h - inner) > 0.6):
                    group.append(b)
                    used.add(j)
            kinds = [b.type for b in group]
            want.append((image, i, len(group), *(sum(b[c] for b in group) // len(group) for c in "xywh"), max(dict.fromkeys(kinds), key=kinds.count), len(group) >= 2 or len({b.model for b in own}) == 1))
    assert got == sorted(want)


def test_dedup_is_the_greedy_pass(spark):
    """Classes modulo flips are those of a first-seen pass, for every set of enabled flips."""
    rng = random.Random(5)
    rows = [(k, 0, [rng.randrange(2) if i in (0, 1, 8) else 0 for i in range(64)]) for k in range(150)]
    rows = [(k, n, px if k % 3 else [px[i // 8 * 8 + 7 - i % 8] for i in range(64)]) for k, n, px in rows]
    flips = {"": [], "h": ["h"], "v": ["v"], "hv": ["h", "v", "hv"]}
    move = {"h": lambda p: [p[i // 8 * 8 + 7 - i % 8] for i in range(64)], "v": lambda p: [p[(7 - i // 8) * 8 + i % 8] for i in range(64)], "hv": lambda p: p[::-1]}
    df = spark.createDataFrame(rows, "a long, b long, px array<int>")
    for enabled, kinds in flips.items():
        got = {r.a: r.kind for r in tiles.dedup(df, ["a", "b"], flips=enabled).collect()}
        bank: list = []
        for k, _, px in rows:
            kind = "exact" if px in bank else next((f for f in kinds if move[f](px) in bank), None)
            if kind is None:
                bank.append(px)
            assert got[k] == (kind or "unique")


def test_reachability_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", "a"), (2, "x", "x")], "fsm int, src string, dst string")
    starts = spark.createDataFrame([(1, "a"), (2, "x")], "fsm int, state string")
    assert sorted(map(tuple, motion.reachable(edges, starts, ["fsm"]).collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "x")]


def test_text_functions(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("sprite:test?.png",), ("..con.txt",), ("",), ("a/b\\c",), ("x" * 300 + ".png",), ("32x32-enemy é",)], "s string")
    got = [tuple(r) for r in rows.select(text.safe_filename(F.col("s")), text.c_identifier(F.col("s"))).collect()]
    assert got[0] == ("sprite_test_.png", "sprite_test__png") and got[1][0] == "_con.txt" and got[2] == ("unnamed", "unnamed") and got[3][0] == "a_b_c"
    assert len(got[4][0]) == 255 and got[4][0].endswith(".png") and got[5][1] == "_32x32_enemy_é"
    n = spark.createDataFrame([(k,) for k in (-1, 0, 1, 2, 3, 4, 5, 1023, 1024, 1025)], "n int").select(geometry.power_of_two(F.col("n"))).collect()
    assert [r[0] for r in n] == [1, 1, 1, 2, 4, 4, 8, 1024, 1024, 2048]
    d = spark.createDataFrame([(22.5,), (67.5,), (359.0,), (180.0,), (-45.0,)], "a double").select(geometry.direction(F.col("a")), geometry.opposite(geometry.direction(F.col("a")))).collect()
    assert [r[0] for r in d] == [0, 2, 0, 4, 7] and d[3][1] == 0
