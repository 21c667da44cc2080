"""Boxes: overlap, default collision boxes, clamping, scaling to fit, directions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> tuple[Column, Column]:
    """Areas of the intersection and of the union."""
    w = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    h = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    inner = F.when((w < 0) | (h < 0), 0).otherwise(w * h)
    return inner, aw * ah + bw * bh - inner


def clamp(x: Column, y: Column, w: Column, h: Column, most_w: Column, most_h: Column) -> Column:
    cx, cy = F.greatest(F.lit(0), F.least(x, most_w - 1)), F.greatest(F.lit(0), F.least(y, most_h - 1))
    return F.struct(cx.alias("x"), cy.alias("y"), F.greatest(F.lit(1), F.least(w, most_w - cx)).alias("w"), F.greatest(F.lit(1), F.least(h, most_h - cy)).alias("h"))


def default_boxes(kind: Column, w: Column, h: Column) -> Column:
    """Struct of hit and hurt boxes (x, y, w, h) that a sprite of a type has by default, all rounded down."""
    group = dims.lookup(kind, dims.BOX_TYPES, "other")
    part = lambda size, percent: F.floor(size * percent / 100).cast("int")
    half = lambda size, inner: F.floor((size - inner) / 2).cast("int")
    out = None
    for name, (hw, hh, uw, uh, top, hurt_top) in dims.BOXES.items():
        a, b, c, d = part(w, hw), part(h, hh), part(w, uw), part(h, uh)
        hit_y, hurt_y = (half(h, b), half(h, d)) if top is None else (part(h, top), part(h, hurt_top))
        boxes = F.struct(
            F.struct(half(w, a).alias("x"), hit_y.alias("y"), a.alias("w"), b.alias("h")).alias("hit"), F.struct(half(w, c).alias("x"), hurt_y.alias("y"), c.alias("w"), d.alias("h")).alias("hurt")
        )
        out = F.when(group == name, boxes) if out is None else out.when(group == name, boxes)
    return out


def margin_box(w: Column, h: Column, percent: int) -> Column:
    """A box inside a margin of ``percent`` on every side."""
    mx, my = F.floor(w * percent / 100).cast("int"), F.floor(h * percent / 100).cast("int")
    return F.struct(mx.alias("x"), my.alias("y"), F.greatest(F.lit(1), w - 2 * mx).alias("w"), F.greatest(F.lit(1), h - 2 * my).alias("h"))


def to_valid(size: Column, valid: tuple[int, ...]) -> Column:
    """The smallest valid size not under ``size``, or the largest."""
    return F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, valid)), lambda v: v >= size)), F.lit(max(valid)))


def power_of_two(n: Column) -> Column:
    """The next power of two, 1 for 0 and less; exact for whole numbers up to 2**31."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2), F.length(F.bin((n - 1).cast("long")))).cast("long"))


def direction(angle: Column) -> Column:
    """0 to 7: the nearest eighth of a turn, halves to even."""
    return F.pmod(F.bround(angle / 45.0), F.lit(8)).cast("int")


def opposite(d: Column) -> Column:
    return (d + 4) % 8


def mirror(d: Column) -> Column:
    """The direction seen in a mirror that swaps left and right (0 is right, turning)."""
    return F.pmod(4 - d, F.lit(8))


def turn_table(function: Callable[[Column], Column], step: Column, steps: int = 256, scale: int = 256) -> Column:
    """A table of a turn in ``steps``, times ``scale`` and rounded (ties to even), looked up at ``step``; the table is a constant of the plan."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.rint(function(i * F.lit(2 * math.pi / steps)) * scale).cast("long"))
    return F.get(turn, F.pmod(step, F.lit(steps)))


def heading_of(dx: Column, dy: Column, size: int = 256) -> Column:
    """The heading (256 steps of a turn) of a vector, from an arctangent table of the first octant that is looked up at the quotient of the shorter and the longer side; 0 for no vector."""
    ax, ay = F.abs(dx), F.abs(dy)
    table = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.rint(F.atan(i / F.lit(float(size - 1))) / (2 * math.pi) * 256).cast("long"))
    place = F.least(F.lit(size - 1), F.coalesce(F.floor(F.least(ax, ay) * size / F.nullif(F.greatest(ax, ay), F.lit(0))), F.lit(0))).cast("int")
    octant = F.get(table, place)
    quarter = F.when(ay <= ax, octant).otherwise(64 - octant)
    return F.when((dx >= 0) & (dy >= 0), quarter).when(dy >= 0, 128 - quarter).when(dx < 0, 128 + quarter).otherwise(F.pmod(256 - quarter, F.lit(256)))
