"""Colour expressions: packed hardware words, shades, luma, CIELAB, distances and nearest entries. All are plain Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight levels of a 3-bit channel.
LEVELS = (0, 36, 72, 109, 145, 182, 218, 255)
# Linear sRGB to XYZ (D65), and the white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _bits(c: Column, shift: int, mask: int) -> Column:
    return F.shiftright(c, shift).bitwiseAND(mask)


def pack9(r: Column, g: Column, b: Column) -> Column:
    """Three bits a channel in a word 0000BBB0GGG0RRR0."""
    return F.shiftleft(_bits(r, 5, 7), 1).bitwiseOR(F.shiftleft(_bits(g, 5, 7), 5)).bitwiseOR(F.shiftleft(_bits(b, 5, 7), 9))


def unpack9(word: Column, expand: str = "levels") -> tuple[Column, Column, Column]:
    """Channels of a 9-bit word; ``expand``: ``levels`` (the level table), ``times36`` or ``shift`` (the top bits alone)."""
    to = {"levels": lambda v: F.element_at(F.array(*map(F.lit, LEVELS)), v + 1), "times36": lambda v: F.least(v * 36, F.lit(255)), "shift": lambda v: F.shiftleft(v, 5)}[expand]
    return tuple(to(_bits(word, s, 7)) for s in (1, 5, 9))


def pack15(r: Column, g: Column, b: Column) -> Column:
    """Five bits a channel in a word 0BBBBBGGGGGRRRRR."""
    return _bits(r, 3, 31).bitwiseOR(F.shiftleft(_bits(g, 3, 31), 5)).bitwiseOR(F.shiftleft(_bits(b, 3, 31), 10))


def unpack15(word: Column) -> tuple[Column, Column, Column]:
    return tuple(_bits(word, s, 31) * 8 for s in (0, 5, 10))


def pack24(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Thousandths of 0.299 r + 0.587 g + 0.114 b, exact for whole channels."""
    return r * 299 + g * 587 + b * 114


def shade2(r: Column, g: Column, b: Column) -> Column:
    """0 (lightest) to 3: luma at least 192, 128, 64 or less."""
    y = luma(r, g, b)
    return F.when(y >= 192_000, 0).when(y >= 128_000, 1).when(y >= 64_000, 2).otherwise(3)


def snap(channel: Column, levels: Sequence[int] = LEVELS) -> Column:
    """The nearest level, the lower on a tie."""
    near = F.array_min(F.array(*[F.struct(F.abs(channel - v).alias("d"), F.lit(v).alias("v")) for v in levels]))
    return near["v"]


def quantise_depth(channel: Column, bits: int) -> Column:
    """The top ``bits`` bits, repeated downwards to eight."""
    top = F.shiftright(channel, 8 - bits)
    out, have = F.shiftleft(top, 8 - bits), bits
    while have < 8:
        out = out.bitwiseOR(F.shiftright(F.shiftleft(top, 8 - bits), have))
        have += bits
    return out.bitwiseAND(255)


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return (top - F.least(r, g, b)) / F.greatest(top, F.lit(1))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB (0-255) to CIELAB."""

    def linear(c: Column) -> Column:
        c = c / F.lit(255.0)
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    def root(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)

    channels = [linear(c) for c in (r, g, b)]
    x, y, z = (root(sum((c * w for c, w in zip(channels, row, strict=True)), F.lit(0.0)) / white) for row, white in zip(XYZ, WHITE, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


# XYZ to linear sRGB (D65).
LINEAR = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))


def from_lab(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIELAB to sRGB (0-255), cut off and rounded down."""

    def cube(t: Column) -> Column:
        return F.when(t > 0.206893, t * t * t).otherwise((t - 16 / 116) / 7.787)

    def gamma(c: Column) -> Column:
        return F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c)

    middle = (lightness + 16) / 116
    xyz = [cube(t) * white for t, white in zip((a / 500 + middle, middle, middle - b / 200), WHITE, strict=True)]
    channels = (gamma(sum((v * w for v, w in zip(xyz, row, strict=True)), F.lit(0.0))) for row in LINEAR)
    return tuple(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c * 255))).cast("int") for c in channels)


#: Squared distances between colours given as (r, g, b) columns; whole numbers but for ``lab``. Weights are in thousandths.
WEIGHTS = {"rgb": (1, 1, 1), "eye": (300, 590, 110), "luma": (299, 587, 114)}


def distance(a: Sequence[Column], b: Sequence[Column], metric: str = "rgb") -> Column:
    if metric == "lab":
        a, b, weights = lab(*a), lab(*b), (1, 1, 1)
    else:
        weights = WEIGHTS[metric]
    return sum(((x - y) * (x - y) * w for x, y, w in zip(a, b, weights, strict=True)), F.lit(0))


def nearest(rgb: Sequence[Column], palette: Sequence[tuple[int, int, int]], metric: str = "rgb", skip: Sequence[int] = ()) -> Column:
    """Struct (d, i): squared distance to and place of the nearest of a fixed palette, the first on ties. One pass, no join."""
    entries = [F.struct(distance(rgb, [F.lit(v) for v in p], metric).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(palette) if i not in set(skip)]
    return F.array_min(F.array(*entries))
