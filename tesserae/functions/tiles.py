"""Tile expressions over pixel arrays (row-major, ``width`` a row): flips, keys, symmetry, encoders, name-table and sprite words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags of a flip byte.
FLIP_H, FLIP_V = 0x40, 0x80
#: Flags and number of a 32-bit map cell.
CELL_H, CELL_V, CELL_D, CELL_MASK = 0x80000000, 0x40000000, 0x20000000, 0x1FFFFFFF


def _rows(px: Column, width: int) -> Column:
    n = (F.size(px) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda y: F.slice(px, y * width + 1, width))


def _picked(px: Column, places: list[int]) -> Column:
    """The pixels at fixed places: plain generated code, where a lambda would be interpreted for each."""
    return F.array(*[F.get(px, F.lit(p)) for p in places])


def flip_h(px: Column, width: int = 8, size: int | None = None) -> Column:
    """``size``: how many pixels every tile has, if that is known; it makes for faster code."""
    if size:
        return _picked(px, [i // width * width + width - 1 - i % width for i in range(size)])
    return F.flatten(F.transform(_rows(px, width), lambda r: F.reverse(r)))


def flip_v(px: Column, width: int = 8, size: int | None = None) -> Column:
    if size:
        return _picked(px, [size - width - i // width * width + i % width for i in range(size)])
    return F.flatten(F.reverse(_rows(px, width)))


def flip_hv(px: Column) -> Column:
    return F.reverse(px)


def key(px: Column) -> Column:
    """MD5 of the pixels, comma-joined."""
    return F.md5(F.array_join(px.cast("array<string>"), ","))


def flip_byte(h: Column, v: Column) -> Column:
    return F.when(h, FLIP_H).otherwise(0) + F.when(v, FLIP_V).otherwise(0)


def similarity(a: Column, b: Column) -> Column:
    """Share of equal pixels."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def near(a: Column, b: Column, tolerance: int = 0) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def density(px: Column) -> Column:
    """Share of pixels that aren't 0."""
    return F.size(F.filter(px, lambda p: p != 0)) / F.size(px)


def symmetry(px: Column, tolerance: int = 0, width: int = 8, size: int | None = None) -> Column:
    """``radial`` (both axes), ``horizontal``, ``vertical`` or ``none``."""
    like = (lambda a, b: near(a, b, tolerance)) if tolerance else (lambda a, b: a == b)
    h, v = like(px, flip_h(px, width, size)), like(px, flip_v(px, width, size))
    return F.when(h & v, "radial").when(h, "horizontal").when(v, "vertical").otherwise("none")


def _number(bits: Column, base: int) -> Column:
    return F.aggregate(bits, F.lit(0), lambda acc, b: acc * base + b)


def hex_bytes(values: Column) -> Column:
    """Whole numbers from 0 to 255 as upper-case hex text."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")


def mask_hex(px: Column, width: int = 8) -> Column:
    """One bit a pixel (not 0), first pixel highest, in bytes of eight."""
    n = (F.size(px) / 8).cast("int")
    return hex_bytes(F.transform(F.sequence(F.lit(0), n - 1), lambda k: _number(F.transform(F.slice(px, k * 8 + 1, 8), lambda p: (p != 0).cast("int")), 2)))


def _plane(row: Column, bit: int) -> Column:
    return _number(F.transform(row, lambda p: F.shiftright(p, bit).bitwiseAND(1)), 2)


#: Named layouts of 8 x 8 tiles: planes of each row in order, or whole planes one after the other, or packed nibbles.
LAYOUTS = ("planar2", "rows2", "packed4", "packed4_low", "pairs4", "mono1", "chunky2")


def encode(px: Column, layout: str) -> Column:
    """An 8 x 8 tile as upper-case hex.

    planar2: all rows of bit 0, then of bit 1. rows2: both bits row by row. packed4: two pixels a byte, first one high; packed4_low: first
    one low. pairs4: bits 0 and 1 row by row, then 2 and 3. mono1: bit 0. chunky2: four pixels a byte, first one high.
    """
    lines = _rows(px, 8)
    if layout in ("planar2", "mono1"):
        return hex_bytes(F.concat(*[_planes(lines, b) for b in range(2 if layout == "planar2" else 1)]))
    if layout == "rows2":
        return hex_bytes(F.flatten(F.transform(lines, lambda r: F.array(_plane(r, 0), _plane(r, 1)))))
    if layout == "pairs4":
        low, high = (F.flatten(F.transform(lines, lambda r: F.array(_plane(r, 0), _plane(r, 1)))), F.flatten(F.transform(lines, lambda r: F.array(_plane(r, 2), _plane(r, 3)))))
        return hex_bytes(F.concat(low, high))
    per = {"packed4": 2, "packed4_low": 2, "chunky2": 4}[layout]
    base = 16 if per == 2 else 4
    n = (F.size(px) / per).cast("int")

    def one(k: Column) -> Column:
        part = F.transform(F.slice(px, k * per + 1, per), lambda p: p.bitwiseAND(base - 1))
        return _number(F.reverse(part) if layout == "packed4_low" else part, base)

    return hex_bytes(F.transform(F.sequence(F.lit(0), n - 1), one))


def _planes(lines: Column, bit: int) -> Column:
    return F.transform(lines, lambda r: _plane(r, bit))


def decode_planar2(data: Column, tile: Column) -> Column:
    """Pixels of the ``tile``-th 16-byte tile (two whole planes) of hex text."""
    at = tile * 32
    byte = lambda k: F.conv(F.substring(data, at + k * 2 + 1, F.lit(2)), 16, 10).cast("int")
    bit = lambda k, x: F.floor(byte(k) / F.pow(F.lit(2), 7 - x)).cast("int") % 2
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: bit(F.floor(i / 8).cast("int"), i % 8) + 2 * bit(F.floor(i / 8).cast("int") + 8, i % 8))


def name_word(tile: Column, h: Column, v: Column, palette: Column, priority: Column) -> Column:
    """PPVH and an 11-bit tile number: priority 15, palette 13-14, vertical 12, horizontal 11."""
    word = tile.cast("long").bitwiseAND(0x7FF).bitwiseOR(F.when(h, 1 << 11).otherwise(0).cast("long")).bitwiseOR(F.when(v, 1 << 12).otherwise(0).cast("long"))
    return word.bitwiseOR(F.shiftleft(palette.cast("long").bitwiseAND(3), 13)).bitwiseOR(F.when(priority, 1 << 15).otherwise(0).cast("long"))


def word_hex(word: Column, endian: str = "big") -> Column:
    text = F.lpad(F.hex(word.cast("long")), 4, "0")
    return text if endian == "big" else F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2))


def sprite_words(x: Column, y: Column, width_tiles: Column, height_tiles: Column, tile: Column, link: Column, palette: Column, priority: Column, h: Column, v: Column) -> Column:
    """An 8-byte sprite entry in hex: y + 128, size and link, tile word, x + 128."""
    size = F.shiftleft((width_tiles - 1).bitwiseAND(3), 2).bitwiseOR((height_tiles - 1).bitwiseAND(3))
    words = ((y + 128).bitwiseAND(0x3FF), F.shiftleft(size, 8).bitwiseOR(link.bitwiseAND(0x7F)), name_word(tile, h, v, palette, priority), (x + 128).bitwiseAND(0x3FF))
    return F.concat(*map(word_hex, words))


def tiles_across(pixels: Column) -> Column:
    """Pixels in tiles of eight, rounded up, from 1 to 4."""
    return F.greatest(F.lit(1), F.least(F.lit(4), F.floor((pixels + 7) / 8).cast("int")))


def split_cell(raw: Column) -> tuple[Column, Column, Column, Column]:
    """Number and the three flip flags of a map cell."""
    raw = raw.cast("long")
    return raw.bitwiseAND(CELL_MASK), raw.bitwiseAND(CELL_H) != 0, raw.bitwiseAND(CELL_V) != 0, raw.bitwiseAND(CELL_D) != 0
