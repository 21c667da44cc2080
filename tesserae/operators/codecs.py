"""Byte codecs as binary-to-binary columns: run lengths and two LZ formats, each with its inverse, and the choice among them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

LITERALS, RUNS = 128, 129


def rle_pack(data: bytes) -> bytes:
    """Runs of 2 to 129 equal bytes as (0x80 + n - 2, byte), others as (n - 1, bytes), 128 at most; a run of two inside others stays with them."""
    runs = []
    for byte, own in itertools.groupby(data):
        n = sum(1 for _ in own)
        runs += [(byte, RUNS)] * (n // RUNS) + [(byte, n % RUNS)] * (n % RUNS > 0)
    out, held = bytearray(), bytearray()

    def flush() -> None:
        if held:
            out.append(len(held) - 1)
            out.extend(held)
            held.clear()

    for byte, n in runs:
        if n >= 3 or (n == 2 and not held):
            flush()
            out += bytes((0x80 + n - 2, byte))
        else:
            for _ in range(n):
                held.append(byte)
                if len(held) == LITERALS:
                    flush()
    flush()
    return bytes(out)


def rle_unpack(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n, at = data[at], at + 1
        if n & 0x80:
            out += data[at : at + 1] * (n - 0x80 + 2)
            at += 1
        else:
            out += data[at : at + n + 1]
            at += n + 1
    return bytes(out)


class Matcher:
    """The longest earlier match of at least three bytes inside the window, the earliest among equals.

    Where a length matches, shorter ones do, so the length is found by halving, and each try is one search by ``bytes.find``.
    """

    def __init__(self, data: bytes, window: int, longest: int) -> None:
        self.data, self.window, self.longest = data, window, longest

    def at(self, pos: int) -> tuple[int, int]:
        data, first = self.data, max(0, pos - self.window)
        most = min(self.longest, len(data) - pos)
        if most < 3:
            return 0, 0
        find = lambda n: data.find(data[pos : pos + n], first, pos - 1 + n)
        where, best = find(3), 3
        if where < 0:
            return 0, 0
        low, high = 3, most
        while low < high:
            n = (low + high + 1) // 2
            k = find(n)
            if k < 0:
                high = n - 1
            else:
                low, where, best = n, k, n
        return where, best


def _lz_pack(data: bytes, window: int, longest: int, pair: Callable[[int, int], bytes], fill: bool) -> bytes:
    """Groups of eight items behind a flag byte, lowest bit first: 1 for a literal, 0 for a pair (distance, length). ``fill``: unused flags are set."""
    match, out, pos = Matcher(data, window, longest), bytearray(), 0
    while pos < len(data):
        flags, items = 0, bytearray()
        for bit in range(8):
            if pos >= len(data):
                flags |= fill << bit
                continue
            where, n = match.at(pos)
            if n >= 3:
                items += pair(pos - where, n)
                pos += n
            else:
                flags |= 1 << bit
                items.append(data[pos])
                pos += 1
        out.append(flags)
        out += items
    return bytes(out)


def _lz_unpack(data: bytes, pair: Callable[[int, int], tuple[int, int]]) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        flags, at = data[at], at + 1
        for bit in range(8):
            if at >= len(data):
                break
            if flags >> bit & 1:
                out.append(data[at])
                at += 1
            elif at + 1 < len(data):
                back, n = pair(data[at], data[at + 1])
                at += 2
                for _ in range(n):
                    out.append(out[-back] if back <= len(out) else 0)
            else:
                return bytes(out)
    return bytes(out)


#: Distances are 12 bits, so the window ends one byte before 4096.
WINDOW = 4095


def lz_low_pack(data: bytes) -> bytes:
    """Pairs of (low distance, high distance << 4 | length - 3), lengths to 18; unused flags of the last group are set."""
    if not data:
        return b"\xff"
    return _lz_pack(data, WINDOW, 18, lambda d, n: bytes((d & 0xFF, d >> 8 << 4 | n - 3)), True)


def lz_low_unpack(data: bytes) -> bytes:
    return _lz_unpack(data, lambda a, b: (a | b >> 4 << 8, (b & 15) + 3))


def lz_word_pack(data: bytes) -> bytes:
    """Pairs as big-endian words (distance - 1) << 4 | length - 3, lengths to 18."""
    return _lz_pack(data, WINDOW + 1, 18, lambda d, n: ((d - 1) << 4 | n - 3).to_bytes(2, "big"), False) if data else b"\x00"


def lz_word_unpack(data: bytes) -> bytes:
    return _lz_unpack(data, lambda a, b: ((a << 8 | b) // 16 + 1, (b & 15) + 3))


CODECS = {"rle": (rle_pack, rle_unpack), "lz_low": (lz_low_pack, lz_low_unpack), "lz_word": (lz_word_pack, lz_word_unpack)}


def _column(function: Callable[[bytes], bytes]) -> Callable:
    @F.pandas_udf(BinaryType())
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for data in batches:
            yield data.map(lambda x: None if x is None else function(bytes(x)))

    return each


def pack(data: Column, codec: str) -> Column:
    return _column(CODECS[codec][0])(data)


def unpack(data: Column, codec: str) -> Column:
    return _column(CODECS[codec][1])(data)


def run_share(text: Column) -> Column:
    """Characters in runs of four equal ones or more, and all of them."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2{3,})"), F.lit(1))
    return F.struct(F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r)).alias("inside"), F.length(text).alias("all"))


def choice(text: Column) -> Column:
    """``rle`` where over a quarter lies in such runs, ``none`` for nothing, else ``lz_low``."""
    share = run_share(text)
    return F.when(share["all"] == 0, "none").when(share["inside"] * 4 > share["all"], "rle").otherwise("lz_low")


def compared(rows: DataFrame, key: str, data: str) -> DataFrame:
    """Sizes of each row's data under every codec: key, codec, size, whole (it unpacks to the same)."""
    each = [rows.select(key, F.col(data).alias("__d")).withColumn("__p", pack(F.col("__d"), c)).select(key, F.lit(c).alias("codec"), F.length("__p").alias("size"), (unpack(F.col("__p"), c) == F.col("__d")).alias("whole")) for c in CODECS]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out
