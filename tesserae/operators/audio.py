"""Samples as arrays: resampling, levels, bit depths, estimates. All are expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A rate's share of a small processor, in per cent.
LOAD = {8000: 10, 11025: 14, 13400: 17, 16000: 20, 22050: 28, 32000: 40}
LOW, HIGH = -32768, 32767


def _clip(v: Column) -> Column:
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), v))


def _whole(v: Column) -> Column:
    """Towards zero."""
    return F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("int")


def resample(samples: Column, from_rate: int, to_rate: int) -> Column:
    """Linear interpolation at another rate; the last sample is held."""
    ratio = to_rate / from_rate
    n = F.size(samples)

    def at(i: Column) -> Column:
        place = i / F.lit(ratio)
        k = F.floor(place).cast("int")
        a = F.get(samples, F.least(k, n - 1))
        b = F.coalesce(F.get(samples, k + 1), a)
        return _clip(_whole(a + (b - a) * (place - k)))

    length = F.floor(n * F.lit(ratio)).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), at)).otherwise(F.array().cast("array<int>"))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda s: F.abs(s.cast("long")))), F.lit(0))


def normalise(samples: Column, target: float = 0.95) -> Column:
    """Scaled so that the peak is ``target`` of the largest value; silence stays."""
    scale = F.lit(int(HIGH * target)) / F.nullif(peak(samples), F.lit(0))
    return F.when(peak(samples) == 0, samples).otherwise(F.transform(samples, lambda s: _clip(_whole(s * scale))))


def unsigned8(samples: Column) -> Column:
    return F.transform(samples, lambda s: F.shiftright(s + 32768, 8).bitwiseAND(255))


def signed8(samples: Column) -> Column:
    return F.transform(samples, lambda s: F.shiftright(s, 8).bitwiseAND(255))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.floor((a + b) / 2).cast("int"))


def load(rate: Column, knots: dict[int, int] | None = None) -> Column:
    """Between the two known rates around ``rate`` on a line; the end values outside."""
    table: Sequence[tuple[int, int]] = sorted((knots or LOAD).items())
    out = F.lit(float(table[-1][1]))
    for (r0, v0), (r1, v1) in reversed(list(zip(table, table[1:], strict=False))):
        out = F.when(rate <= r1, v0 + (rate - r0) / F.lit(float(r1 - r0)) * (v1 - v0)).otherwise(out)
    return F.when(rate < table[0][0], float(table[0][1])).otherwise(out)


def category(milliseconds: Column, name: Column) -> Column:
    """By words of the name, else by length."""
    low = F.lower(name)
    return F.when(low.rlike("music|theme|bgm"), "music").when(low.rlike("voice|speech"), "voice").when(milliseconds < 500, "effect").when(milliseconds < 3000, "jingle").otherwise("music")
