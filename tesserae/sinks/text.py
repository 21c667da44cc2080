"""Text and binary outputs: ordered lines, headers, resource lists, packed words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: Sequence[str], line: str = "line") -> None:
    """Lines in order in text files whose names are in order too: a range partitioning, so that no task sees all."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.text(path)


def palette_lines(colours: DataFrame, keys: Sequence[str], word: Column, per_line: int = 8, style: str = "asm") -> DataFrame:
    """Rows (keys, idx) as lines of ``per_line`` words: assembly (``dc.w $0EEE``) or C (``0x0EEE,``)."""
    text = F.lpad(F.hex(word.cast("long")), 4, "0")
    shown = F.concat(F.lit("$" if style == "asm" else "0x"), text)
    g = colours.withColumn("line_no", F.floor(F.col("idx") / per_line)).groupBy(*keys, "line_no").agg(F.array_sort(F.collect_list(F.struct("idx", shown.alias("w")))).alias("__w"))
    body = F.array_join(F.transform("__w", lambda s: s["w"]), ", ")
    return g.select(*keys, "line_no", (F.concat(F.lit("    dc.w    "), body) if style == "asm" else F.concat(F.lit("    "), body, F.lit(","))).alias("line"))


def padded_palette(colours: DataFrame, keys: Sequence[str], size: int = 16) -> DataFrame:
    """Exactly ``size`` entries a palette: missing ones are 0, further ones are left out."""
    grid = colours.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("idx"))
    return grid.join(colours, [*keys, "idx"], "left").fillna(0)


def resource_line(kind: Column, name: Column, path: Column, *options: Column) -> Column:
    """``KIND name "path" option ...``"""
    return F.concat_ws(" ", F.upper(kind), name, F.concat(F.lit('"'), path, F.lit('"')), *options)


def guarded(lines: Column, guard: Column) -> Column:
    """A C header around lines (an array)."""
    return F.array_join(F.concat(F.array(F.concat(F.lit("#ifndef "), guard), F.concat(F.lit("#define "), guard), F.lit("")), lines, F.array(F.lit(""), F.concat(F.lit("#endif /* "), guard, F.lit(" */")))), "\n")


def binary(rows: DataFrame, keys: Sequence[str], order: Sequence[str], hex_col: str, most: int | None = None, align: int = 1) -> DataFrame:
    """One binary per group: the rows' hex in order, the first ``most`` of them, padded with zeros to a multiple of ``align`` bytes."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(hex_col).alias("__h"))))
    if most is not None:
        parts = F.slice(parts, 1, most)
    g = rows.groupBy(*keys).agg(parts.alias("__p")).withColumn("__t", F.array_join(F.transform("__p", lambda p: p["__h"]), ""))
    size = F.length("__t") / 2
    whole = (F.ceil(size / align) * align * 2).cast("int")
    return g.select(*keys, F.unhex(F.concat(F.col("__t"), F.repeat(F.lit("0"), whole - F.length("__t")))).alias("data"))
