"""Table functions: folds over ordered partitions whose rows stream through in Arrow batches, so that no group has to fit in a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


class RowPacking:
    """Frames (w, h) from left to right, a new row where the width ends: x, y and page. A frame wider than a page takes a row and has no place.

    It keeps the place in the row only.
    """

    def __init__(self, width: int, pad: int) -> None:
        self.width, self.pad = width, pad
        self.x = self.y = pad
        self.tall = 0

    def __call__(self, ws: list[int], hs: list[int]) -> tuple[list, ...]:
        x, y, tall, pad, width = self.x, self.y, self.tall, self.pad, self.width
        xs, ys, pages = [], [], []
        for w, h in zip(ws, hs, strict=True):
            end = x + w + pad
            if end > width:
                x, y, tall = pad, y + tall + pad, 0
                end = x + w + pad
            fits = end <= width
            xs.append(x if fits else None)
            ys.append(y if fits else None)
            pages.append(0 if fits else None)
            x = end
            if h > tall:
                tall = h
        self.x, self.y, self.tall = x, y, tall
        return xs, ys, pages


class FirstFit:
    """Things of a size into the first bank with room, in the partition's order; what is larger than a bank has one of its own. It keeps what each bank holds."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.used: list[int] = []

    def __call__(self, sizes: list[int]) -> tuple[list, ...]:
        used, found = self.used, []
        for n in sizes:
            bank = next((k for k, u in enumerate(used) if u + n <= self.capacity), len(used))
            if bank == len(used):
                used.append(0)
            used[bank] += n
            found.append(bank)
        return (found,)


def _runs(keys: list) -> list[tuple[int, int]]:
    """From and to of each run of one key; nulls are a key, and so are what isn't a number."""
    edges = [k for k in range(1, len(keys)) if not _same(keys[k], keys[k - 1])]
    return list(pairwise([0, *edges, len(keys)])) if keys else []


def _same(x: object, y: object) -> bool:
    return x == y or (x != x and y != y)


def folded(table: DataFrame, key: str, order: list[Column], start: Callable[[], Callable], columns: list[str], names: list[str]) -> DataFrame:
    """``table`` with whole numbers ``names``. Each ``key`` has a fold of its own, by ``start``, which takes the values of ``columns`` in order, some rows after others, and gives those of ``names``.

    A task holds one batch and one fold, whatever a key's number of rows.
    """
    schema = StructType(list(table.schema.fields))
    for name in columns:
        if name not in schema.names:
            raise ValueError(f"the table has no column {name}")
    for name in names:
        if name in schema.names:
            raise ValueError(f"the table has a column {name} already")
        schema = schema.add(name, LongType())
    at, places = table.columns.index(key), [table.columns.index(c) for c in columns]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, now = None, None
        for batch in batches:
            keys, values = batch.column(at).to_pylist(), [batch.column(k).to_pylist() for k in places]
            found: list[list] = [[] for _ in names]
            for a, b in _runs(keys):
                if fold is None or not _same(keys[a], now):
                    fold, now = start(), keys[a]
                for kept, more in zip(found, fold(*(v[a:b] for v in values)), strict=True):
                    kept += more
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, pa.int64()) for f in found)], [*batch.schema.names, *names])

    return table.repartition(F.col(key)).sortWithinPartitions(F.col(key), *order).mapInArrow(each, schema)


def row_packed(frames: DataFrame, key: str, order: str | Column, width: int = 256, pad: int = 1) -> DataFrame:
    """``frames`` with x, y and page by :class:`RowPacking`, a page for each ``key``."""
    return folded(frames, key, [F.col(order) if isinstance(order, str) else order], lambda: RowPacking(width, pad), ["w", "h"], ["x", "y", "page"])


def banked(sounds: DataFrame, key: str, order: str, capacity: int = 32_768, size: str = "bytes") -> DataFrame:
    """``sounds`` with bank by :class:`FirstFit`, the largest first."""
    return folded(sounds, key, [F.col(size).desc(), F.col(order)], lambda: FirstFit(capacity), [size], ["bank"])
