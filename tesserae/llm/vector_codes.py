"""Vector code compression: a codebook for each part of the vectors, trained by Lloyd rounds whose assignments are Exponion searches on integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, spread_join, stored

#: Rows that are compared at once inside a task.
ROWS = 4096


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096) -> DataFrame:
    """vec_id, label and v (array<long>): ``floor(scale * x)`` of every component x.

    Rows whose vector is null, empty or holds null or non-finite components are dropped.
    """
    x = F.col("x")
    whole = F.size(x) > 0
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x")).filter(x.isNotNull()).filter(whole & finite)
    return rows.select("vec_id", "label", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def checked(rows: DataFrame, parts: int) -> int:
    """The common length of the vectors; an error where lengths differ, ``parts`` doesn't divide them, or exact distances could leave 64 bits. 0 without rows."""
    seen = rows.agg(F.min(F.size("v")).alias("short"), F.max(F.size("v")).alias("long"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    if seen.short is None:
        return 0
    if seen.short != seen.long or seen.short % parts:
        raise ValueError(f"vectors of {seen.short} to {seen.long} components; all must have one length that is a multiple of {parts}")
    if 16 * seen.short * (seen.most + 1) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {seen.most} after scaling: sums of squares may leave 64 bits")
    return seen.short


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ROWS rows with their vectors as a matrix; the vectors are the last column, as little-endian 32-bit integers."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            yield part, np.frombuffer(b"".join(part.column("v").to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def exponion(x: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of ``x`` the index of the nearest of ``entries`` and its squared distance; of equal distances the lower index.

    The search starts at the row's ``start`` entry, at distance u. By the triangle inequality an entry at distance u or less from the row lies
    within 2 u of the start entry, so the start entry's neighbours are scanned in the order of their distance and left at the first beyond
    that radius. Distances are squared integers: within 2 u means at most 4 u * u, without a root or rounding.
    """
    between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    near = np.argsort(between, axis=1, kind="stable")
    best, index = ((x - entries[start]) ** 2).sum(axis=1), start.copy()
    radius = 4 * best
    live = np.arange(len(x))
    for k in range(len(entries)):
        at = near[start[live], k]
        inside = between[start[live], at] <= radius[live]
        live, at = live[inside], at[inside]
        if not len(live):
            break
        away = ((x[live] - entries[at]) ** 2).sum(axis=1)
        better = (away < best[live]) | ((away == best[live]) & (at < index[live]))
        best[live[better]], index[live[better]] = away[better], at[better]
    return index, best


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, label, code, error, v) with code and error by the codebooks (part, entry, position); the searches start at the code before."""
    parts, _, length = books.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, parts * length):
            before = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            found = [exponion(x[:, p * length : (p + 1) * length], books[p], before[:, p]) for p in range(parts)]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield part.set_column(2, "code", pa.array([c.tobytes() for c in code], pa.binary())).set_column(3, "error", pa.array(error, pa.int64()))

    return rows.mapInArrow(each, rows.schema)


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry replaced by the floored mean of its parts. Tasks send a sum for each entry; (1 + length) * parts * entries numbers reach the driver."""
    parts, entries, length = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, 1 + length), np.int64)
        for part, x in blocks(batches, parts * length):
            code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                own = x[:, p * length : (p + 1) * length]
                for e in np.unique(code[:, p]):
                    mine = own[code[:, p] == e]
                    total[p, e, 0] += len(mine)
                    total[p, e, 1:] += mine.sum(axis=0)
        place = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], ["place", "value"])

    found = [[0] * (1 + length) for _ in range(parts * entries)]
    for r in rows.select("code", "v").mapInArrow(sums, "place long, value long").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        found[r.place // (1 + length)][r.place % (1 + length)] = int(r.value)
    out = books.reshape(-1, length).copy()
    for k, (count, *total) in enumerate(found):
        if count:
            out[k] = [s // count for s in total]
    return out.reshape(books.shape)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096) -> DataFrame:
    """One row per kept input row: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Components become integers by ``floor(scale * x)``; vectors are cut into ``parts`` equal parts, each with a codebook that starts as that
    part of the vectors of the ``entries`` smallest ids. In each of ``rounds`` rounds all parts go to their nearest entry (exact squared
    distances, ties to the lower index), found by :func:`exponion` from the entry of the round before, and every used entry moves to the
    floored mean of its parts. Then the parts are assigned once more. ``error`` sums a vector's squared distances, ``label_error`` sums
    ``error`` over equal labels, null labels being equal.

    Vectors and their last codes are a table of the shared folder that each round writes anew, so a lost executor costs its tasks only; the
    table of the round before is deleted. Codebooks and their sums are the only things that pass the driver. Null, empty and non-finite
    vectors are dropped; a null id is carried and never starts an entry; rows repeated under one id are coded each, and their vectors order
    them; with fewer rows than ``entries`` the codebooks are that much smaller. Lengths that differ or that ``parts`` doesn't divide, and
    components too large for exact 64-bit sums, are errors. An empty table gives an empty result. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: entries must be between 1 and 256")
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, label_col, scale)
    width = checked(rows, parts)
    if not width:
        return _empty(spark, rows)
    length = width // parts
    first = rows.filter("vec_id is not null").select("vec_id", "v").orderBy("vec_id", "v").limit(entries).collect()
    if not first:
        first = rows.select("vec_id", "v").orderBy("v").limit(1).collect()  # rows without any id: one entry, so that codes exist
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, length).transpose(1, 0, 2)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype("<i4").reshape(-1, width)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(parts)] * n, pa.binary()), pa.array(np.zeros(n, np.int64)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "label", "code", "error", "v"])

    kind = rows.schema["label"].dataType.simpleString()
    now = stored(assigned(rows.mapInArrow(packed, f"vec_id long, label {kind}, code binary, error long, v binary"), books), "vector-codes")
    for _ in range(rounds):
        books = updated(now, books)
        before, now = now, stored(assigned(now, books), "vector-codes")
        dropped(before)
    text = ",".join(map(str, books.ravel().tolist()))
    label = [F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("own")]
    out = now.select("vec_id", "code", "error", *label)
    by_label = out.groupBy("none", "own").agg(F.sum("error").alias("label_error"))
    joined = spread_join(out, by_label, ["none", "own"], F.xxhash64("vec_id", "code", "error"))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _empty(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256")).limit(0)


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same over ``embeddings``, every part tried against every entry."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, [CAST(floor({scale}.0 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
        f"pieces AS MATERIALIZED (SELECT row, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))",
        f"first AS (SELECT row, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept WHERE vec_id IS NOT NULL QUALIFY e < {entries})",
        "book0 AS MATERIALIZED (SELECT p, e, x FROM pieces JOIN first USING (row))",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT row, a.p, any_value(a.x) AS x, min(list_sum([(d[1] - d[2]) * (d[1] - d[2]) FOR d IN list_zip(a.x, b.x)])) AS away,
            arg_min(e, struct_pack(d := list_sum([(d[1] - d[2]) * (d[1] - d[2]) FOR d IN list_zip(a.x, b.x)]), e := e)) AS e FROM pieces a JOIN book{k} b ON a.p = b.p GROUP BY row, a.p)""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS x
                FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM near{k}, range(1, 4096) t(i) WHERE i <= len(x) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    steps.append(f"coded AS (SELECT row, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error FROM near{rounds} GROUP BY row)")
    steps.append(f"whole AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), whole"
