from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import queries
from tesserae.llm.vector_codes import exponion, vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """Every part against every entry, in whole numbers."""
    kept = [(i, lab, [int(np.floor(4096 * float(x))) for x in v]) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    n = len(kept[0][2]) // parts
    first = sorted((i, v) for i, _, v in kept if i is not None)[:entries] or [min((v, v) for _, _, v in kept)]
    books = [[v[p * n : p * n + n] for _, v in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for left in range(rounds, -1, -1):
        found = [[near(p, v[p * n : p * n + n]) for p in range(parts)] for _, _, v in kept]
        if left:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [v[p * n : p * n + n] for (_, _, v), f in zip(kept, found, strict=True) if f[p][1] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    total: dict = {}
    for (_, lab, _), e in zip(kept, error, strict=True):
        total[lab] = total.get(lab, 0) + e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[lab], digest) for (i, lab, _), f, e in zip(kept, found, error, strict=True)), key=repr)


def found(df):
    return sorted([tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=repr)


def test_query_same_as_plain_and_sql(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = found(queries.op13_vector_codes(spark, sf_dir))
    assert got == plain([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    assert sorted(con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.ORACLE_SQL['op13_vector_codes']})").fetchall(), key=repr) == got


def test_exponion_is_exact():
    """Few values, so that many distances tie, and starts at every entry."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 7, 40):
        x, entries = rng.integers(-3, 4, (500, 4)), rng.integers(-3, 4, (size, 4))
        away = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        for start in range(size):
            index, best = exponion(x, entries, np.full(len(x), start))
            assert (index == away.argmin(axis=1)).all() and (best == away.min(axis=1)).all()


ODD = [
    (5, [0.5, -0.25, 1.0, 0.0], 1), (5, [0.5, -0.25, 1.0, 0.0], 1), (5, [0.5, -0.25, 1.0, 0.5], None), (None, [0.1, 0.2, -0.3, 0.4], None),
    (1, None, 2), (2, [], 2), (3, [float("nan"), 0.0, 0.0, 0.0], 2), (4, [float("inf"), 0.0, 0.0, 0.0], 2), (6, [None, 0.0, 0.0, 0.0], 2),
    (7, [-0.0001, 0.0001, -1.0, 3.0], 3), (-8, [0.0, 0.0, 0.0, 0.0], 3), (9, [0.0, 0.0, 0.0, 0.0], 3),
]


@pytest.mark.parametrize("entries", [1, 3, 16])
def test_odd_rows(spark, entries):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int")
    for name in ("code", "v", "x", "error", "none", "own", "label_error", "__salt", "place"):
        df = df.withColumn(name, F.lit("clash"))
    assert found(vector_codes(df, 2, entries, 3)) == plain(ODD, 2, entries, 3)
    assert vector_codes(df.limit(0), 2, entries, 3).count() == 0
    assert found(vector_codes(df.filter("vec_id is null"), 2, entries, 3)) == plain([r for r in ODD if r[0] is None], 2, entries, 3)


def test_hot_vector_and_string_labels(spark):
    rows = [(k, [0.5] * 4 if k % 3 else [k / 100, -k / 50, 0.1, 0.2], f"l{k % 4}") for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(7)
    rounded = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert found(vector_codes(df, 2, 5, 2)) == plain(rounded, 2, 5, 2)


def test_what_cannot_be_coded(spark):
    make = lambda *v: spark.createDataFrame([(k, x, 0) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    for df in (make([1.0, 2.0], [1.0]), make([1.0, 2.0, 3.0]), make([1e30, 1.0])):
        with pytest.raises(ValueError):
            vector_codes(df, 2)
