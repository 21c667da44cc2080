from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.llm import queries
from tesserae.llm.prefix_trie import COLUMNS, prefix_nodes

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """Dictionaries from whole prefixes to members, every node summed over all its descendants."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    ordered = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    members: dict = {}
    ends: dict = {}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(ordered.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends.get(p, [])))))) for p, m in members.items()), key=repr)


def found(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=repr)


def test_query_same_as_plain_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = found(queries.op12_prefix_trie(spark, sf_dir))
    assert got == plain(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op12_prefix_trie']})").fetchall(), key=repr) == got


def branching():
    """A first turn with most rows, a long common stretch, equal conversations, one much longer than the others, and ends inside the stretch."""
    rows = []
    for c in range(0, 400):
        stretch = [("user", "hello"), ("assistant", "hi"), ("user", "tell me more"), ("assistant", "of what?")]
        if c % 7 == 0:
            path = [("user", f"other {c % 3}")]
        elif c % 5 == 1:
            path = stretch[: 1 + c % 4]
        else:
            path = stretch + [("user", f"topic {c % 11}"), ("assistant", f"answer {c % 6}"), ("user", f"é{c % 2}")][: 1 + c % 3]
        rows += [(c, k, *t) for k, t in enumerate(path)]
    return rows + [(1002, k, "user", f"step {k // 2}") for k in range(120)] + [(1003, k, "user", f"step {k // 2}") for k in range(90)]


@pytest.mark.parametrize("limit", [1, 6, 50, 100_000])
def test_oversized_subtries(spark, limit):
    rows = branching()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(prefix_nodes(df, limit)) == plain(rows)


ODD = [
    (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (1, 2, "user", "long " * 50_000), (2, 1, None, "x"), (2, 1, "user", None), (None, 0, "user", "nobody"),
    (-3, 0, "user", "below zero"), (-3, 1, "user", "again"), (0, 5, "user", "below zero"), (7, None, "", ""), (9, 3, "user", "b"), (9, 3, "user", "a"), (9, 3, "assistant", "c"),
]


@pytest.mark.parametrize("limit", [1, 2048])
def test_odd_rows(spark, limit):
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("k", "h", "base", "path", "bytes", "n", "first", "ends", "top", "parent", "bucket", "digest", "depth", "__salt"):
        df = df.withColumn(name, F.lit("clash"))
    assert found(prefix_nodes(df, limit)) == plain(ODD)
    assert found(prefix_nodes(df.filter("conv_id is null"), limit)) == found(prefix_nodes(df.limit(0), limit)) == []
