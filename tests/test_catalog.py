"""Every query against its SQL on the small tables, and the contract of the entry module."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tesserae.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(map(plain, r))) for r in want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalog.QUERIES) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_but_the_entry_knows_the_subpackage():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for p in glob.glob(f"{root}/tesserae/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            assert "llm" not in open(p).read(), p


def test_instruction_set():
    """Both tables of the instruction set agree and hold all 56 instructions."""
    from tesserae.operators.rules import CYCLES
    from tesserae.plans.rules import _CYCLES

    assert len(CYCLES) == 56 and {f"('{o}', '{m}', {n})" for o, modes in CYCLES.items() for m, n in modes.items()} == set(_CYCLES.replace("), (", ")|(").split("|"))
