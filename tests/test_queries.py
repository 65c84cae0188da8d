"""Every query of the core runs on rough and on empty tables, and equals its SQL on the small ones."""

from __future__ import annotations

import datetime as dt
import glob
import importlib
import os

import duckdb
import pytest

from conftest import SMALL

CATALOGUES = ["snapshot", "retrieval", "document", "value", "record"]
MODULES = [importlib.import_module(f"lodestack.plans.{n}_queries") for n in CATALOGUES]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.ORACLE_SQL.items()}


def plain(x):
    return round(x, 6) if isinstance(x, float) else x.isoformat() if isinstance(x, dt.date) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    out = duck.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rough_tables(spark, rough_tables, name):
    QUERIES[name](spark, rough_tables).collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_tables, name):
    QUERIES[name](spark, empty_tables).collect()


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
