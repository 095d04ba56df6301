from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def cell(v):
    return "NULL" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(tuple(cell(r[c]) for c in names) for r in got.collect()) == sorted(tuple(cell(r[at[c]]) for c in names) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    assert entry.entry(spark).count() == 20
