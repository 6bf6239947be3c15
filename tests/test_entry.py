"""The driver contract: every query runs, and those with SQL agree with it."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda names: [names.index(c) for c in sorted(names)]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    pick = lambda table, names: sorted((tuple(r[k] for k in order(names)) for r in table), key=key)
    assert pick(rows, df.columns) == pick(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
