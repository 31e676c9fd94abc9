"""The registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from sheaf import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, db, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    found = db.execute(core.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert mine == sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(core.SQL) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())
