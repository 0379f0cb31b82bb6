"""Every query against its SQL counterpart on the driver's tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from helpers import SF

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _ordered(table):
    return sorted(table, key=lambda r: [(v is None, isinstance(v, str), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    got = df.collect()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = cursor.fetchall()
    order = sorted(columns)
    mine = _ordered([tuple(r[c] for c in order) for r in got])
    theirs = _ordered([tuple(r[columns.index(c)] for c in order) for r in wanted])
    assert mine == theirs


def test_entry(spark):
    assert [r["name"] for r in driver.entry(spark).collect()] == ["Artist 1", "Artist 3", "Artist 9", "Artist 6", "Artist 7"]


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
