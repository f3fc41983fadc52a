"""Every registered query against its SQL at the smallest scale."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tablewarden.plans.registry import TABLES
from tests.conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, Decimal):
        return float(value)
    return value


def table(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    order = sorted(df.columns)
    got = table([tuple(r) for r in df.collect()], df.columns, order)
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == order
    assert got == table(result.fetchall(), columns, order)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["table_name", "row_key", "matching_columns"] and df.count() > 0


def test_names():
    assert not [n for n in SQL if n not in QUERIES]
