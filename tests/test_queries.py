"""Every registered query runs, and agrees with its SQL where it has some."""

import os

import pytest

import __spark_entry__
from poolwright.plans.oracle import ORACLE_SQL
from poolwright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region documents embeddings labels"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in row) for row in df.select(*columns).collect()]
    assert rows
    if name not in ORACLE_SQL:
        return
    found = sql.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in found.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_everything_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
