"""Every registered query against its checking SQL on the smallest data set."""

import math
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from fleetgauge.plans.bindings import TABLES

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def check():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(columns, data):
    place = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(row[p]) for p in place) for row in data), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, check):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in CHECKS:
        assert got
        return
    cursor = check.execute(CHECKS[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, got) == table(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).limit(1).collect()


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
