"""Every query against its SQL on the smallest tables, and all without SQL run."""

import glob
import os

import duckdb
import pytest

from quire.plans import document_queries, join_queries, page_queries, region_queries, table_queries, text_queries  # noqa: F401  they add their queries
from quire.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "null" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([cell(x) for x in v])
    return str(int(v)) if isinstance(v, bool) else f"{float(v):.9g}" if not isinstance(v, str) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    sql = con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    expected = sql.fetchall()
    assert expected, "a query without rows shows nothing"
    assert rows(df.columns, got) == rows(sql.columns, expected)
