"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

from evflow.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("EVFLOW_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if v is not None and not isinstance(v, (int, str, bool)):
        return float(v)
    return v


def order(row):
    return tuple((v is None, isinstance(v, str), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    cur = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=order)
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def against_sql_on(spark, folder, name, views):
    """A query and its SQL over some rows of the tables: ``views`` maps a table to the SQL of its rows."""
    import duckdb

    con = duckdb.connect()
    for t, rows in views.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cur = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()), key=order)
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=order) == want
    return want


def test_vertexing_table_of_a_customer_without_lines(spark, tmp_path):
    """One customer has lines, one of them twice but for its quantity; the other has none: nothing is filled."""
    lines = "SELECT * REPLACE (1 AS l_orderkey, 1 AS l_linenumber, 5 AS l_partkey, 10.0::DOUBLE AS l_extendedprice, (9 - i)::DOUBLE AS l_quantity)"
    views = {
        "customer": f"SELECT * REPLACE (i AS c_custkey) FROM (FROM '{DATA}/customer.parquet' LIMIT 1), range(2) r(i)",
        "orders": f"SELECT * REPLACE (1::BIGINT AS o_orderkey, 0::BIGINT AS o_custkey) FROM '{DATA}/orders.parquet' LIMIT 1",
        "lineitem": f"SELECT * EXCLUDE (i) FROM ({lines}, i FROM (FROM '{DATA}/lineitem.parquet' LIMIT 1), range(6) r(i))",
    }
    got = against_sql_on(spark, tmp_path, "b10_vertexing_table", views)
    assert [r[:4] for r in got] == [(0, 4, 4.0, 7.0), (1, 0, 0.0, 0.0)]


def test_errors_on_half_a_digit_are_the_sqls(spark, tmp_path):
    """Prices for which an error of d0 lies between two numbers of six digits."""
    prices = ", ".join(f"({k}, {k * 10 + 5 + k % 7 * 20})" for k in range(3000, 4000))
    views = {
        "orders": f"SELECT x.* REPLACE (k::BIGINT AS o_orderkey, (c * 1.0 + k % 100 / 100.0)::DOUBLE AS o_totalprice) FROM (FROM '{DATA}/orders.parquet' LIMIT 1) x, (VALUES {prices}) v(k, c)",
        "lineitem": f"SELECT * FROM '{DATA}/lineitem.parquet' LIMIT 5",
    }
    against_sql_on(spark, tmp_path, "b15_refit_trajectory", views)
