"""Every registered query against its DuckDB oracle on the smallest tables,
plus the driver contract (entry, names, columns)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from tidewater.plans.catalog import QUERIES  # noqa: E402
from tidewater.plans.oracle import ORACLE_SQL  # noqa: E402
from oracle_check import TABLES, key, rows_of, type_diff  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["region", "total_sales", "unique_customers", "total_quantity_sold",
                          "total_sales_amount", "average_sale_amount"]
    assert df.count() > 0


def test_every_oracle_names_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 60


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    a, ca = rows_of(df.columns, df.collect())
    cur = con.execute(E.oracle_sql()[name])
    b, cb = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert ca == cb
    assert type_diff(df.dtypes, con.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()) == {}
    assert sorted(a, key=key) == sorted(b, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF).count() > 0
