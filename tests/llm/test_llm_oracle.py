"""The registered queries against their SQL on the smallest tables."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

from oracle_check import TABLES, key, rows_of, type_diff  # noqa: E402
from tidewater.llm.oracle import ORACLE_SQL  # noqa: E402
from tidewater.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    got, names = rows_of(df.columns, df.collect())
    cur = con.execute(ORACLE_SQL[name])
    want, wanted = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert names == wanted and type_diff(df.dtypes, con.execute(f"DESCRIBE {ORACLE_SQL[name]}").fetchall()) == {}
    assert sorted(got, key=key) == sorted(want, key=key)
