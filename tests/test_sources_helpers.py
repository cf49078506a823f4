"""CSV sources, quantile selection, grouped rows, display helpers."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.quantile import exact_quantile
from tidewater.operators import helpers as H
from tidewater.sources import tables as T


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_full_header(spark, tmp):  # S2 + K2
    _write(f"{tmp}/bw/2024/01/a.csv",
           "CustomerID,ProductCode,SalesAmount,SalesQuantity,SalesDate,SalesRep,Region,Channel,"
           "ProductCategory,CustomerSegment,ProcessedDate\n"
           "C1,P1,10.00,2,2001-01-01 00:00:00,R1,ASIA,1-URGENT,BOLT,AUTO,2001-01-02 00:00:00\n")
    _write(f"{tmp}/bw/notes.txt", "ignored")
    r = T.read_raw_csv(spark, f"{tmp}/bw", "bw").first()
    assert (r.customer_id, r.region, r.data_source, r.is_active, r.is_deleted) == ("C1", "ASIA", "SAP_BW", True, False)
    assert r.id is not None and r.validation_errors is None


def test_csv_eight_column_layout_with_rename(spark, tmp):  # B12
    _write(f"{tmp}/x/a.csv",
           "Customer,Order,Product,Sales Amount,Sales Quantity,Sales Date,Region,Rep\n"
           "C1,O1,P1,10.5,1,2001-01-01 00:00:00,EU,R9\n")
    rename = {"Customer": "customer_id", "Order": "order_number", "Product": "product_code",
              "Sales Amount": "total_amount", "Sales Quantity": "quantity", "Sales Date": "order_date",
              "Rep": "sales_rep"}
    r = T.read_raw_csv(spark, f"{tmp}/x", "ecc", rename=rename, as_of="2001-01-05").first()
    assert float(r.total_amount) == 10.5 and r.sales_rep == "R9" and r.unit_price is None
    assert str(r.processed_date) == "2001-01-05 00:00:00"


def test_csv_malformed_amount(spark, tmp):  # fixture (c)
    _write(f"{tmp}/y/a.csv", "CustomerID,ProductCode,SalesAmount,SalesQuantity,SalesDate\n"
                             "C1,P1,abc,1,2001-01-01 00:00:00\n")
    r = T.read_raw_csv(spark, f"{tmp}/y", "bw").first()
    assert r.sales_amount is None and r.validation_errors == "bad sales_amount"


@pytest.mark.parametrize("p", [0.0, 0.37, 0.8, 1.0])
def test_exact_quantile_matches_numpy(spark, p):
    rnd = random.Random(7)
    vals = [round(rnd.uniform(-1000, 1000), 2) for _ in range(3000)] + [500.0] * 1000
    df = spark.createDataFrame([(f"{v:.2f}",) for v in vals] + [(None,)], "v string").selectExpr("cast(v as decimal(28,2)) v").repartition(5)
    q = exact_quantile(df, "v", p).first().q
    assert q == pytest.approx(float(np.quantile(np.array(vals), p)), abs=1e-9)


def test_exact_quantile_heavy_repeats(spark):
    df = spark.createDataFrame([(1,)] * 3000 + [(2,)] * 10, "v int").selectExpr("cast(v as decimal(10,2)) v")
    assert exact_quantile(df, "v", 0.5).first().q == 1.0
    assert exact_quantile(df.limit(0), "v", 0.5).first().q is None and exact_quantile(df.limit(1), "v", 0.5).first().q == 1.0


def test_group_rows_splits_hot_key(spark):  # A27 with a hot key
    rows = [("HOT" if i % 3 else None, f"C{i}", "P1", float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "region string, customer_id string, product_code string, sales_amount double")
    g = H.rows_by_region(df, parts=16)
    got = sorted((r.region, x.customer_id, x.product_code, x.sales_amount) for r in g.collect() for x in r.rows)
    assert got == sorted((r or "Unknown", c, p, a) for r, c, p, a in rows)
    assert {x.region for r in g.collect() for x in r.rows} == {"HOT", None}     # nested rows keep their own value
    assert g.agg(F.max(F.size("rows"))).first()[0] < 250


def test_group_rows_nests_after_the_shuffle(spark):  # rows are sent plain and once, whatever tasks hold of a key
    df = spark.createDataFrame([("A" if i % 3 else "", f"C{i % 5}", i) for i in range(300)], "region string, customer_id string, n int")
    for g, key in ((H.rows_by_region(df, parts=4), "region"), (H.rows_by_customer(df, parts=4), "customer_id")):
        plan = g._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("partial_collect_list") < plan.index("Exchange")
        got = g.collect()
        assert len({(r[key], r.chunk) for r in got}) == len(got) <= 4 * 5
        assert sorted(x.n for r in got for x in r.rows) == list(range(300))
        assert all((x[key] or "Unknown") == r[key] for r in got for x in r.rows)


def test_csv_columns_go_by_name(spark, tmp):  # S1: other order, missing and own error columns
    _write(f"{tmp}/n/a.csv", "CustomerID,ProductCode,SalesAmount,SalesQuantity,SalesDate\nC1,P1,10,1,2001-01-01 00:00:00\n")
    _write(f"{tmp}/n/d/b.csv", "SalesQuantity,SalesDate,CustomerID,SalesAmount,ProductCode,ValidationErrors\n2,2001-01-02 00:00:00,C2,x,P2,own\n")
    _write(f"{tmp}/n/c.csv", "ProductCode,CustomerID,SalesAmount,SalesQuantity\nP3,C3,30,-3\n")
    rows = {r.customer_id: r for r in T.read_raw_csv(spark, f"{tmp}/n", "bw").collect()}
    assert (rows["C1"].product_code, float(rows["C1"].sales_amount), float(rows["C1"].sales_quantity)) == ("P1", 10, 1)
    assert rows["C2"].sales_amount is None and rows["C2"].validation_errors == "own;bad sales_amount"
    assert rows["C3"].product_code == "P3" and all(r.processed_date is not None for r in rows.values())
    good, bad = T.split_valid(T.read_raw_csv(spark, f"{tmp}/n", "bw"), "bw")
    assert [r.customer_id for r in good.collect()] == ["C1"]
    assert {r.customer_id: r.validation_errors for r in bad.collect()} == {
        "C2": "own;bad sales_amount;missing sales_amount", "C3": "missing sales_date;negative sales_quantity"}


def test_set_totals_empty(spark):  # A24/A25
    df = spark.createDataFrame([], "sales_amount decimal(18,2)")
    r = H.set_totals(df).first()
    assert (r.rows, r.total_sales, r.average_order_value) == (0, 0.0, 0.0)


def test_display_and_dates(spark):  # E14 / E15
    import datetime as dt
    from decimal import Decimal
    df = spark.createDataFrame([("C1", "P1", None, dt.datetime(2024, 1, 2, 13, 5), Decimal("1234.50"), Decimal("1234.00"))],
                               "customer_id string, product_code string, order_number string, sales_date timestamp_ntz, "
                               "sales_amount decimal(18,2), sales_quantity decimal(18,2)")
    r = H.display_rows(df).first()
    assert (r.amount_text, r.quantity_text, r.date_text, r.datetime_text) == \
        ("$1,234.50", "1,234", "Jan 2, 2024", "Jan 2, 2024, 01:05 PM")
    assert H.current_date("2001-11-05") == "2001-11-05"
    assert H.date_range("2001-11-05", 0) == {"startDate": "2001-10-06", "endDate": "2001-11-05"}


def test_observed_count(spark, tmp):  # A29
    df, obs = H.observed_count(spark.range(42), "rows")
    df.write.parquet(f"{tmp}/o")
    assert obs.get["rows"] == 42


def test_case_insensitive_collation(spark):  # N13
    from decimal import Decimal
    from tidewater.operators import queries as Q
    rows = [("C1", "East", Decimal("1.00")), ("C2", "EAST ", Decimal("2.00")), ("C3", "West", Decimal("4.00"))]
    s = spark.createDataFrame(rows, "customer_id string, region string, sales_amount decimal(18,2)") \
        .selectExpr("*", "true AS is_active", "CAST(1 AS DECIMAL(18,2)) AS sales_quantity",
                    "timestamp_ntz'2001-01-01' AS sales_date")
    assert Q.regional_sales(s).count() == 3
    ci = Q.regional_sales(s, collation="UTF8_LCASE_RTRIM").collect()
    assert sorted(r.total_sales for r in ci) == [1, 2]
    from tidewater.functions import exprs as X
    assert s.where(X.sales_filter(region="east", collation="UTF8_LCASE_RTRIM")).count() == 2


def test_api_catalogue(spark):  # §2.13
    import json
    from tidewater.plans import api
    t = api.Tables.from_store(spark, "/root/testdata/sf0.001", "2001-11-05")
    top = api.call(t, "GetTopCustomers", limit=3).collect()
    assert len(top) == 3 and "total_sales_amount" in json.loads(top[0].json)
    assert api.call(t, "GetDateRange", days=7) == {"startDate": "2001-10-29", "endDate": "2001-11-05"}
    assert api.call(t, "GetSalesData", region="ASIA", start_date="", end_date=None).count() > 0
    assert api.call(t, "GetSalesRepPerformance").count() > 0


def test_rebuild_documents_counts(spark, tmp):  # K11
    from tidewater.plans import api
    from tidewater.sources import sinks as K
    t = api.Tables.from_store(spark, "/root/testdata/sf0.001", "2001-11-05")
    v, n = K.rebuild_documents(t.customers, t.sales, t.products, tmp + "/docs", as_of=t.as_of)
    assert v == 1 and n == K.read_current(spark, tmp + "/docs").count() > 0


def test_sizing():
    from tidewater.session import sizing
    big = sizing(100 * 10**12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) > 300_000
    assert big["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
    small = sizing(10 << 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
