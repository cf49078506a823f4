"""A key holding a third of the rows: results stay right and the plans
split the hot key instead of sending it to one task."""

import contextlib
import io
from decimal import Decimal

import pytest

from tidewater import schemas as S
from tidewater.operators import queries as Q

from conftest import ts

AS_OF = ts("2001-11-05")


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.fixture()
def skewed(spark):
    n = 30000
    rows = [dict(customer_id="HOT" if i % 3 == 0 else f"C{i % 997}", product_code=f"P{i % 50}",
                 order_number=f"O{i}", sales_date=ts(f"2001-{1 + i % 12:02d}-01"),
                 sales_amount=Decimal("1.00"), sales_quantity=Decimal("1.00"), unit_price=None,
                 region="R", channel=None, sales_rep=None, data_source="SAP_ECC",
                 created_date=AS_OF, is_active=True, processed_date=None) for i in range(n)]
    sales = spark.createDataFrame(rows, S.SALES).repartition(8)
    cust = spark.createDataFrame(
        [dict(customer_id=c, customer_name=None, customer_segment="S", region="R", sales_rep=None,
              total_orders=1, total_sales_amount=Decimal("1.00"), last_order_date=None,
              created_date=AS_OF, updated_date=AS_OF, is_active=True)
         for c in ["HOT"] + [f"C{i}" for i in range(997)]], S.CUSTOMERS)
    prod = spark.createDataFrame(
        [dict(product_code=f"P{i}", product_name=None, product_category="K", unit_price=None,
              total_quantity_sold=Decimal("1.00"), total_sales_amount=Decimal("1.00"),
              created_date=AS_OF, updated_date=AS_OF, is_active=True) for i in range(50)], S.PRODUCTS)
    return sales, cust, prod


def test_hot_customer_join_is_split(spark, skewed):
    sales, cust, prod = skewed
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = Q.sales_enriched(sales, cust, prod)
        assert df.count() == 30000
        assert df.where("customer_id = 'HOT' AND customer_segment = 'S'").count() == 10000
        df.collect()
        assert "SortMergeJoin(skew=true)" in _plan(df)   # AQE split the hot customer
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_customer_aggregations(spark, skewed):
    sales, cust, prod = skewed
    top = Q.top_customers(sales, cust, limit=1).first()
    assert top.customer_id == "HOT" and top.total_orders == 10000
    latest = Q.latest_orders_per_customer(sales, prod, limit=3)
    assert latest.where("customer_id = 'HOT'").count() == 3
    assert "WindowGroupLimit" in _plan(latest)


def test_batch_lookup_dedupes_hot_ids(spark, skewed):
    sales, cust, _ = skewed
    df = Q.customer_lookup(cust, sales.select("customer_id"))
    assert df.count() == 998
    plan = _plan(df)
    assert "HashAggregate(keys=[customer_id" in plan    # ids reduced before the join
