"""Property checks: totals agree across groupings, the growth rule does
not depend on row order or partitioning, document ids are unique."""

import datetime as dt
from decimal import Decimal

from hypothesis import given, settings, strategies as st

import __spark_entry__ as E
from tidewater.operators import insights as I

SF = "/root/testdata/sf0.001"


def test_regional_sum_equals_total(spark):
    reg = E.queries()["regional_sales"](spark, SF).agg({"total_sales_amount": "sum", "total_sales": "sum"}).first()
    sales = E.queries()["sales_unified"](spark, SF)
    assert abs(reg["sum(total_sales_amount)"] - sales.agg({"sales_amount": "sum"}).first()[0]) < 1e-6
    assert reg["sum(total_sales)"] == sales.count()


def test_document_ids_unique(spark):
    docs = E.queries()["docs_all"](spark, SF)
    assert docs.count() == docs.select("id").distinct().count()


def _ref_growth(values):
    if len(values) < 2:
        return 0.0
    h = len(values) // 2
    m1 = sum(values[:h]) / h
    m2 = sum(values[h:]) / (len(values) - h)
    return 0.0 if m1 == 0 else float((m2 - m1) / m1 * 100)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10_000), min_size=0, max_size=12),
       st.integers(min_value=1, max_value=5))
def test_growth_matches_rule_under_any_order(spark, cents, parts):
    rows = [(dt.datetime(2001, 1, 1) + dt.timedelta(days=i), Decimal(c) / 100) for i, c in enumerate(cents)]
    rows = rows[::-1]                              # row order must not matter
    schema = "sales_date timestamp_ntz, sales_amount decimal(18,2)"
    df = spark.createDataFrame(rows, schema).repartition(parts) \
        .selectExpr("*", "'C1' AS customer_id", "CAST(1 AS DECIMAL(18,2)) AS sales_quantity")
    got = I.growth(I.daily_sales(df)).first()
    want = _ref_growth([Decimal(c) / 100 for c in cents])
    assert abs(got.sales_growth_rate - want) <= 1e-9 * max(1.0, abs(want))
