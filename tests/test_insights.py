"""Insight reports: growth rule, retention, rounding order, summaries."""

import datetime as dt
from decimal import Decimal

import pytest

from conftest import ts
from tidewater.operators import insights as I

SCAN = ("customer_id string, product_code string, sales_date timestamp_ntz, sales_amount decimal(18,2), "
        "sales_quantity decimal(18,2), unit_price decimal(18,2), region string, channel string, "
        "sales_rep string, data_source string, customer_segment string, product_category string")


def scan(spark, rows):
    full = []
    for r in rows:
        x = dict(customer_id="C1", product_code="P1", sales_date=ts("2001-01-01"), sales_amount=Decimal("1.00"),
                 sales_quantity=Decimal("1.00"), unit_price=Decimal("1.00"), region=None, channel=None,
                 sales_rep=None, data_source="SAP_ECC", customer_segment=None, product_category=None)
        x.update(r)
        full.append(x)
    return spark.createDataFrame(full, SCAN)


def _growth(spark, totals):
    rows = [dict(sales_date=dt.datetime(2001, 1, 1) + dt.timedelta(days=i), sales_amount=Decimal(str(t)))
            for i, t in enumerate(totals)]
    if not rows:
        return I.growth(I.daily_sales(scan(spark, [dict()]).limit(0))).first()
    return I.growth(I.daily_sales(scan(spark, rows))).first()


def reference_growth(values):
    if len(values) < 2:
        return 0.0
    h = len(values) // 2
    m1 = sum(values[:h]) / h
    m2 = sum(values[h:]) / (len(values) - h)
    return 0.0 if m1 == 0 else (m2 - m1) / m1 * 100


@pytest.mark.parametrize("totals", [[5], [1, 3], [1, 2, 4], [2, 2, 4, 8, 16], [0, 0, 5]])
def test_growth_rule(spark, totals):  # A13: 0,1,2,3,5 days; zero first half
    r = _growth(spark, totals)
    assert r.n_days == len(totals)
    assert r.sales_growth_rate == pytest.approx(reference_growth(totals))


def test_growth_zero_days(spark):
    assert _growth(spark, []).sales_growth_rate == 0.0


def test_growth_is_not_ntile(spark):  # odd count: first half is n div 2 days
    assert _growth(spark, [1, 1, 4]).sales_growth_rate == pytest.approx(150.0)


def test_retention_recent_and_returning(spark):  # A16, B3
    s = scan(spark, [dict(customer_id="C1", sales_date=ts("2001-10-29 08:00:00")),
                     dict(customer_id="C1", sales_date=ts("2001-10-01")),
                     dict(customer_id="C2", sales_date=ts("2001-10-28 23:00:00"))])
    r = I.retention(I.customer_analysis(s), as_of="2001-11-05 10:00:00").first()
    assert (r.total_customers, r.recent_customers, r.returning_customers) == (2, 1, 1)
    assert r.customer_retention_rate == 50.0


def test_segment_mean_of_rounded_means(spark):  # B8
    s = scan(spark, [dict(customer_id="C1", customer_segment="A", sales_amount=Decimal("1.00")),
                     dict(customer_id="C1", customer_segment="A", sales_amount=Decimal("0.01")),
                     dict(customer_id="C2", customer_segment="A", sales_amount=Decimal("0.02"))])
    cust = I.customer_analysis(s)
    aov = {r.customer_id: r.avg_order_value for r in cust.collect()}
    assert aov == {"C1": Decimal("0.50"), "C2": Decimal("0.02")}     # 0.505 -> 0.50 (half even)
    seg = I.segment_analysis(cust).first()
    assert seg.avg_order_value == Decimal("0.26")                      # mean(0.50, 0.02)
    assert seg.customer_count == 2


def test_null_keys_dropped_in_reports(spark):  # N1
    s = scan(spark, [dict(region=None, sales_rep=None), dict(region="EAST", sales_rep="R1")])
    assert [r.region for r in I.region_analysis(s).collect()] == ["EAST"]
    assert [r.sales_rep for r in I.rep_analysis(s).collect()] == ["R1"]


def test_best_region_tie_takes_first_key(spark):  # O6
    s = scan(spark, [dict(region="B", sales_amount=Decimal("5.00")),
                     dict(region="A", sales_amount=Decimal("5.00")),
                     dict(region="C", sales_amount=Decimal("1.00"))])
    r = I.region_summary(I.region_analysis(s)).first()
    assert r.best_performing_region == "A" and r.total_regions == 3
    assert r.average_sales_per_region == pytest.approx(11 / 3)


def test_product_summary_above_p80(spark):  # A19 / F8
    s = scan(spark, [dict(product_code=f"P{i}", sales_amount=Decimal(v))
                     for i, v in enumerate(["1.00", "2.00", "3.00", "10.00"])])
    r = I.product_summary(I.product_analysis(s)).first()
    assert (r.total_products, r.high_performing_products) == (4, 1)
    assert r.product_diversity_score == 25.0


def test_all_insights_rows(spark):  # A30
    from conftest import bw_rows, ecc_rows
    from tidewater.operators import rollups as R
    ecc = ecc_rows(spark, [dict(customer_id="C1", region="EAST", sales_rep="R1", order_date=ts("2001-11-01"))])
    bw = bw_rows(spark, [dict(customer_id="C2", region="WEST", sales_rep="R2", customer_segment="AUTO",
                              product_category="BOLT", sales_date=ts("2001-10-20"))])
    sales = R.unify_sales(ecc, bw, as_of="2001-11-05")
    cust = R.build_customers(ecc, bw, as_of="2001-11-05")
    prod = R.build_products(ecc, bw, as_of="2001-11-05")
    rows = I.all_insights(sales, cust, prod, as_of="2001-11-05", days=30).collect()
    types = sorted(r.insight_type for r in rows)
    for t in ("sales_trends", "customer_insights", "product_insights", "regional_insights", "sales_rep_insights"):
        assert t in types
    assert sum(t == "regional_insights.regional_distribution" for t in types) == 2


def test_report_fields(spark):  # A12/A16/A19/A21/A23 field names of the JSON rows
    import json
    from conftest import bw_rows, ecc_rows
    from tidewater.operators import rollups as R
    ecc = ecc_rows(spark, [dict(customer_id="C1", region="EAST", sales_rep="R1", order_date=ts("2001-11-01"))])
    bw = bw_rows(spark, [dict(customer_id="C2", region="WEST", sales_rep="R2", customer_segment="AUTO",
                              product_category="BOLT", sales_date=ts("2001-10-20"))])
    rows = I.all_insights(R.unify_sales(ecc, bw, as_of="2001-11-05"), R.build_customers(ecc, bw, as_of="2001-11-05"),
                          R.build_products(ecc, bw, as_of="2001-11-05"), as_of="2001-11-05", days=30).collect()
    got = {r.insight_type: set(json.loads(r.insight_data)) for r in rows if "." not in r.insight_type}
    assert {"total_sales", "average_daily_sales", "sales_growth_rate", "top_performing_days",
            "total_unique_customers", "average_daily_customers"} <= got["sales_trends"]
    assert {"total_customers", "top_customers", "recent_customers", "returning_customers",
            "customer_retention_rate"} <= got["customer_insights"]
    assert {"total_products", "top_products", "high_performing_products",
            "product_diversity_score"} <= got["product_insights"]
    assert {"total_regions", "top_regions", "average_sales_per_region", "best_performing_region",
            "best_region_sales"} <= got["regional_insights"]
    assert {"total_sales_reps", "top_sales_reps", "average_sales_per_rep", "top_performing_rep",
            "top_rep_sales"} <= got["sales_rep_insights"]
    parts = {r.insight_type for r in rows if "." in r.insight_type}
    assert parts == {"customer_insights.segment_analysis", "product_insights.category_analysis",
                     "regional_insights.regional_distribution", "sales_rep_insights.rep_performance_distribution"}


def test_trends_read_the_scan_once(spark):  # days and customers from one pass; rows without a day or customer keep counting
    rows = [("C1", "2001-01-01", 10), ("C1", "2001-01-01", 5), ("C2", "2001-01-02", 20), (None, "2001-01-02", 1), ("C1", None, 4), ("C3", "2001-01-03", None)]
    scan = spark.createDataFrame([(c, t and ts(t), a) for c, t, a in rows], "customer_id string, sales_date timestamp_ntz, a int").selectExpr(
        "customer_id", "sales_date", "cast(a as decimal(18,2)) sales_amount", "cast(1 as decimal(18,2)) sales_quantity")
    got = I.sales_trends(scan)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    r = got.first()
    assert (r.days, r.total_sales, r.total_unique_customers, r.distinct_customers) == (4, 40.0, 4, 3)
    none = I.sales_trends(scan.limit(0)).first()
    assert (none.days, none.total_sales, none.distinct_customers) == (0, None, 0)
