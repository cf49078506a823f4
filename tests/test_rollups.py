"""Consolidation rules: precedence, zero quantities, one-source inputs,
the product price rule, line counts."""

from decimal import Decimal

from conftest import bw_rows, ecc_rows, empty, ts
from tidewater import schemas as S
from tidewater.operators import rollups as R

AS_OF = "2001-11-05"


def test_source_precedence_ecc_wins(spark):  # N3
    ecc = ecc_rows(spark, [dict(region="EAST", processed_date=ts("2001-01-01"))])
    bw = bw_rows(spark, [dict(region="WEST", processed_date=ts("2001-02-01"), customer_segment="AUTO")])
    c = R.build_customers(ecc, bw, as_of=AS_OF).first()
    assert c.region == "EAST" and c.customer_segment == "AUTO"


def test_precedence_falls_back_when_ecc_null(spark):  # N3 + N2
    ecc = ecc_rows(spark, [dict(region=None)])
    bw = bw_rows(spark, [dict(region="WEST")])
    assert R.build_customers(ecc, bw, as_of=AS_OF).first().region == "WEST"


def test_total_orders_counts_lines_bw_adds_zero(spark):  # B6
    ecc = ecc_rows(spark, [dict(order_number="O1"), dict(order_number="O1"), dict(order_number="O2")])
    bw = bw_rows(spark, [dict(), dict()])
    c = R.build_customers(ecc, bw, as_of=AS_OF).first()
    assert c.total_orders == 3 and c.total_sales_amount == Decimal("50.00")


def test_zero_quantity_gives_null_price(spark):  # N5
    bw = bw_rows(spark, [dict(sales_amount=10, sales_quantity=0), dict(sales_amount=10, sales_quantity=3)])
    prices = sorted((r.unit_price for r in R.bw_to_sales(bw).collect()), key=lambda x: (x is not None, x))
    assert prices == [None, Decimal("3.33")]


def test_one_source_empty(spark):  # B1
    ecc = ecc_rows(spark, [dict(region="EAST")])
    bw = bw_rows(spark, [dict(customer_segment="AUTO", product_category="BOLT")])
    for e, b in ((ecc, None), (None, bw), (ecc, empty(spark, S.RAW_BW)), (empty(spark, S.RAW_ECC), bw)):
        assert R.build_customers(e, b, as_of=AS_OF).count() == 1
        assert R.build_products(e, b, as_of=AS_OF).count() == 1
        assert R.unify_sales(e, b, as_of=AS_OF).count() == 1
    assert R.build_customers(ecc, None, as_of=AS_OF).first().customer_segment is None
    assert R.build_products(None, bw, as_of=AS_OF).first().unit_price == Decimal("0.00")
    both_empty = R.build_customers(empty(spark, S.RAW_ECC), empty(spark, S.RAW_BW), as_of=AS_OF)
    assert both_empty.count() == 0


def test_product_in_both_sources_price_modes(spark):  # B2
    ecc = ecc_rows(spark, [dict(unit_price=10)])
    bw = bw_rows(spark, [dict(product_category="BOLT")])
    ref = R.build_products(ecc, bw, as_of=AS_OF).first()
    own = R.build_products(ecc, bw, as_of=AS_OF, unit_price_mode="ecc_only").first()
    assert ref.unit_price == Decimal("5.00") and own.unit_price == Decimal("10.00")
    assert ref.product_category == "BOLT"
    assert ref.total_quantity_sold == Decimal("2.00")


def test_two_stage_equals_single_pass(spark):
    """The one-aggregation customer table equals the per-source roll-ups
    combined by hand."""
    ecc = ecc_rows(spark, [dict(customer_id="C1", total_amount=5, order_date=ts("2001-01-05")),
                           dict(customer_id="C2", total_amount=7)])
    bw = bw_rows(spark, [dict(customer_id="C1", sales_amount=3, sales_date=ts("2001-03-01"))])
    c = {r.customer_id: r for r in R.build_customers(ecc, bw, as_of=AS_OF).collect()}
    a1 = {r.customer_id: r for r in R.customer_rollup_ecc(ecc).collect()}
    a2 = {r.customer_id: r for r in R.customer_rollup_bw(bw).collect()}
    assert c["C1"].total_sales_amount == a1["C1"].total_sales_amount + a2["C1"].total_sales_amount
    assert c["C1"].last_order_date == max(a1["C1"].last_order_date, a2["C1"].last_order_date)
    assert c["C2"].total_sales_amount == a1["C2"].total_sales_amount


def test_partition_count_does_not_change_results(spark):
    rows = [dict(customer_id=f"C{i % 5}", region=("R" + str(i % 3)) if i % 4 else None,
                 processed_date=ts(f"2001-01-{1 + i % 20:02d}"), total_amount=i) for i in range(60)]
    ecc = ecc_rows(spark, rows)
    a = sorted(R.build_customers(ecc.repartition(1), None, as_of=AS_OF).collect())
    b = sorted(R.build_customers(ecc.repartition(7), None, as_of=AS_OF).collect())
    assert a == b
