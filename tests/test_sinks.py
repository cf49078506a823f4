"""Upserts, idempotent loads, versioned publishing, document files."""

import json
import os
from decimal import Decimal

from conftest import bw_rows, ecc_rows, ts
from tidewater.operators import rollups as R
from tidewater.sources import sinks as K


def _customers(spark, as_of, rows):
    return R.build_customers(ecc_rows(spark, rows), None, as_of=as_of)


def test_upsert_matched_new_and_untouched(spark):  # K3
    old = _customers(spark, "2001-01-01", [dict(customer_id="C1", region="EAST"),
                                           dict(customer_id="C2", region="WEST")])
    new = _customers(spark, "2001-02-01", [dict(customer_id="C1", region="NORTH", total_amount=99),
                                           dict(customer_id="C3", region="SOUTH")])
    out = {r.customer_id: r for r in K.upsert_customers(old, new, as_of="2001-02-01").collect()}
    assert set(out) == {"C1", "C2", "C3"}
    assert out["C1"].region == "NORTH" and out["C1"].total_sales_amount == Decimal("99.00")
    assert out["C1"].created_date == ts("2001-01-01") and out["C1"].updated_date == ts("2001-02-01")
    assert out["C2"].region == "WEST" and out["C2"].updated_date == ts("2001-01-01")
    assert out["C3"].created_date == ts("2001-02-01") and out["C3"].is_active


def test_upsert_twice_equals_once(spark):
    old = _customers(spark, "2001-01-01", [dict(customer_id="C1"), dict(customer_id="C2")])
    new = _customers(spark, "2001-02-01", [dict(customer_id="C2", region="X"), dict(customer_id="C3")])
    once = K.upsert_customers(old, new, as_of="2001-02-01")
    twice = K.upsert_customers(once, new, as_of="2001-02-01")
    assert sorted(once.collect()) == sorted(twice.collect())


def test_upsert_products_into_nothing(spark):  # K4
    p = R.build_products(ecc_rows(spark, [dict()]), bw_rows(spark, [dict()]), as_of="2001-01-01")
    out = K.upsert_products(None, p, as_of="2001-01-01").collect()
    assert len(out) == 1 and out[0].unit_price == Decimal("5.00")


def test_replace_window_is_idempotent(spark):  # K5 / B4
    ecc = ecc_rows(spark, [dict(order_number=f"O{i}", processed_date=ts(f"2001-01-{i + 1:02d}"))
                           for i in range(10)])
    sales = R.unify_sales(ecc, None, as_of="2001-01-11")
    window = sales.where("processed_date >= timestamp_ntz'2001-01-08'")
    appended_twice = sales.unionByName(window)
    assert appended_twice.count() == 13
    fixed = K.replace_window(appended_twice, window, start="2001-01-08")
    again = K.replace_window(fixed, window, start="2001-01-08")
    assert sorted(fixed.collect()) == sorted(sales.collect()) == sorted(again.collect())


def test_write_sales_replace_window_files(spark, tmp):  # K5 on files
    ecc = ecc_rows(spark, [dict(order_number=f"O{i}", processed_date=ts(f"2001-01-{i + 1:02d}"))
                           for i in range(10)])
    sales = R.unify_sales(ecc, None, as_of="2001-01-11")
    path = os.path.join(tmp, "sales")
    K.write_sales(sales, path, mode="append")
    window = sales.where("processed_date >= timestamp_ntz'2001-01-08'")
    K.write_sales(window, path, mode="replace_window", start="2001-01-08")
    K.write_sales(window, path, mode="replace_window", start="2001-01-08")
    assert K.read_sales(spark, path).count() == 10


def test_replace_window_edges(spark, tmp):  # K5: any hour, vanished rows, months
    at = ["2001-01-30 01:00", "2001-02-03 01:00", "2001-02-03 05:00", "2001-02-04 03:00", "2001-02-06 03:00"]
    sales = R.unify_sales(ecc_rows(spark, [dict(order_number=f"O{i}", processed_date=ts(x)) for i, x in enumerate(at)]), None, as_of="2001-02-07")
    for granularity in ("day", "month"):
        path = os.path.join(tmp, granularity)
        K.write_sales(sales, path, granularity=granularity)
        start = "2001-02-03 02:00:00"
        # O3 is gone (deleted since), O2 and O4 come again.
        again = sales.where("processed_date >= timestamp_ntz'2001-02-03 02:00:00' AND order_number <> 'O3'")
        for _ in range(2):
            K.write_sales(again, path, mode="replace_window", granularity=granularity, start=start)
            assert sorted(r.order_number for r in K.read_sales(spark, path).collect()) == ["O0", "O1", "O2", "O4"]
        assert K.write_sales(again.limit(0), path, mode="replace_window", granularity=granularity, start=start) == 0
        assert sorted(r.order_number for r in K.read_sales(spark, path).collect()) == ["O0", "O1"]


def test_failed_writes_block_nothing(spark, tmp):  # K6
    root = os.path.join(tmp, "t")
    os.makedirs(f"{root}/version=1/_temporary")
    assert K.publish(spark.range(4), root) == 2 and K.read_current(spark, root).count() == 4
    K.write_state(spark, root, {"a": 1})
    os.makedirs(f"{root}/_state/left.tmp")
    K.write_state(spark, root, {"a": 2})
    assert K.read_state(spark, root) == {"a": 2, "number": 2}


def test_publish_versions(spark, tmp):  # K6 / K9
    root = os.path.join(tmp, "t")
    assert K.read_current(spark, root) is None
    v1 = K.publish(spark.range(3), root)
    v2 = K.publish(spark.range(5), root)
    assert (v1, v2) == (1, 2) and K.read_current(spark, root).count() == 5


def test_save_processed(spark, tmp):  # K6
    ecc = ecc_rows(spark, [dict(processed_date=ts("2001-01-05"))])
    bw = bw_rows(spark, [dict(customer_id="C2", processed_date=ts("2001-01-06"))])
    c = R.build_customers(ecc, bw, as_of="2001-01-07")
    p = R.build_products(ecc, bw, as_of="2001-01-07")
    s = R.unify_sales(ecc, bw, as_of="2001-01-07")
    out = K.save_processed(c, p, s, tmp, as_of="2001-01-07")
    K.save_processed(c, p, s, tmp, as_of="2001-01-07")
    assert out["sales_rows"] == 2
    saved, customers, products = K.read_processed(spark, tmp)
    assert customers.count() == 2 and saved.count() == 2 and products.where("unit_price IS NULL").count() == 0
    # A run that fails before its state is written changes nothing for readers.
    K.publish(c.limit(0), os.path.join(tmp, "customers"))
    assert K.read_processed(spark, tmp)[1].count() == 2


def test_write_documents_batches(spark, tmp):  # K8
    from tidewater.operators import documents as D
    s = R.unify_sales(ecc_rows(spark, [dict(order_number=f"O{i}") for i in range(25)]), None, as_of="2001-01-02")
    v = K.write_documents(D.sales_documents(s, as_of="2001-01-02").repartition(1), tmp + "/docs", batch_size=10)
    files = [f for f in os.listdir(f"{tmp}/docs/version={v}") if f.endswith(".parquet")]
    assert len(files) == 3
    row = K.read_current(spark, tmp + "/docs").first()
    assert row.timestamp == "2001-01-02T00:00:00"


def test_insight_rows_json(spark, tmp):  # K7
    from tidewater.operators import insights as I
    ecc = ecc_rows(spark, [dict(region="EAST", sales_rep="R1", order_date=ts("2001-01-01"))])
    rows = I.all_insights(R.unify_sales(ecc, None, as_of="2001-01-02"), R.build_customers(ecc, None, as_of="2001-01-02"),
                          R.build_products(ecc, None, as_of="2001-01-02"), as_of="2001-01-02", days=30)
    K.save_insights(rows, tmp + "/ins")
    got = {r.insight_type: json.loads(r.insight_data) for r in spark.read.parquet(tmp + "/ins").collect()}
    assert got["sales_trends"]["total_sales"] == 10.0
    assert got["regional_insights"]["best_performing_region"] == "EAST"
