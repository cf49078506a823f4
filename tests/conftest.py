import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tidewater import schemas as S  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]").appName("tidewater-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tidewater.session import apply_runtime_conf, checkpoint_dir
    apply_runtime_conf(s)
    checkpoint_dir(s)
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def ts(s):
    return dt.datetime.fromisoformat(s)


def d(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def ecc_rows(spark, rows):
    """rows: dicts with a subset of raw ECC fields; the rest defaulted."""
    base = dict(id="x", customer_id="C1", order_number="O1", order_date=ts("2001-01-01"),
                product_code="P1", quantity=d(1), unit_price=d(10), total_amount=d(10),
                status="O", sales_rep=None, region=None, processed_date=ts("2001-01-01"),
                data_source=S.SOURCE_ECC, is_active=True, is_deleted=False, validation_errors=None)
    out = []
    for i, r in enumerate(rows):
        x = dict(base, id=f"e{i}")
        x.update({k: (d(v) if k in ("quantity", "unit_price", "total_amount") else v) for k, v in r.items()})
        out.append(x)
    return spark.createDataFrame(out, S.RAW_ECC)


def bw_rows(spark, rows):
    base = dict(id="x", customer_id="C1", product_code="P1", sales_amount=d(10), sales_quantity=d(1),
                sales_date=ts("2001-01-01"), sales_rep=None, region=None, channel="5-LOW",
                product_category=None, customer_segment=None, processed_date=ts("2001-01-01"),
                data_source=S.SOURCE_BW, is_active=True, is_deleted=False, validation_errors=None)
    out = []
    for i, r in enumerate(rows):
        x = dict(base, id=f"b{i}")
        x.update({k: (d(v) if k in ("sales_amount", "sales_quantity") else v) for k, v in r.items()})
        out.append(x)
    return spark.createDataFrame(out, S.RAW_BW)


def empty(spark, schema):
    return spark.createDataFrame([], schema)
