"""Golden rows for the semantic rules (NULLs, rounding, ordering, text)."""

from decimal import Decimal

from pyspark.sql import functions as F

from conftest import ts
from tidewater.functions import exprs as X
from tidewater.functions.quantile import exact_quantile


def test_latest_non_null_skips_null_newest(spark):  # N2
    df = spark.createDataFrame(
        [("a", ts("2001-01-01"), "old"), ("a", ts("2001-01-02"), "mid"), ("a", ts("2001-01-03"), None)],
        "k string, t timestamp_ntz, v string")
    r = df.groupBy("k").agg(X.latest_non_null("v", "t").alias("v")).first()
    assert r.v == "mid"


def test_latest_non_null_tie_is_deterministic(spark):  # N2 ties
    rows = [("a", ts("2001-01-02"), "x"), ("a", ts("2001-01-02"), "y"), ("a", ts("2001-01-01"), "z")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k string, t timestamp_ntz, v string").repartition(3)
        assert df.groupBy("k").agg(X.latest_non_null("v", "t").alias("v")).first().v == "y"


def test_sum0_all_null_is_zero(spark):  # N4
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, v decimal(18,2)")
    assert df.groupBy("k").agg(X.sum0("v").alias("s")).first().s == 0


def test_safe_div_zero_is_null(spark):  # N5
    df = spark.createDataFrame([(Decimal("10.00"), Decimal("0.00"))], "a decimal(18,2), b decimal(18,2)")
    assert df.select(X.safe_div("a", "b").alias("x")).first().x is None


def test_mean2_rounds_half_even_on_exact_ratio(spark):  # N6
    df = spark.createDataFrame([("a", Decimal("0.125")), ("b", Decimal("2.345")), ("c", Decimal("0.135"))],
                               "k string, v decimal(18,3)")
    got = {r.k: float(r.m) for r in df.groupBy("k").agg(X.mean2("v").alias("m")).collect()}
    assert got == {"a": 0.12, "b": 2.34, "c": 0.14}


def test_exact_quantile_linear(spark):  # N7
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "v int").selectExpr("cast(v as decimal(12,2)) v")
    assert abs(exact_quantile(df, "v", 0.8).first().q - 5.8) < 1e-12


def test_count_distinct_excludes_null(spark):  # N8
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "v string")
    assert df.agg(F.count_distinct("v").alias("n")).first().n == 2


def test_text_cat_reads_null_as_empty(spark):  # N9
    df = spark.createDataFrame([("x", None)], "a string, b string")
    r = df.select(X.text_cat("A:", F.col("a"), X.opt(", B: ", "b"), "|B:", X.nz("b")).alias("t")).first()
    assert r.t == "A:x|B:"


def test_n2_format(spark):  # N10
    df = spark.createDataFrame([(Decimal("1234.50"),), (Decimal("0.50"),)], "v decimal(18,2)")
    assert [r.t for r in df.select(X.n2("v").alias("t")).collect()] == ["1,234.50", "0.50"]


def test_end_date_is_midnight(spark):  # N11
    df = spark.createDataFrame([(ts("2001-01-31 00:00:00"),), (ts("2001-01-31 10:00:00"),)],
                               "sales_date timestamp_ntz")
    assert df.where(X.sales_filter(end="2001-01-31")).count() == 1


def test_empty_filters_mean_no_filter():  # N12
    assert X.sales_filter(start="", end=None, region="", customer_id=None) is None


def test_desc_puts_nulls_last(spark):  # N15
    df = spark.createDataFrame([(None,), (1,), (2,)], "v int")
    assert [r.v for r in df.orderBy(F.col("v").desc_nulls_last()).collect()] == [2, 1, None]


def test_money_text_negative(spark):  # E14
    df = spark.createDataFrame([(Decimal("-1234.50"),), (Decimal("5.00"),)], "v decimal(18,2)")
    assert [r.t for r in df.select(X.money_text("v").alias("t")).collect()] == ["-$1,234.50", "$5.00"]
