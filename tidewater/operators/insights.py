"""Insight reports over a window of enriched sales: trends, customers,
products, regions and sales reps.

Each report is split into flat DataFrames (one per component) so every
part stays distributed: per-key analyses are ordinary aggregations, top-k
lists are ``orderBy().limit()`` (a bounded TakeOrderedAndProject), and the
summary scalars are one global aggregation over already-aggregated rows.
Groups with a NULL key are dropped, and rounding happens between the two
aggregation levels, as in the original reports.
"""

# The output column names of the reports (total_sales,
# average_daily_sales, sales_growth_rate, top_performing_days, ...) are the
# field names of the original reports and appear as-is in the JSON rows.

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import exprs as X
from tidewater.operators.cube import Cube


def insight_scan(sales: DataFrame, customers: DataFrame | None, products: DataFrame | None, *,
                 as_of=None, days: int | None = 30) -> DataFrame:
    """Active sales of the last ``days`` days (None: all history) with
    the customer's segment and the product's category.  A report that does
    not read a dimension may pass None for it: the join is skipped and the
    column is NULL."""
    s = X.where_opt(sales.where(F.col("is_active")), X.lookback("sales_date", as_of, days))
    s = s.select("customer_id", "product_code", "sales_date", "sales_amount", "sales_quantity",
                 "unit_price", "region", "channel", "sales_rep", "data_source")
    if customers is None:
        s = s.withColumn("customer_segment", F.lit(None).cast("string"))
    else:
        s = s.join(customers.select("customer_id", "customer_segment"), "customer_id", "left")
    if products is None:
        s = s.withColumn("product_category", F.lit(None).cast("string"))
    else:
        s = s.join(products.select("product_code", "product_category"), "product_code", "left")
    return s


# ------------------------------------------------------------- sales trends

def _day_customer(scan: DataFrame) -> DataFrame:
    """One shuffle: sales per (day, customer).  Daily totals, daily and
    overall distinct customers all derive from it, so the trend report
    reads the sales once."""
    return scan.groupBy(F.to_date("sales_date").alias("sales_day"), "customer_id").agg(
        F.sum("sales_amount").alias("amount"), F.sum("sales_quantity").alias("quantity"))


def daily_sales(scan: DataFrame) -> DataFrame:
    """Per calendar day with sales."""
    return _daily_from(_day_customer(scan))


def _daily_from(dc: DataFrame) -> DataFrame:
    return dc.groupBy("sales_day").agg(
        F.sum("amount").alias("total_sales"),
        F.sum("quantity").alias("total_quantity"),
        F.count("customer_id").alias("unique_customers"))


def _day_stats(daily: DataFrame, *more) -> DataFrame:
    """One aggregate over the day rows numbered in date order: day count,
    totals, the first-half sum and any ``more``.  The day rows are one per
    calendar day, so the single ordered window partition holds a bounded
    number of rows."""
    h = daily.select("*",
                     F.row_number().over(Window.orderBy("sales_day")).alias("rn"),
                     F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return h.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("total_sales").alias("_all"),
        F.sum(F.when(F.col("rn") <= F.floor(F.col("n") / 2), F.col("total_sales"))).alias("_s1"),
        F.sum("unique_customers").alias("_uniq"), *more)


def growth(daily: DataFrame) -> DataFrame:
    """Mean daily total of the later days versus the first ``n div 2``
    days, in percent; 0.0 for fewer than 2 days or a zero first half.
    Computed as ``(S2·n1 − S1·n2) / (S1·n2) · 100`` from exact sums."""
    return _growth_cols(_day_stats(daily)).select(
        "n_days", "first_half_mean", "second_half_mean", "sales_growth_rate")


def _growth_cols(df: DataFrame) -> DataFrame:
    n = F.col("n_days")
    n1 = F.floor(n / 2).cast("long")
    n2 = n - n1
    s1 = F.coalesce(F.col("_s1"), F.lit(0).cast("decimal(38,2)"))
    s2 = F.coalesce(F.col("_all"), F.lit(0).cast("decimal(38,2)")) - s1
    num = (s2 * n1 - s1 * n2).cast("double")
    den = (s1 * n2).cast("double")
    rate = F.when((n < 2) | (s1 == 0), F.lit(0.0)).otherwise(num / den * F.lit(100.0))
    return df.select(
        "*",
        F.when(n1 > 0, s1.cast("double") / n1).alias("first_half_mean"),
        F.when(n2 > 0, s2.cast("double") / n2).alias("second_half_mean"),
        rate.alias("sales_growth_rate"))


def sales_trends(scan: DataFrame) -> DataFrame:
    """One row of trend figures.  ``total_unique_customers`` is the sum
    of the daily distinct counts (as reported originally);
    ``distinct_customers`` is the true distinct count.  Days and customers
    are two grouping sets of the (day, customer) rows, so that the scan is
    read once; the customers then become one row beside those of the days."""
    dc = _day_customer(scan).withColumn("customer", F.col("customer_id"))
    both = dc.groupingSets([["sales_day"], ["customer_id"]], "sales_day", "customer_id").agg(
        (F.grouping_id() == 1).alias("is_day"), F.sum("amount").alias("total_sales"), F.count("customer").alias("unique_customers"))
    rows = both.groupBy("is_day", "sales_day").agg(
        F.max("total_sales").alias("total_sales"), F.max("unique_customers").alias("unique_customers"),
        F.count("customer_id").alias("customers"))
    daily = rows.withColumn("customers", F.sum("customers").over(Window.partitionBy())).where("is_day")
    return trends_from(daily, F.coalesce(F.col("_customers"), F.lit(0).cast("long")), F.max("customers").alias("_customers"))


def trends_from(daily: DataFrame, distinct, *more) -> DataFrame:
    """A12 from the daily totals and the number of customers, which may be
    one of ``more`` aggregates of the day rows."""
    st = _growth_cols(_day_stats(daily, *more))
    return st.select(
        F.col("_all").cast("double").alias("total_sales"),
        (F.col("_all").cast("double") / F.col("n_days")).alias("average_daily_sales"),
        "sales_growth_rate",
        F.col("_uniq").alias("total_unique_customers"),
        (F.col("_uniq").cast("double") / F.col("n_days")).alias("average_daily_customers"),
        distinct.alias("distinct_customers"),
        F.col("n_days").alias("days"))


def top_days(scan: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` days with the highest totals (earlier day wins a tie)."""
    return top_days_from(daily_sales(scan), k)


def top_days_from(daily: DataFrame, k: int = 5) -> DataFrame:
    return daily.orderBy(F.col("total_sales").desc(), "sales_day").limit(k) \
        .select("sales_day", F.col("total_sales").cast("double").alias("total_sales"))


# ----------------------------------------------------------------- customers

def customer_analysis(scan: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Per customer; values rounded to cents (half to even).  With
    ``customers``, the segment is joined to the one row per customer after
    the aggregation (it depends on the customer alone); without, it is the
    latest one of the scan."""
    if customers is not None:
        per = customer_analysis(scan).drop("segment")
        out = per.join(customers.select("customer_id", F.col("customer_segment").alias("segment")), "customer_id", "left")
        return out.select("customer_id", "total_sales", "order_count", "avg_order_value", "total_quantity",
                          "first_order", "last_order", "segment", "region")
    return scan.groupBy("customer_id").agg(
        F.sum("sales_amount").alias("total_sales"),
        F.count("sales_amount").alias("order_count"),
        X.mean2("sales_amount").alias("avg_order_value"),
        F.sum("sales_quantity").alias("total_quantity"),
        F.min("sales_date").alias("first_order"),
        F.max("sales_date").alias("last_order"),
        X.latest_non_null("customer_segment", "sales_date").alias("segment"),
        X.latest_non_null("region", "sales_date").alias("region"))


def segment_analysis(cust: DataFrame) -> DataFrame:
    """Per segment over the rounded customer figures."""
    return cust.where(F.col("segment").isNotNull()).groupBy("segment").agg(
        F.count("customer_id").alias("customer_count"),
        F.sum("total_sales").alias("total_sales"),
        X.mean2("avg_order_value").alias("avg_order_value"))


def retention(cust: DataFrame, *, as_of) -> DataFrame:
    """Customers, recent (last order on or after the day 7 days
    before ``as_of``), returning (more than one order), retention rate."""
    since = X.day_start(X.days_before(as_of, 7))
    return cust.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("last_order") >= since).alias("recent_customers"),
        F.count_if(F.col("order_count") > 1).alias("returning_customers"),
    ).withColumn("customer_retention_rate", X.pct("returning_customers", "total_customers"))


def top_customers_report(cust: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` customers by total sales (customer id breaks ties)."""
    return cust.orderBy(F.col("total_sales").desc(), "customer_id").limit(k).select(
        "customer_id", "total_sales", "order_count", "avg_order_value", "segment", "region")


# ------------------------------------------------------------------ products

def product_analysis(scan: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Per product; values rounded to cents (half to even).  With
    ``products``, the category is joined to the one row per product after
    the aggregation; without, it is the latest one of the scan."""
    if products is not None:
        per = product_analysis(scan).drop("category")
        return per.join(products.select("product_code", F.col("product_category").alias("category")), "product_code", "left")
    return scan.groupBy("product_code").agg(
        F.sum("sales_amount").alias("total_sales"),
        F.count("sales_amount").alias("order_count"),
        X.mean2("sales_amount").alias("avg_order_value"),
        F.sum("sales_quantity").alias("total_quantity"),
        X.mean2("unit_price").alias("avg_unit_price"),
        X.latest_non_null("product_category", "sales_date").alias("category"))


def category_analysis(prod: DataFrame) -> DataFrame:
    """Per category over the rounded product figures."""
    return prod.where(F.col("category").isNotNull()).groupBy("category").agg(
        F.count("product_code").alias("product_count"),
        F.sum("total_sales").alias("total_sales"),
        F.sum("total_quantity").alias("total_quantity"),
        X.mean2("avg_unit_price").alias("avg_unit_price"))


def product_summary(prod: DataFrame, *, p: float = 0.8) -> DataFrame:
    """Product count, products strictly above the ``p`` quantile of
    total sales (exact, linear interpolation) and their share in percent."""
    from tidewater.functions.quantile import exact_quantile
    q = exact_quantile(prod, "total_sales", p).scalar()
    return prod.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col("total_sales").cast("double") > q).alias("high_performing_products"),
    ).withColumn("product_diversity_score", X.pct("high_performing_products", "total_products"))


def top_products_report(prod: DataFrame, k: int = 10) -> DataFrame:
    return prod.orderBy(F.col("total_sales").desc(), "product_code").limit(k).select(
        "product_code", "total_sales", "total_quantity", "avg_unit_price", "category")


# ------------------------------------------------------------ regions / reps

def _dimension_analysis(scan: DataFrame, key: str, other: str, other_name: str) -> DataFrame:
    return scan.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("sales_amount").alias("total_sales"),
        F.count("sales_amount").alias("order_count"),
        X.mean2("sales_amount").alias("avg_order_value"),
        F.sum("sales_quantity").alias("total_quantity"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct(other).alias(other_name))


def region_analysis(scan: DataFrame) -> DataFrame:
    """Per (non-null) region."""
    return _dimension_analysis(scan, "region", "sales_rep", "sales_reps")


def rep_analysis(scan: DataFrame) -> DataFrame:
    """Per (non-null) sales rep."""
    return _dimension_analysis(scan, "sales_rep", "region", "regions")


def region_summary(an: DataFrame) -> DataFrame:
    """Number of regions, mean total, best region and its total."""
    return _summary(an, "region", ("total_regions", "average_sales_per_region",
                                   "best_performing_region", "best_region_sales"))


def rep_summary(an: DataFrame) -> DataFrame:
    """Number of reps, mean total, top rep and its total."""
    return _summary(an, "sales_rep", ("total_sales_reps", "average_sales_per_rep",
                                      "top_performing_rep", "top_rep_sales"))


def _summary(an: DataFrame, key: str, names) -> DataFrame:
    n_name, avg_name, best_name, best_sales = names
    # arg-max: the largest total, the smallest key on a tie; max_by over a
    # struct keeps it one partial + final aggregation (no sort, no window)
    top = F.max("total_sales")
    best = F.min_by(F.col(key), F.struct((-F.col("total_sales")).alias("neg"), F.col(key).alias("k")))
    return an.agg(
        F.count(F.lit(1)).alias(n_name),
        (F.sum("total_sales").cast("double") / F.count(F.lit(1))).alias(avg_name),
        best.alias(best_name),
        top.cast("double").alias(best_sales))


def top_regions_report(an: DataFrame, k: int = 5) -> DataFrame:
    return an.orderBy(F.col("total_sales").desc(), "region").limit(k).select(
        "region", "total_sales", "order_count", "unique_customers", "sales_reps")


def top_reps_report(an: DataFrame, k: int = 5) -> DataFrame:
    return an.orderBy(F.col("total_sales").desc(), "sales_rep").limit(k).select(
        "sales_rep", "total_sales", "order_count", "unique_customers", "regions")


# ----------------------------------------------------- all reports

def _json_row(df: DataFrame, insight_type: str) -> DataFrame:
    """Every column of a (bounded) report part as one JSON object per row."""
    cols = [F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
            for c, t in df.dtypes]
    return df.select(F.lit(insight_type).alias("insight_type"),
                     F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("insight_data"))


def _with_top(summary: DataFrame, name: str, top: DataFrame) -> DataFrame:
    """Attach a top-k list (k rows, bounded) to a one-row summary."""
    cols = [F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
            for c, t in top.dtypes]
    lst = top.select(F.struct(*cols).alias("r")).agg(F.collect_list("r")).scalar()
    return summary.select("*", lst.alias(name))


def all_insights(sales: DataFrame, customers: DataFrame, products: DataFrame, *,
                 as_of, days: int | None = 30) -> DataFrame:
    """The five reports over ONE scan, as insight rows
    (insight_type, insight_data JSON, generated_date, is_active).

    The scan is grouped once (``operators.cube``) and the cube is written
    when this is called; the rows are planned over it."""
    return insight_rows(Cube(insight_scan(sales, None, None, as_of=as_of, days=days)), customers, products, as_of=as_of)


def report_parts(cube: Cube, customers: DataFrame, products: DataFrame, *, as_of) -> dict[str, DataFrame]:
    """Every part of the five reports by name, over one cube: the summary of
    a report (scalars and a top-k list) is one row; the per-key breakdowns
    (segments, categories, region and rep distributions) are one row per key
    under ``<report>.<part>``, so no list of unbounded length is gathered
    into a single row."""
    daily = cube.daily_sales()
    cust = cube.customer_analysis(customers)
    prod = cube.product_analysis(products)
    reg = cube.region_analysis()
    rep = cube.rep_analysis()
    return {
        "sales_trends": _with_top(trends_from(daily, cube.distinct_customers().scalar()), "top_performing_days", top_days_from(daily)),
        "customer_insights": _with_top(retention(cust, as_of=as_of), "top_customers", top_customers_report(cust)),
        "customer_insights.segment_analysis": segment_analysis(cust),
        "product_insights": _with_top(product_summary(prod), "top_products", top_products_report(prod)),
        "product_insights.category_analysis": category_analysis(prod),
        "regional_insights": _with_top(region_summary(reg), "top_regions", top_regions_report(reg)),
        "regional_insights.regional_distribution": reg.select("region", "total_sales"),
        "sales_rep_insights": _with_top(rep_summary(rep), "top_sales_reps", top_reps_report(rep)),
        "sales_rep_insights.rep_performance_distribution": rep.select("sales_rep", "total_sales"),
    }


def insight_rows(cube: Cube, customers: DataFrame, products: DataFrame, *, as_of) -> DataFrame:
    """The insight rows of one cube."""
    out = None
    for name, part in report_parts(cube, customers, products, as_of=as_of).items():
        rows = _json_row(part, name)
        out = rows if out is None else out.unionByName(rows)
    return out.select("insight_type", "insight_data",
                      X.ts_lit(as_of).alias("generated_date"), F.lit(True).alias("is_active"))
