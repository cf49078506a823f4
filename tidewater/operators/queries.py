"""The query catalogue over the processed tables: look-ups, enriched sales,
customer orders, product / regional / rep performance, top customers.

Each function takes DataFrames and optional filters and returns a lazy
DataFrame; falsy filter values mean "no filter".  Joins against the
customer and product tables are plain left equi-joins: those tables are
unique by key, so there is no fan-out, and the planner decides between a
broadcast (when their measured size allows) and a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import exprs as X


def _active(sales: DataFrame) -> DataFrame:
    """the soft-delete flag applies to the driving table only."""
    return sales.where(F.col("is_active"))


# ------------------------------------------------------------ look-ups

def customer_lookup(customers: DataFrame, customer_id) -> DataFrame:
    """One active customer by id (0 or 1 row), API field names.

    ``customer_id`` may also be a DataFrame with a ``customer_id`` column:
    then it is a batch look-up (left semi join).  The ids are deduplicated
    first (map-side partial aggregation), so an id repeated across a large
    share of the rows does not land in one join task."""
    c = customers.where(F.col("is_active"))
    if isinstance(customer_id, DataFrame):
        c = c.join(customer_id.select("customer_id").distinct(), "customer_id", "left_semi")
    else:
        c = c.where(F.col("customer_id") == F.lit(customer_id))
    return c.select(
        "customer_id", "customer_segment", "region", "sales_rep", "total_orders",
        F.coalesce(F.col("total_sales_amount").cast("double"), F.lit(0.0)).alias("total_sales_amount"),
        "last_order_date", "created_date", "updated_date")


def product_lookup(products: DataFrame, product_code) -> DataFrame:
    """Product details by code (active only); DataFrame of codes = batch."""
    p = products.where(F.col("is_active"))
    if isinstance(product_code, DataFrame):
        p = p.join(product_code.select("product_code").distinct(), "product_code", "left_semi")
    else:
        p = p.where(F.col("product_code") == F.lit(product_code))
    return p.select(
        "product_code", "product_category",
        F.col("unit_price").cast("double").alias("unit_price"),
        F.col("total_quantity_sold").cast("double").alias("total_quantity_sold"),
        F.col("total_sales_amount").cast("double").alias("total_sales_amount"),
        "created_date", "updated_date")


# --------------------------------------------------------- enriched sales

ENRICHED_COLUMNS = ["customer_id", "product_code", "order_number", "sales_date",
                    "sales_amount", "sales_quantity", "unit_price", "region", "channel",
                    "sales_rep", "data_source", "customer_segment", "product_category"]


def sales_enriched(sales: DataFrame, customers: DataFrame, products: DataFrame, *,
                   start=None, end=None, region=None, customer_id=None,
                   order: bool = False, collation: str | None = None) -> DataFrame:
    """J1 + F4: sales with the customer's segment and the product's category.

    Filters are applied to the sales rows before the joins, so they reach
    the scan.  ``order=True`` sorts newest first (O1); leave it off when the
    caller does not need an ordered result (a global sort is a full shuffle).
    """
    s = X.where_opt(_active(sales), X.sales_filter(start=start, end=end, region=region,
                                                   customer_id=customer_id, collation=collation))
    c = customers.select("customer_id", "customer_segment")
    p = products.select("product_code", "product_category")
    out = s.join(c, "customer_id", "left").join(p, "product_code", "left").select(*ENRICHED_COLUMNS)
    if order:
        out = out.orderBy(F.col("sales_date").desc_nulls_last())
    return out


def customer_orders(sales: DataFrame, products: DataFrame, customer_id, *,
                    limit: int = 50) -> DataFrame:
    """O3 + J2: a customer's latest ``limit`` sales, newest first.  Ties on
    the date are broken by the remaining columns so the cut is stable."""
    s = _active(sales).where(F.col("customer_id") == F.lit(customer_id))
    p = products.select("product_code", "product_category")
    out = s.join(p, "product_code", "left").select(
        "order_number", "sales_date", "product_code", "sales_amount", "sales_quantity",
        "unit_price", "region", "channel", "sales_rep", "product_category")
    return out.orderBy(F.col("sales_date").desc_nulls_last(), F.col("product_code"),
                       F.col("order_number").asc_nulls_last(), F.col("sales_amount").desc(),
                       F.col("sales_quantity").desc(), F.col("channel")).limit(int(limit))


def latest_orders_per_customer(sales: DataFrame, products: DataFrame, *, limit: int = 10) -> DataFrame:
    """O3 for every customer at once: each customer's latest ``limit`` sales.

    ``row_number() <= limit`` lets Spark insert a per-partition group limit
    before the shuffle, so a customer with a huge history sends at most
    ``limit`` rows per map task."""
    from pyspark.sql import Window
    p = products.select("product_code", "product_category")
    w = Window.partitionBy("customer_id").orderBy(
        F.col("sales_date").desc_nulls_last(), F.col("product_code"),
        F.col("order_number").asc_nulls_last(), F.col("sales_amount").desc(),
        F.col("sales_quantity").desc(), F.col("channel"))
    ranked = _active(sales).withColumn("rank", F.row_number().over(w).cast("long")) \
                           .where(F.col("rank") <= limit)
    return ranked.join(p, "product_code", "left").select(
        "customer_id", "rank", "order_number", "sales_date", "product_code", "sales_amount",
        "sales_quantity", "unit_price", "region", "channel", "sales_rep", "product_category")


# ------------------------------------------------------------ performance

def product_performance(sales: DataFrame, products: DataFrame, *, product_code=None,
                        start=None, end=None) -> DataFrame:
    """Per (product, category): count, quantity, amount, mean unit
    price, first and last sale; largest amount first."""
    s = X.where_opt(_active(sales), X.sales_filter(start=start, end=end, product_code=product_code))
    p = products.select("product_code", "product_category")
    # The category depends on the product alone: rows are reduced, before and in
    # the shuffle, to one per product, and only those are joined.
    return (s.groupBy("product_code")
             .agg(F.count(F.lit(1)).alias("total_sales"),
                  X.dsum("sales_quantity").alias("total_quantity_sold"),
                  X.dsum("sales_amount").alias("total_sales_amount"),
                  X.dmean("unit_price").alias("average_unit_price"),
                  F.min("sales_date").alias("first_sale_date"),
                  F.max("sales_date").alias("last_sale_date"))
             .join(p, "product_code", "left")
             .select("product_code", "product_category", "total_sales", "total_quantity_sold", "total_sales_amount",
                     "average_unit_price", "first_sale_date", "last_sale_date")
             .orderBy(F.col("total_sales_amount").desc_nulls_last(), "product_code"))


def _group_performance(s: DataFrame, key: str, collation: str | None = None) -> DataFrame:
    if collation:
        s = s.withColumn(key, X.collated(key, collation))
    return (s.groupBy(key)
             .agg(F.count(F.lit(1)).alias("total_sales"),
                  F.count_distinct("customer_id").alias("unique_customers"),
                  X.dsum("sales_quantity").alias("total_quantity_sold"),
                  X.dsum("sales_amount").alias("total_sales_amount"),
                  X.dmean("sales_amount").alias("average_sale_amount"))
             .orderBy(F.col("total_sales_amount").desc_nulls_last(), F.col(key).asc_nulls_last()))


def regional_sales(sales: DataFrame, *, start=None, end=None, collation: str | None = None) -> DataFrame:
    """Per region, the NULL region kept as its own group.  With a
    case-insensitive ``collation`` 'East' and 'EAST ' form one group."""
    s = X.where_opt(_active(sales), X.sales_filter(start=start, end=end))
    return _group_performance(s, "region", collation)


def rep_performance(sales: DataFrame, *, start=None, end=None, collation: str | None = None) -> DataFrame:
    """Per sales rep (rows without a rep are left out)."""
    s = X.where_opt(_active(sales).where(F.col("sales_rep").isNotNull()),
                    X.sales_filter(start=start, end=end))
    return _group_performance(s, "sales_rep", collation)


def top_customers(sales: DataFrame, customers: DataFrame, *, limit: int = 10,
                  start=None, end=None) -> DataFrame:
    """A10 + J3 + O4: customers by sales amount, with the segment, region
    and rep *of the customer record*.  The sales rows are aggregated per
    customer before the join (the customer attributes are functionally
    dependent on the id), so only one row per customer is joined."""
    s = X.where_opt(_active(sales), X.sales_filter(start=start, end=end))
    per = s.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        X.dsum("sales_quantity").alias("total_quantity_purchased"),
        F.sum("sales_amount").alias("_amount"),
        X.dmean("sales_amount").alias("average_order_value"),
        F.max("sales_date").alias("last_order_date"))
    c = customers.select("customer_id", "customer_segment", "region", "sales_rep")
    out = per.join(c, "customer_id", "left").select(
        "customer_id", "customer_segment", "region", "sales_rep", "total_orders",
        "total_quantity_purchased", F.col("_amount").cast("double").alias("total_sales_amount"),
        "average_order_value", "last_order_date")
    ordered = out.orderBy(F.col("total_sales_amount").desc_nulls_last(), "customer_id")
    return ordered.limit(int(limit)) if limit else ordered


# -------------------------------------------------------- API shaping (P5)

def api_records(df: DataFrame) -> DataFrame:
    """One JSON text per row (the API's record shape): timestamps as ISO
    text, amounts as numbers, every field present (null where there is no
    value)."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype.startswith("timestamp"):
            c = X.iso_ts(c)
        elif dtype.startswith("decimal"):
            c = c.cast("double")
        cols.append(c.alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
