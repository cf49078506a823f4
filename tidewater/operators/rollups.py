"""Consolidation: raw order lines + warehouse sales -> sales, customers,
products.

Each consolidated table is ONE aggregation over the union of both sources
(one shuffle on the table key, with partial aggregation before it).  The
two-stage shape of the original (per-source roll-up, then a roll-up of the
roll-ups) only matters for two rules, and both are expressed directly:
"first non-null, newest first" becomes ``max_by`` over (source priority,
processed_date, value), and the product price rule is computed from the
per-source presence flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater import schemas as S
from tidewater.functions import exprs as X

_ECC, _BW = 1, 0   # source priority: order lines win over warehouse rows


# ------------------------------------------------------------------ sales

def ecc_to_sales(ecc: DataFrame) -> DataFrame:
    """Order line -> sales row (channel 'Direct')."""
    return ecc.select(
        "customer_id", "product_code", "order_number",
        F.col("order_date").alias("sales_date"),
        F.col("total_amount").alias("sales_amount"),
        F.col("quantity").alias("sales_quantity"),
        "unit_price", "region",
        F.lit(S.DIRECT_CHANNEL).alias("channel"),
        "sales_rep",
        F.lit(S.SOURCE_ECC).alias("data_source"),
        "processed_date",
    )


def bw_to_sales(bw: DataFrame) -> DataFrame:
    """Warehouse row -> sales row; unit price = amount / quantity, NULL
    for a zero quantity, rounded half-up to cents like a decimal(18,2)
    column stores it."""
    return bw.select(
        "customer_id", "product_code",
        F.lit(None).cast("string").alias("order_number"),
        "sales_date", "sales_amount", "sales_quantity",
        F.round(X.safe_div("sales_amount", "sales_quantity"), 2).cast(S.MONEY).alias("unit_price"),
        "region", "channel", "sales_rep",
        F.lit(S.SOURCE_BW).alias("data_source"),
        "processed_date",
    )


def unify_sales(ecc: DataFrame | None, bw: DataFrame | None, *, as_of) -> DataFrame:
    """Both sources as one sales table, with load metadata.
    Either source may be absent (None)."""
    parts = []
    if ecc is not None:
        parts.append(ecc_to_sales(ecc))
    if bw is not None:
        parts.append(bw_to_sales(bw))
    if not parts:
        raise ValueError("no source given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(
        "customer_id", "product_code", "order_number", "sales_date",
        "sales_amount", "sales_quantity", "unit_price", "region", "channel",
        "sales_rep", "data_source",
        X.ts_lit(as_of).alias("created_date"),
        F.lit(True).alias("is_active"),
        "processed_date",
    )


# -------------------------------------------------------------- customers

def customer_rollup_ecc(ecc: DataFrame) -> DataFrame:
    """A1: per customer over order lines."""
    return ecc.groupBy("customer_id").agg(
        F.count("order_number").alias("total_orders"),
        X.sum0("total_amount").alias("total_sales_amount"),
        F.max("order_date").alias("last_order_date"),
        X.latest_non_null("region", "processed_date").alias("region"),
        X.latest_non_null("sales_rep", "processed_date").alias("sales_rep"),
    ).withColumn("data_source", F.lit(S.SOURCE_ECC))


def customer_rollup_bw(bw: DataFrame) -> DataFrame:
    """A2: per customer over warehouse rows (no order count: 0)."""
    return bw.groupBy("customer_id").agg(
        X.sum0("sales_amount").alias("total_sales_amount"),
        X.sum0("sales_quantity").alias("total_quantity"),
        F.max("sales_date").alias("last_order_date"),
        X.latest_non_null("region", "processed_date").alias("region"),
        X.latest_non_null("customer_segment", "processed_date").alias("customer_segment"),
        X.latest_non_null("sales_rep", "processed_date").alias("sales_rep"),
    ).withColumn("total_orders", F.lit(0).cast("long")) \
     .withColumn("data_source", F.lit(S.SOURCE_BW))


def _customer_facts(ecc: DataFrame | None, bw: DataFrame | None) -> DataFrame:
    parts = []
    if ecc is not None:
        parts.append(ecc.select(
            "customer_id", F.lit(_ECC).alias("src"), "order_number",
            F.col("total_amount").alias("amount"), F.col("order_date").alias("sale_ts"),
            "region", "sales_rep", F.lit(None).cast("string").alias("customer_segment"),
            "processed_date"))
    if bw is not None:
        parts.append(bw.select(
            "customer_id", F.lit(_BW).alias("src"), F.lit(None).cast("string").alias("order_number"),
            F.col("sales_amount").alias("amount"), F.col("sales_date").alias("sale_ts"),
            "region", "sales_rep", "customer_segment", "processed_date"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_customers(ecc: DataFrame | None, bw: DataFrame | None, *, as_of) -> DataFrame:
    """A3: the customer table.  total_orders counts order *lines* of the
    order-line source (warehouse rows add 0); attributes are the latest
    non-null value, order lines first."""
    facts = _customer_facts(ecc, bw)
    prio = F.struct(F.col("src"), F.col("processed_date"))
    agg = facts.groupBy("customer_id").agg(
        F.count("order_number").alias("total_orders"),
        X.sum0("amount").cast("decimal(28,2)").alias("total_sales_amount"),
        F.max("sale_ts").alias("last_order_date"),
        X.latest_non_null("customer_segment", "processed_date").alias("customer_segment"),
        X.latest_non_null("region", prio).alias("region"),
        X.latest_non_null("sales_rep", prio).alias("sales_rep"),
    )
    now = X.ts_lit(as_of)
    return agg.select(
        "customer_id", F.lit(None).cast("string").alias("customer_name"),
        "customer_segment", "region", "sales_rep", "total_orders",
        "total_sales_amount", "last_order_date",
        now.alias("created_date"), now.alias("updated_date"),
        F.lit(True).alias("is_active"))


# --------------------------------------------------------------- products

def product_rollup_ecc(ecc: DataFrame) -> DataFrame:
    """A4: per product over order lines; unit price is the mean list price."""
    return ecc.groupBy("product_code").agg(
        X.sum0("quantity").alias("total_quantity_sold"),
        X.sum0("total_amount").alias("total_sales_amount"),
        X.dmean("unit_price").alias("unit_price"),
    ).withColumn("data_source", F.lit(S.SOURCE_ECC))


def product_rollup_bw(bw: DataFrame) -> DataFrame:
    """A5: per product over warehouse rows; price is not derived (0)."""
    return bw.groupBy("product_code").agg(
        X.sum0("sales_quantity").alias("total_quantity_sold"),
        X.sum0("sales_amount").alias("total_sales_amount"),
        X.latest_non_null("product_category", "processed_date").alias("product_category"),
    ).withColumn("unit_price", F.lit(0.0)) \
     .withColumn("data_source", F.lit(S.SOURCE_BW))


def build_products(ecc: DataFrame | None, bw: DataFrame | None, *, as_of,
                   unit_price_mode: str = "reference") -> DataFrame:
    """The product table.

    ``unit_price_mode="reference"`` keeps the original rule: the mean of the
    per-source prices where the warehouse source contributes 0, so a product
    sold through both sources gets half its mean list price.
    ``"ecc_only"`` uses the mean list price of the order lines alone (NULL
    for warehouse-only products).  Prices are stored in cents, rounded
    half-up from the exact ratio.
    """
    parts = []
    if ecc is not None:
        parts.append(ecc.select(
            "product_code", F.lit(_ECC).alias("src"), F.col("quantity").alias("qty"),
            F.col("total_amount").alias("amount"), "unit_price",
            F.lit(None).cast("string").alias("product_category"), "processed_date"))
    if bw is not None:
        parts.append(bw.select(
            "product_code", F.lit(_BW).alias("src"), F.col("sales_quantity").alias("qty"),
            F.col("sales_amount").alias("amount"), F.lit(None).cast(S.MONEY).alias("unit_price"),
            "product_category", "processed_date"))
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    agg = facts.groupBy("product_code").agg(
        X.sum0("qty").cast("decimal(28,2)").alias("total_quantity_sold"),
        X.sum0("amount").cast("decimal(28,2)").alias("total_sales_amount"),
        F.sum("unit_price").alias("_price_sum"),
        F.count("unit_price").alias("_price_n"),
        F.max("src").alias("_max_src"),
        F.min("src").alias("_min_src"),
        X.latest_non_null("product_category", "processed_date").alias("product_category"),
    )
    both = (F.col("_max_src") == _ECC) & (F.col("_min_src") == _BW)
    has_ecc = F.col("_max_src") == _ECC
    if unit_price_mode == "reference":
        divisor = F.when(both, F.col("_price_n") * 2).otherwise(F.col("_price_n"))
        price = F.when(has_ecc, F.round(F.col("_price_sum") / divisor, 2)).otherwise(F.lit(0))
    elif unit_price_mode == "ecc_only":
        price = F.when(has_ecc, F.round(F.col("_price_sum") / F.col("_price_n"), 2))
    else:
        raise ValueError(f"unknown unit_price_mode {unit_price_mode!r}")
    now = X.ts_lit(as_of)
    return agg.select(
        "product_code", F.lit(None).cast("string").alias("product_name"),
        "product_category", price.cast(S.MONEY).alias("unit_price"),
        "total_quantity_sold", "total_sales_amount",
        now.alias("created_date"), now.alias("updated_date"),
        F.lit(True).alias("is_active"))


# ------------------------------------------------------------- the whole ETL

class Warehouse:
    """The processed tables of one consolidation run, built lazily from the
    raw tables.  ``lookback_days=None`` consolidates all history (all-time
    totals); 7 reproduces the nightly window."""

    def __init__(self, raw_ecc: DataFrame, raw_bw: DataFrame, *, as_of,
                 lookback_days: int | None = None, unit_price_mode: str = "reference"):
        from tidewater.sources.tables import scan_raw_bw, scan_raw_ecc
        self.as_of = as_of
        self.ecc = scan_raw_ecc(raw_ecc, as_of=as_of, lookback_days=lookback_days)
        self.bw = scan_raw_bw(raw_bw, as_of=as_of, lookback_days=lookback_days)
        self.unit_price_mode = unit_price_mode

    @property
    def sales(self) -> DataFrame:
        return unify_sales(self.ecc, self.bw, as_of=self.as_of)

    @property
    def customers(self) -> DataFrame:
        return build_customers(self.ecc, self.bw, as_of=self.as_of)

    @property
    def products(self) -> DataFrame:
        return build_products(self.ecc, self.bw, as_of=self.as_of,
                              unit_price_mode=self.unit_price_mode)
