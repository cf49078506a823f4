"""Table schemas (snake_case) and the fixed values the data model relies on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These strings are part of the data contract and must stay
# exactly as written: source tags, the channel given to order lines, the
# placeholder for a missing order number, the product document id prefix,
# the document categories and the insight report names.
# ---------------------------------------------------------------------------
SOURCE_ECC = "SAP_ECC"
SOURCE_BW = "SAP_BW"
DIRECT_CHANNEL = "Direct"
NO_ORDER = "NO-ORDER"
PRODUCT_DOC_PREFIX = "PROD-"
DOC_CUSTOMER = "Customer"
DOC_SALES = "Sales"
DOC_PRODUCT = "Product"
UNKNOWN_REGION = "Unknown"
INSIGHT_TYPES = ("sales_trends", "customer_insights", "product_insights",
                 "regional_insights", "sales_rep_insights")

MONEY = T.DecimalType(18, 2)
TS = T.TimestampNTZType()


def _f(name, dtype, nullable=True, **meta):
    return T.StructField(name, dtype, nullable, metadata=meta or None)


# Order lines (raw ECC export).
RAW_ECC = T.StructType([
    _f("id", T.StringType(), False),
    _f("customer_id", T.StringType(), False),
    _f("order_number", T.StringType(), False),
    _f("order_date", TS, False),
    _f("product_code", T.StringType(), False),
    _f("quantity", MONEY, False),
    _f("unit_price", MONEY, False),
    _f("total_amount", MONEY, False),
    _f("status", T.StringType(), False),
    _f("sales_rep", T.StringType()),
    _f("region", T.StringType()),
    _f("processed_date", TS, False),
    _f("data_source", T.StringType(), False),
    _f("is_active", T.BooleanType(), False),
    _f("is_deleted", T.BooleanType(), False),
    _f("validation_errors", T.StringType()),
])

# Warehouse sales (raw BW export).
RAW_BW = T.StructType([
    _f("id", T.StringType(), False),
    _f("customer_id", T.StringType(), False),
    _f("product_code", T.StringType(), False),
    _f("sales_amount", MONEY, False),
    _f("sales_quantity", MONEY, False),
    _f("sales_date", TS, False),
    _f("sales_rep", T.StringType()),
    _f("region", T.StringType()),
    _f("channel", T.StringType()),
    _f("product_category", T.StringType()),
    _f("customer_segment", T.StringType()),
    _f("processed_date", TS, False),
    _f("data_source", T.StringType(), False),
    _f("is_active", T.BooleanType(), False),
    _f("is_deleted", T.BooleanType(), False),
    _f("validation_errors", T.StringType()),
])

# Columns the nightly consolidation reads from each raw table.
ECC_SCAN_COLUMNS = ["customer_id", "order_number", "order_date", "product_code",
                    "quantity", "unit_price", "total_amount", "status",
                    "sales_rep", "region", "processed_date"]
BW_SCAN_COLUMNS = ["customer_id", "product_code", "sales_amount", "sales_quantity",
                   "sales_date", "sales_rep", "region", "channel",
                   "product_category", "customer_segment", "processed_date"]

CUSTOMERS = T.StructType([
    _f("customer_id", T.StringType(), False),
    _f("customer_name", T.StringType()),
    _f("customer_segment", T.StringType()),
    _f("region", T.StringType()),
    _f("sales_rep", T.StringType()),
    _f("total_orders", T.LongType(), False),
    _f("total_sales_amount", T.DecimalType(28, 2), False),
    _f("last_order_date", TS),
    _f("created_date", TS, False),
    _f("updated_date", TS, False),
    _f("is_active", T.BooleanType(), False),
])

PRODUCTS = T.StructType([
    _f("product_code", T.StringType(), False),
    _f("product_name", T.StringType()),
    _f("product_category", T.StringType()),
    _f("unit_price", MONEY),
    _f("total_quantity_sold", T.DecimalType(28, 2), False),
    _f("total_sales_amount", T.DecimalType(28, 2), False),
    _f("created_date", TS, False),
    _f("updated_date", TS, False),
    _f("is_active", T.BooleanType(), False),
])

# processed_date is kept as lineage: it lets a re-run replace exactly the
# rows of its look-back window (idempotent load, see sinks.replace_window).
SALES = T.StructType([
    _f("customer_id", T.StringType(), False),
    _f("product_code", T.StringType(), False),
    _f("order_number", T.StringType()),
    _f("sales_date", TS, False),
    _f("sales_amount", MONEY, False),
    _f("sales_quantity", MONEY, False),
    _f("unit_price", MONEY),
    _f("region", T.StringType()),
    _f("channel", T.StringType()),
    _f("sales_rep", T.StringType()),
    _f("data_source", T.StringType(), False),
    _f("created_date", TS, False),
    _f("is_active", T.BooleanType(), False),
    _f("processed_date", TS),
])

INSIGHTS = T.StructType([
    _f("insight_type", T.StringType(), False),
    _f("insight_data", T.StringType(), False),
    _f("generated_date", TS, False),
    _f("is_active", T.BooleanType(), False),
])

# Search document: 15 fields with their roles kept as field metadata.
DOCUMENT = T.StructType([
    _f("id", T.StringType(), False, key=True),
    _f("title", T.StringType(), searchable=True),
    _f("content", T.StringType(), searchable=True),
    _f("category", T.StringType(), filterable=True, facetable=True),
    _f("timestamp", TS, filterable=True, sortable=True),
    _f("metadata", T.StringType(), filterable=True),
    _f("customer_id", T.StringType(), filterable=True),
    _f("product_code", T.StringType(), filterable=True),
    _f("region", T.StringType(), filterable=True, facetable=True),
    _f("sales_rep", T.StringType(), filterable=True),
    _f("data_source", T.StringType(), filterable=True),
    _f("sales_amount", T.DoubleType(), filterable=True, sortable=True),
    _f("sales_quantity", T.DoubleType(), filterable=True, sortable=True),
    _f("order_number", T.StringType(), filterable=True),
    _f("sales_date", TS, filterable=True, sortable=True),
])

DOCUMENT_COLUMNS = [f.name for f in DOCUMENT.fields]


def field_roles(schema: T.StructType = DOCUMENT) -> dict[str, list[str]]:
    """Field name -> list of roles (key, searchable, filterable, ...)."""
    return {f.name: sorted(k for k, v in (f.metadata or {}).items() if v)
            for f in schema.fields}
