"""DuckDB SQL twins of the registered queries (the correctness oracle).

Shared CTEs rebuild the raw tables, the sales table and the customer and
product tables from the driver's views; each query appends its own CTEs
and final SELECT.  Rounded values are computed on exact integer cents so
that half-up / half-even rounding is decided on the true ratio, as Spark's
decimal arithmetic does.
"""

from __future__ import annotations

from tidewater.plans.catalog import (AS_OF, FILTER, INSIGHT_DAYS, LOOKUP_CUSTOMER,
                                     LOOKUP_PRODUCT, RAW_LOOKBACK_DAYS, TOP_K, UPSERT_SPLIT,
                                     ALERT_THRESHOLD_LOW)


def ts(d: str) -> str:
    return f"TIMESTAMP '{d}'"


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def half_up(num_cents: str, den: str) -> str:
    """round(num_cents / den) half-up, as integer cents (num >= 0, den > 0)."""
    return f"((2 * ({num_cents}) + ({den})) // (2 * ({den})))"


def half_even(num_cents: str, den: str) -> str:
    """round(num_cents / den) half-to-even, as integer cents (num >= 0)."""
    n, d = f"({num_cents})", f"({den})"
    return (f"(CASE WHEN 2 * ({n} % {d}) > {d} THEN {n} // {d} + 1 "
            f"WHEN 2 * ({n} % {d}) = {d} THEN {n} // {d} + (({n} // {d}) % 2) "
            f"ELSE {n} // {d} END)")


def as_money(c: str) -> str:
    """Integer cents -> DECIMAL(18,2)."""
    return f"CAST(CAST({c} AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


def dbl_cents(c: str) -> str:
    return f"(CAST({c} AS DOUBLE) / 100)"


def mean2(col: str) -> str:
    """Half-even mean rounded to cents (as integer cents)."""
    return half_even(f"CAST(sum({col}) * 100 AS HUGEINT)", f"count({col})")


def lookback(col: str, days: int, as_of: str = AS_OF) -> str:
    return f"{col} >= {ts(as_of)} - INTERVAL {int(days)} DAY"


def sales_where(start=None, end=None, region=None, customer_id=None, product_code=None,
                prefix="") -> str:
    p = prefix
    c = ["TRUE"]
    if start:
        c.append(f"{p}sales_date >= {ts(start)}")
    if end:
        c.append(f"{p}sales_date <= {ts(end)}")
    if region:
        c.append(f"{p}region = '{region}'")
    if customer_id:
        c.append(f"{p}customer_id = '{customer_id}'")
    if product_code:
        c.append(f"{p}product_code = '{product_code}'")
    return " AND ".join(c)


def _base(where_ecc="TRUE", where_bw="TRUE") -> str:
    return f"""
base AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
         l.l_linestatus, l.l_shipdate, o.o_custkey, o.o_orderstatus, o.o_orderpriority,
         c.c_mktsegment, r.r_name, s.s_name, p.p_type, p.p_retailprice
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
raw_ecc AS (
  SELECT 'C' || o_custkey AS customer_id, 'O' || l_orderkey AS order_number,
         l_shipdate AS order_date, 'P' || l_partkey AS product_code,
         CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
         CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount,
         o_orderstatus AS status,
         CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE s_name END AS sales_rep,
         CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE r_name END AS region,
         l_shipdate + to_days(CAST(l_linenumber % 3 AS INTEGER)) AS processed_date,
         l_orderkey % 50 <> 0 AS is_active, l_partkey % 97 = 0 AS is_deleted
  FROM base WHERE l_linestatus = 'O'
),
raw_bw AS (
  SELECT 'C' || o_custkey AS customer_id, 'P' || l_partkey AS product_code,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS sales_amount,
         CASE WHEN l_orderkey % 101 = 0 THEN CAST(0 AS DECIMAL(18,2))
              ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS sales_quantity,
         l_shipdate AS sales_date,
         CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE s_name END AS sales_rep,
         CASE WHEN o_custkey % 20 = 0 THEN NULL ELSE r_name END AS region,
         o_orderpriority AS channel,
         CASE WHEN l_partkey % 25 = 0 THEN NULL ELSE p_type END AS product_category,
         CASE WHEN o_custkey % 15 = 0 THEN NULL ELSE c_mktsegment END AS customer_segment,
         l_shipdate + to_days(CAST(l_linenumber % 3 AS INTEGER)) AS processed_date,
         l_orderkey % 50 <> 0 AS is_active, l_partkey % 97 = 0 AS is_deleted
  FROM base WHERE l_linestatus = 'F'
),
ecc AS (SELECT * FROM raw_ecc WHERE {where_ecc}),
bw AS (SELECT * FROM raw_bw WHERE {where_bw})"""


def _sales(as_of=AS_OF, ecc="ecc", bw="bw", name="sales") -> str:
    up = as_money(half_up(f"100 * {cents('sales_amount')}", cents("sales_quantity")))
    return f""",
{name} AS (
  SELECT customer_id, product_code, order_number, order_date AS sales_date,
         total_amount AS sales_amount, quantity AS sales_quantity, unit_price, region,
         'Direct' AS channel, sales_rep, 'SAP_ECC' AS data_source,
         {ts(as_of)} AS created_date, TRUE AS is_active, processed_date
  FROM {ecc}
  UNION ALL
  SELECT customer_id, product_code, CAST(NULL AS VARCHAR), sales_date, sales_amount, sales_quantity,
         CASE WHEN sales_quantity = 0 THEN NULL ELSE {up} END,
         region, channel, sales_rep, 'SAP_BW', {ts(as_of)}, TRUE, processed_date
  FROM {bw}
)"""


def _customers(as_of=AS_OF, ecc="ecc", bw="bw", name="customers") -> str:
    return f""",
{name}_facts AS (
  SELECT customer_id, 1 AS src, order_number, total_amount AS amount, order_date AS sale_ts,
         region, sales_rep, CAST(NULL AS VARCHAR) AS customer_segment, processed_date FROM {ecc}
  UNION ALL
  SELECT customer_id, 0, CAST(NULL AS VARCHAR), sales_amount, sales_date,
         region, sales_rep, customer_segment, processed_date FROM {bw}
),
{name} AS (
  SELECT customer_id, CAST(NULL AS VARCHAR) AS customer_name,
    arg_max(customer_segment, row(processed_date, customer_segment)) FILTER (WHERE customer_segment IS NOT NULL) AS customer_segment,
    arg_max(region, row(src, processed_date, region)) FILTER (WHERE region IS NOT NULL) AS region,
    arg_max(sales_rep, row(src, processed_date, sales_rep)) FILTER (WHERE sales_rep IS NOT NULL) AS sales_rep,
    count(order_number) AS total_orders,
    coalesce(sum(amount), 0) AS total_sales_amount,
    max(sale_ts) AS last_order_date,
    {ts(as_of)} AS created_date, {ts(as_of)} AS updated_date, TRUE AS is_active
  FROM {name}_facts GROUP BY customer_id
)"""


def _products(as_of=AS_OF, ecc="ecc", bw="bw", name="products", mode="reference") -> str:
    if mode == "reference":
        den = "price_n * (CASE WHEN min_src = 0 THEN 2 ELSE 1 END)"
        other = "CAST(0 AS DECIMAL(18,2))"
    else:
        den = "price_n"
        other = "CAST(NULL AS DECIMAL(18,2))"
    price = as_money(half_up(cents("price_sum"), den))
    return f""",
{name}_facts AS (
  SELECT product_code, 1 AS src, quantity AS qty, total_amount AS amount, unit_price,
         CAST(NULL AS VARCHAR) AS product_category, processed_date FROM {ecc}
  UNION ALL
  SELECT product_code, 0, sales_quantity, sales_amount, CAST(NULL AS DECIMAL(18,2)),
         product_category, processed_date FROM {bw}
),
{name}_agg AS (
  SELECT product_code, coalesce(sum(qty), 0) AS total_quantity_sold,
         coalesce(sum(amount), 0) AS total_sales_amount,
         sum(unit_price) AS price_sum, count(unit_price) AS price_n,
         max(src) AS max_src, min(src) AS min_src,
         arg_max(product_category, row(processed_date, product_category)) FILTER (WHERE product_category IS NOT NULL) AS product_category
  FROM {name}_facts GROUP BY product_code
),
{name} AS (
  SELECT product_code, CAST(NULL AS VARCHAR) AS product_name, product_category,
         CASE WHEN max_src = 1 THEN {price} ELSE {other} END AS unit_price,
         total_quantity_sold, total_sales_amount,
         {ts(as_of)} AS created_date, {ts(as_of)} AS updated_date, TRUE AS is_active
  FROM {name}_agg
)"""


WAREHOUSE = _base() + _sales() + _customers() + _products()


def with_wh(tail_ctes: str, select: str) -> str:
    """Full statement: shared CTEs, extra CTEs (each starting with ','),
    final SELECT."""
    return f"WITH {WAREHOUSE}{tail_ctes}\n{select}"


def D(col: str, alias: str | None = None) -> str:
    """Decimal column as double."""
    return f"CAST({col} AS DOUBLE) AS {alias or col}"


SALES_COLS = ("customer_id, product_code, order_number, sales_date, CAST(sales_amount AS DOUBLE) AS sales_amount, "
              "CAST(sales_quantity AS DOUBLE) AS sales_quantity, CAST(unit_price AS DOUBLE) AS unit_price, "
              "region, channel, sales_rep, data_source, created_date, is_active, processed_date")

CUSTOMER_COLS = ("customer_id, customer_name, customer_segment, region, sales_rep, total_orders, "
                 "CAST(total_sales_amount AS DOUBLE) AS total_sales_amount, last_order_date, "
                 "created_date, updated_date, is_active")

PRODUCT_COLS = ("product_code, product_name, product_category, CAST(unit_price AS DOUBLE) AS unit_price, "
                "CAST(total_quantity_sold AS DOUBLE) AS total_quantity_sold, "
                "CAST(total_sales_amount AS DOUBLE) AS total_sales_amount, created_date, updated_date, is_active")

ECC_COLS = ("customer_id, order_number, order_date, product_code, CAST(quantity AS DOUBLE) AS quantity, "
            "CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount, status, "
            "sales_rep, region, processed_date")
BW_COLS = ("customer_id, product_code, CAST(sales_amount AS DOUBLE) AS sales_amount, "
           "CAST(sales_quantity AS DOUBLE) AS sales_quantity, sales_date, sales_rep, region, channel, "
           "product_category, customer_segment, processed_date")

ENRICHED = ("s.customer_id, s.product_code, s.order_number, s.sales_date, CAST(s.sales_amount AS DOUBLE) AS sales_amount, "
            "CAST(s.sales_quantity AS DOUBLE) AS sales_quantity, CAST(s.unit_price AS DOUBLE) AS unit_price, "
            "s.region, s.channel, s.sales_rep, s.data_source, c.customer_segment, p.product_category")

ENRICHED_FROM = ("FROM sales s LEFT JOIN customers c ON s.customer_id = c.customer_id "
                 "LEFT JOIN products p ON s.product_code = p.product_code")


def _perf(key: str, where: str) -> str:
    return (f"SELECT {key}, count(*) AS total_sales, count(DISTINCT customer_id) AS unique_customers, "
            f"CAST(sum(sales_quantity) AS DOUBLE) AS total_quantity_sold, "
            f"CAST(sum(sales_amount) AS DOUBLE) AS total_sales_amount, "
            f"CAST(sum(sales_amount) AS DOUBLE) / count(sales_amount) AS average_sale_amount "
            f"FROM sales WHERE is_active AND {where} GROUP BY {key}")


def _product_perf(where: str) -> str:
    return ("SELECT s.product_code, p.product_category, count(*) AS total_sales, "
            "CAST(sum(s.sales_quantity) AS DOUBLE) AS total_quantity_sold, "
            "CAST(sum(s.sales_amount) AS DOUBLE) AS total_sales_amount, "
            "CAST(sum(s.unit_price) AS DOUBLE) / count(s.unit_price) AS average_unit_price, "
            "min(s.sales_date) AS first_sale_date, max(s.sales_date) AS last_sale_date "
            "FROM sales s LEFT JOIN products p ON s.product_code = p.product_code "
            f"WHERE s.is_active AND {where} GROUP BY s.product_code, p.product_category")


def _top_customers(where: str, k: int = TOP_K) -> str:
    return ("SELECT s.customer_id, c.customer_segment, c.region, c.sales_rep, count(*) AS total_orders, "
            "CAST(sum(s.sales_quantity) AS DOUBLE) AS total_quantity_purchased, "
            "CAST(sum(s.sales_amount) AS DOUBLE) AS total_sales_amount, "
            "CAST(sum(s.sales_amount) AS DOUBLE) / count(s.sales_amount) AS average_order_value, "
            "max(s.sales_date) AS last_order_date "
            "FROM sales s LEFT JOIN customers c ON s.customer_id = c.customer_id "
            f"WHERE s.is_active AND {where} "
            "GROUP BY s.customer_id, c.customer_segment, c.region, c.sales_rep "
            f"ORDER BY total_sales_amount DESC, s.customer_id LIMIT {k}")


def _scan(days=None) -> str:
    w = lookback("s.sales_date", days) if days else "TRUE"
    return f""",
scan AS (
  SELECT s.customer_id, s.product_code, s.sales_date, s.sales_amount, s.sales_quantity, s.unit_price,
         s.region, s.channel, s.sales_rep, s.data_source, c.customer_segment, p.product_category
  FROM sales s LEFT JOIN customers c ON s.customer_id = c.customer_id
  LEFT JOIN products p ON s.product_code = p.product_code
  WHERE s.is_active AND {w}
)"""


_DAILY = """,
daily AS (
  SELECT CAST(sales_date AS DATE) AS sales_day, sum(sales_amount) AS total_sales,
         sum(sales_quantity) AS total_quantity, count(DISTINCT customer_id) AS unique_customers
  FROM scan GROUP BY 1
),
halves AS (
  SELECT *, row_number() OVER (ORDER BY sales_day) AS rn, count(*) OVER () AS n FROM daily
),
growth AS (
  SELECT count(*) AS n_days, sum(total_sales) AS s_all,
         coalesce(sum(total_sales) FILTER (WHERE rn <= n // 2), 0) AS s1
  FROM halves
),
growth_out AS (
  SELECT n_days,
    CASE WHEN n_days // 2 > 0 THEN CAST(s1 AS DOUBLE) / (n_days // 2) END AS first_half_mean,
    CASE WHEN n_days - n_days // 2 > 0 THEN CAST(s_all - s1 AS DOUBLE) / (n_days - n_days // 2) END AS second_half_mean,
    CASE WHEN n_days < 2 OR s1 = 0 THEN 0.0
         ELSE CAST((s_all - s1) * (n_days // 2) - s1 * (n_days - n_days // 2) AS DOUBLE)
              / CAST(s1 * (n_days - n_days // 2) AS DOUBLE) * 100.0 END AS sales_growth_rate
  FROM growth
)"""

_TRENDS = """
SELECT CAST(sum(d.total_sales) AS DOUBLE) AS total_sales,
       CAST(sum(d.total_sales) AS DOUBLE) / count(*) AS average_daily_sales,
       (SELECT sales_growth_rate FROM growth_out) AS sales_growth_rate,
       CAST(sum(d.unique_customers) AS BIGINT) AS total_unique_customers,
       CAST(sum(d.unique_customers) AS DOUBLE) / count(*) AS average_daily_customers,
       (SELECT count(DISTINCT customer_id) FROM scan) AS distinct_customers,
       count(*) AS days
FROM daily d"""

_CA = f""",
ca AS (
  SELECT customer_id, sum(sales_amount) AS total_sales, count(sales_amount) AS order_count,
         {mean2('sales_amount')} AS aov_c,
         sum(sales_quantity) AS total_quantity, min(sales_date) AS first_order, max(sales_date) AS last_order,
         arg_max(customer_segment, row(sales_date, customer_segment)) FILTER (WHERE customer_segment IS NOT NULL) AS segment,
         arg_max(region, row(sales_date, region)) FILTER (WHERE region IS NOT NULL) AS region
  FROM scan GROUP BY customer_id
)"""

_PA = f""",
pa AS (
  SELECT product_code, sum(sales_amount) AS total_sales, count(sales_amount) AS order_count,
         {mean2('sales_amount')} AS aov_c, sum(sales_quantity) AS total_quantity,
         {mean2('unit_price')} AS aup_c,
         arg_max(product_category, row(sales_date, product_category)) FILTER (WHERE product_category IS NOT NULL) AS category
  FROM scan GROUP BY product_code
)"""


def _dim(key: str, other: str, other_name: str) -> str:
    return f""",
da AS (
  SELECT {key}, sum(sales_amount) AS total_sales, count(sales_amount) AS order_count,
         {mean2('sales_amount')} AS aov_c, sum(sales_quantity) AS total_quantity,
         count(DISTINCT customer_id) AS unique_customers, count(DISTINCT {other}) AS {other_name}
  FROM scan WHERE {key} IS NOT NULL GROUP BY {key}
)"""


def _dim_summary(key: str, n_name: str, avg_name: str, best_name: str, best_sales: str) -> str:
    return (f"SELECT count(*) AS {n_name}, CAST(sum(total_sales) AS DOUBLE) / count(*) AS {avg_name}, "
            f"arg_min({key}, row(-total_sales, {key})) AS {best_name}, "
            f"CAST(max(total_sales) AS DOUBLE) AS {best_sales} FROM da")


_DA_COLS = ("CAST(total_sales AS DOUBLE) AS total_sales, order_count, "
            f"{dbl_cents('aov_c')} AS avg_order_value, CAST(total_quantity AS DOUBLE) AS total_quantity, "
            "unique_customers")


# ----------------------------------------------------------------- documents

def _n2(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


def _opt(prefix: str, x: str, suffix: str = "") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN '{prefix}' || CAST({x} AS VARCHAR) || '{suffix}' ELSE '' END"


DOC_CUSTOMERS = f"""
SELECT customer_id AS id, 'Customer: ' || customer_id AS title,
  'Customer ID: ' || customer_id || {_opt(', Segment: ', 'customer_segment')}
   || {_opt(', Region: ', 'region')} || {_opt(', Sales Rep: ', 'sales_rep')}
   || ', Total Orders: ' || CAST(total_orders AS VARCHAR)
   || ', Total Sales: $' || coalesce({_n2('total_sales_amount')}, '')
   || CASE WHEN last_order_date IS NOT NULL THEN ', Last Order: ' || strftime(last_order_date, '%Y-%m-%d') ELSE '' END AS content,
  'Customer' AS category, updated_date AS "timestamp",
  'CustomerID:' || customer_id || '|Segment:' || coalesce(customer_segment, '') || '|Region:' || coalesce(region, '')
   || '|SalesRep:' || coalesce(sales_rep, '') AS metadata,
  customer_id, CAST(NULL AS VARCHAR) AS product_code, region, sales_rep, 'Customer' AS data_source,
  CAST(total_sales_amount AS DOUBLE) AS sales_amount, CAST(NULL AS DOUBLE) AS sales_quantity,
  CAST(NULL AS VARCHAR) AS order_number, last_order_date AS sales_date
FROM customers WHERE is_active"""

DOC_SALES = f"""
SELECT customer_id || '-' || product_code || '-' || coalesce(order_number, 'NO-ORDER') || '-' || strftime(sales_date, '%Y%m%d') AS id,
  'Sale: ' || customer_id || ' - ' || product_code || {_opt(' (Order: ', 'order_number', ')')} AS title,
  'Customer: ' || customer_id || ', Product: ' || product_code || {_opt(', Order: ', 'order_number')}
   || ', Date: ' || strftime(sales_date, '%Y-%m-%d') || ', Amount: $' || {_n2('sales_amount')}
   || ', Quantity: ' || CAST(sales_quantity AS VARCHAR) || {_opt(', Region: ', 'region')}
   || {_opt(', Sales Rep: ', 'sales_rep')} || ', Source: ' || data_source AS content,
  'Sales' AS category, created_date AS "timestamp",
  'CustomerID:' || customer_id || '|ProductCode:' || product_code || '|OrderNumber:' || coalesce(order_number, '')
   || '|Region:' || coalesce(region, '') || '|SalesRep:' || coalesce(sales_rep, '') || '|DataSource:' || data_source AS metadata,
  customer_id, product_code, region, sales_rep, data_source,
  CAST(sales_amount AS DOUBLE) AS sales_amount, CAST(sales_quantity AS DOUBLE) AS sales_quantity,
  order_number, sales_date
FROM sales WHERE is_active AND {lookback('created_date', INSIGHT_DAYS)}"""

DOC_PRODUCTS = f"""
SELECT 'PROD-' || product_code AS id, 'Product: ' || product_code AS title,
  'Product Code: ' || product_code || {_opt(', Category: ', 'product_category')}
   || ', Total Quantity Sold: ' || CAST(total_quantity_sold AS VARCHAR)
   || ', Total Sales: $' || {_n2('total_sales_amount')}
   || CASE WHEN unit_price IS NOT NULL THEN ', Unit Price: $' || {_n2('unit_price')} ELSE '' END AS content,
  'Product' AS category, updated_date AS "timestamp",
  'ProductCode:' || product_code || '|Category:' || coalesce(product_category, '')
   || '|UnitPrice:' || coalesce(CAST(unit_price AS VARCHAR), '') AS metadata,
  CAST(NULL AS VARCHAR) AS customer_id, product_code, CAST(NULL AS VARCHAR) AS region,
  CAST(NULL AS VARCHAR) AS sales_rep, 'Product' AS data_source,
  CAST(total_sales_amount AS DOUBLE) AS sales_amount, CAST(total_quantity_sold AS DOUBLE) AS sales_quantity,
  CAST(NULL AS VARCHAR) AS order_number, CAST(NULL AS TIMESTAMP) AS sales_date
FROM products WHERE is_active"""

DOCS_ALL_CTE = f""",
docs_union AS ({DOC_CUSTOMERS} UNION ALL {DOC_SALES} UNION ALL {DOC_PRODUCTS}),
docs_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY "timestamp" DESC, content DESC, metadata DESC) AS rn
  FROM docs_union
),
docs AS (
  SELECT id, title, content, category, "timestamp", metadata, customer_id, product_code, region, sales_rep,
         data_source, sales_amount, sales_quantity, order_number, sales_date
  FROM docs_ranked WHERE rn = 1
)"""


# --------------------------------------------------------------- upserts

def _split_wh() -> str:
    before = f"processed_date < {ts(UPSERT_SPLIT)}"
    after = f"processed_date >= {ts(UPSERT_SPLIT)}"
    return (f""",
ecc_old AS (SELECT * FROM ecc WHERE {before}),
bw_old AS (SELECT * FROM bw WHERE {before}),
ecc_new AS (SELECT * FROM ecc WHERE {after}),
bw_new AS (SELECT * FROM bw WHERE {after})"""
            + _customers(UPSERT_SPLIT, "ecc_old", "bw_old", "cust_old")
            + _customers(AS_OF, "ecc_new", "bw_new", "cust_new")
            + _products(UPSERT_SPLIT, "ecc_old", "bw_old", "prod_old")
            + _products(AS_OF, "ecc_new", "bw_new", "prod_new"))


def _upsert_sql(key, cols, update, old, new) -> str:
    out = []
    for c in cols:
        if c == key:
            v = f"coalesce(t.{c}, s.{c})"
        elif c in update:
            v = f"CASE WHEN s.{key} IS NOT NULL THEN s.{c} ELSE t.{c} END"
        elif c == "updated_date":
            v = f"CASE WHEN s.{key} IS NOT NULL THEN {ts(AS_OF)} ELSE t.{c} END"
        elif c == "created_date":
            v = f"CASE WHEN t.{key} IS NULL THEN {ts(AS_OF)} ELSE t.{c} END"
        elif c == "is_active":
            v = f"CASE WHEN t.{key} IS NULL THEN TRUE ELSE t.{c} END"
        else:
            v = f"CASE WHEN t.{key} IS NULL THEN s.{c} ELSE t.{c} END"
        if c in ("total_sales_amount", "total_quantity_sold", "unit_price"):
            v = f"CAST({v} AS DOUBLE)"
        out.append(f"{v} AS {c}")
    return f"SELECT {', '.join(out)} FROM {old} t FULL OUTER JOIN {new} s ON t.{key} = s.{key}"


_CUST_COLS = ["customer_id", "customer_name", "customer_segment", "region", "sales_rep", "total_orders",
              "total_sales_amount", "last_order_date", "created_date", "updated_date", "is_active"]
_PROD_COLS = ["product_code", "product_name", "product_category", "unit_price", "total_quantity_sold",
              "total_sales_amount", "created_date", "updated_date", "is_active"]


# -------------------------------------------------------------- streaming

def _alerts(size_min: int, slide_min: int, threshold: int, event_type: str = "error") -> str:
    k = size_min // slide_min
    return f"""
SELECT ws AS window_start, ws + to_minutes({size_min}) AS window_end, count(*) AS events
FROM (
  SELECT time_bucket(to_minutes({slide_min}), ts) - to_minutes(CAST(k * {slide_min} AS INTEGER)) AS ws
  FROM (SELECT ts, unnest(generate_series(0, {k - 1})) AS k FROM events WHERE event_type = '{event_type}')
)
GROUP BY ws HAVING count(*) > {threshold}"""


def _alerts_closed(size_min: int, slide_min: int, threshold: int, delay_min: int = 10) -> str:
    """The streaming twin in append mode: windows whose end has passed the
    final watermark (latest error time minus the delay)."""
    return (f"SELECT * FROM ({_alerts(size_min, slide_min, threshold)}) a "
            f"WHERE window_end <= (SELECT max(ts) FROM events WHERE event_type = 'error') "
            f"- INTERVAL {delay_min} MINUTE")


# ----------------------------------------------------------------- queries

FR = dict(start=FILTER["start"], end=FILTER["end"])

def _recent_wh() -> str:
    w = lookback('processed_date', RAW_LOOKBACK_DAYS)
    return f"WITH {_base(w, w)}{_sales()}{_customers()}{_products()}"


ORACLE_SQL: dict[str, str] = {
    "scan_raw_ecc": with_wh("", f"SELECT {ECC_COLS} FROM raw_ecc WHERE is_active AND NOT is_deleted"),
    "scan_raw_bw": with_wh("", f"SELECT {BW_COLS} FROM raw_bw WHERE is_active AND NOT is_deleted"),
    "scan_raw_ecc_recent": with_wh("", f"SELECT {ECC_COLS} FROM raw_ecc WHERE is_active AND NOT is_deleted AND {lookback('processed_date', RAW_LOOKBACK_DAYS)}"),
    "scan_raw_bw_recent": with_wh("", f"SELECT {BW_COLS} FROM raw_bw WHERE is_active AND NOT is_deleted AND {lookback('processed_date', RAW_LOOKBACK_DAYS)}"),
    "sales_unified": with_wh("", f"SELECT {SALES_COLS} FROM sales"),
    "customer_rollup_ecc": with_wh("", """
SELECT customer_id, count(order_number) AS total_orders,
       CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS total_sales_amount, max(order_date) AS last_order_date,
       arg_max(region, row(processed_date, region)) FILTER (WHERE region IS NOT NULL) AS region,
       arg_max(sales_rep, row(processed_date, sales_rep)) FILTER (WHERE sales_rep IS NOT NULL) AS sales_rep,
       'SAP_ECC' AS data_source
FROM ecc GROUP BY customer_id"""),
    "customer_rollup_bw": with_wh("", """
SELECT customer_id, CAST(coalesce(sum(sales_amount), 0) AS DOUBLE) AS total_sales_amount,
       CAST(coalesce(sum(sales_quantity), 0) AS DOUBLE) AS total_quantity, max(sales_date) AS last_order_date,
       arg_max(region, row(processed_date, region)) FILTER (WHERE region IS NOT NULL) AS region,
       arg_max(customer_segment, row(processed_date, customer_segment)) FILTER (WHERE customer_segment IS NOT NULL) AS customer_segment,
       arg_max(sales_rep, row(processed_date, sales_rep)) FILTER (WHERE sales_rep IS NOT NULL) AS sales_rep,
       CAST(0 AS BIGINT) AS total_orders, 'SAP_BW' AS data_source
FROM bw GROUP BY customer_id"""),
    "customers": with_wh("", f"SELECT {CUSTOMER_COLS} FROM customers"),
    "customers_recent": f"WITH {_base(lookback('processed_date', RAW_LOOKBACK_DAYS), lookback('processed_date', RAW_LOOKBACK_DAYS))}{_customers()}\nSELECT {CUSTOMER_COLS} FROM customers",
    "product_rollup_ecc": with_wh("", """
SELECT product_code, CAST(coalesce(sum(quantity), 0) AS DOUBLE) AS total_quantity_sold,
       CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS total_sales_amount,
       CAST(sum(unit_price) AS DOUBLE) / count(unit_price) AS unit_price, 'SAP_ECC' AS data_source
FROM ecc GROUP BY product_code"""),
    "product_rollup_bw": with_wh("", """
SELECT product_code, CAST(coalesce(sum(sales_quantity), 0) AS DOUBLE) AS total_quantity_sold,
       CAST(coalesce(sum(sales_amount), 0) AS DOUBLE) AS total_sales_amount,
       arg_max(product_category, row(processed_date, product_category)) FILTER (WHERE product_category IS NOT NULL) AS product_category,
       CAST(0 AS DOUBLE) AS unit_price, 'SAP_BW' AS data_source
FROM bw GROUP BY product_code"""),
    "products": with_wh("", f"SELECT {PRODUCT_COLS} FROM products"),
    "products_ecc_price": with_wh(_products(mode="ecc_only", name="products_e"), f"SELECT {PRODUCT_COLS} FROM products_e"),
    "customer_lookup": with_wh("", f"""
SELECT customer_id, customer_segment, region, sales_rep, total_orders,
       coalesce(CAST(total_sales_amount AS DOUBLE), 0.0) AS total_sales_amount,
       last_order_date, created_date, updated_date
FROM customers WHERE is_active AND customer_id = '{LOOKUP_CUSTOMER}'"""),
    "product_lookup": with_wh("", f"""
SELECT product_code, product_category, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(total_quantity_sold AS DOUBLE) AS total_quantity_sold,
       CAST(total_sales_amount AS DOUBLE) AS total_sales_amount, created_date, updated_date
FROM products WHERE is_active AND product_code = '{LOOKUP_PRODUCT}'"""),
    "sales_enriched": with_wh("", f"SELECT {ENRICHED} {ENRICHED_FROM} WHERE s.is_active"),
    "sales_enriched_filtered": with_wh("", f"SELECT {ENRICHED} {ENRICHED_FROM} WHERE s.is_active AND {sales_where(prefix='s.', **FILTER)}"),
    "customer_orders": with_wh("", f"""
SELECT s.order_number, s.sales_date, s.product_code, CAST(s.sales_amount AS DOUBLE) AS sales_amount,
       CAST(s.sales_quantity AS DOUBLE) AS sales_quantity, CAST(s.unit_price AS DOUBLE) AS unit_price,
       s.region, s.channel, s.sales_rep, p.product_category
FROM sales s LEFT JOIN products p ON s.product_code = p.product_code
WHERE s.customer_id = '{LOOKUP_CUSTOMER}' AND s.is_active
ORDER BY s.sales_date DESC, s.product_code, s.order_number NULLS LAST, s.sales_amount DESC,
         s.sales_quantity DESC, s.channel
LIMIT 50"""),
    "latest_orders_per_customer": with_wh(f""",
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY sales_date DESC, product_code,
         order_number NULLS LAST, sales_amount DESC, sales_quantity DESC, channel) AS rank
  FROM sales WHERE is_active
)""", f"""
SELECT s.customer_id, s.rank, s.order_number, s.sales_date, s.product_code, CAST(s.sales_amount AS DOUBLE) AS sales_amount,
       CAST(s.sales_quantity AS DOUBLE) AS sales_quantity, CAST(s.unit_price AS DOUBLE) AS unit_price,
       s.region, s.channel, s.sales_rep, p.product_category
FROM ranked s LEFT JOIN products p ON s.product_code = p.product_code WHERE s.rank <= {TOP_K}"""),
    "product_performance": with_wh("", _product_perf("TRUE")),
    "product_performance_filtered": with_wh("", _product_perf(sales_where(prefix="s.", **FR))),
    "regional_sales": with_wh("", _perf("region", "TRUE")),
    "regional_sales_filtered": with_wh("", _perf("region", sales_where(**FR))),
    "rep_performance": with_wh("", _perf("sales_rep", "sales_rep IS NOT NULL")),
    "rep_performance_filtered": with_wh("", _perf("sales_rep", "sales_rep IS NOT NULL AND " + sales_where(**FR))),
    "top_customers": with_wh("", _top_customers("TRUE")),
    "top_customers_filtered": with_wh("", _top_customers(sales_where(prefix="s.", **FR))),
    # insights
    "daily_sales": with_wh(_scan() + _DAILY, """
SELECT sales_day, CAST(total_sales AS DOUBLE) AS total_sales, CAST(total_quantity AS DOUBLE) AS total_quantity,
       unique_customers FROM daily"""),
    "sales_trends": with_wh(_scan() + _DAILY, _TRENDS),
    "sales_trends_30d": with_wh(_scan(INSIGHT_DAYS) + _DAILY, _TRENDS),
    "sales_growth": with_wh(_scan() + _DAILY, "SELECT * FROM growth_out"),
    "top_days": with_wh(_scan() + _DAILY, """
SELECT sales_day, CAST(total_sales AS DOUBLE) AS total_sales FROM daily
ORDER BY total_sales DESC, sales_day LIMIT 5"""),
    "customer_analysis": with_wh(_scan() + _CA, f"""
SELECT customer_id, CAST(total_sales AS DOUBLE) AS total_sales, order_count, {dbl_cents('aov_c')} AS avg_order_value,
       CAST(total_quantity AS DOUBLE) AS total_quantity, first_order, last_order, segment, region FROM ca"""),
    "segment_analysis": with_wh(_scan() + _CA, f"""
SELECT segment, count(customer_id) AS customer_count, CAST(sum(total_sales) AS DOUBLE) AS total_sales,
       {dbl_cents(half_even('sum(aov_c)', 'count(aov_c)'))} AS avg_order_value
FROM ca WHERE segment IS NOT NULL GROUP BY segment"""),
    "retention": with_wh(_scan() + _CA, f"""
SELECT count(*) AS total_customers,
       count(*) FILTER (WHERE last_order >= CAST(CAST({ts(AS_OF)} - INTERVAL 7 DAY AS DATE) AS TIMESTAMP)) AS recent_customers,
       count(*) FILTER (WHERE order_count > 1) AS returning_customers,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE order_count > 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END AS customer_retention_rate
FROM ca"""),
    "retention_30d": with_wh(_scan(INSIGHT_DAYS) + _CA, f"""
SELECT count(*) AS total_customers,
       count(*) FILTER (WHERE last_order >= CAST(CAST({ts(AS_OF)} - INTERVAL 7 DAY AS DATE) AS TIMESTAMP)) AS recent_customers,
       count(*) FILTER (WHERE order_count > 1) AS returning_customers,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE order_count > 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END AS customer_retention_rate
FROM ca"""),
    "top10_customers": with_wh(_scan() + _CA, f"""
SELECT customer_id, CAST(total_sales AS DOUBLE) AS total_sales, order_count, {dbl_cents('aov_c')} AS avg_order_value,
       segment, region FROM ca ORDER BY total_sales DESC, customer_id LIMIT 10"""),
    "product_analysis": with_wh(_scan() + _PA, f"""
SELECT product_code, CAST(total_sales AS DOUBLE) AS total_sales, order_count, {dbl_cents('aov_c')} AS avg_order_value,
       CAST(total_quantity AS DOUBLE) AS total_quantity, {dbl_cents('aup_c')} AS avg_unit_price, category FROM pa"""),
    "category_analysis": with_wh(_scan() + _PA, f"""
SELECT category, count(product_code) AS product_count, CAST(sum(total_sales) AS DOUBLE) AS total_sales,
       CAST(sum(total_quantity) AS DOUBLE) AS total_quantity,
       {dbl_cents(half_even('sum(aup_c)', 'count(aup_c)'))} AS avg_unit_price
FROM pa WHERE category IS NOT NULL GROUP BY category"""),
    "product_summary": with_wh(_scan() + _PA, """
SELECT count(*) AS total_products,
       count(*) FILTER (WHERE CAST(total_sales AS DOUBLE) > (SELECT quantile_cont(CAST(total_sales AS DOUBLE), 0.8) FROM pa)) AS high_performing_products,
       CASE WHEN count(*) > 0 THEN CAST(count(*) FILTER (WHERE CAST(total_sales AS DOUBLE) > (SELECT quantile_cont(CAST(total_sales AS DOUBLE), 0.8) FROM pa)) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0 ELSE 0.0 END AS product_diversity_score
FROM pa"""),
    "top10_products": with_wh(_scan() + _PA, f"""
SELECT product_code, CAST(total_sales AS DOUBLE) AS total_sales, CAST(total_quantity AS DOUBLE) AS total_quantity,
       {dbl_cents('aup_c')} AS avg_unit_price, category FROM pa ORDER BY total_sales DESC, product_code LIMIT 10"""),
    "region_analysis": with_wh(_scan() + _dim("region", "sales_rep", "sales_reps"),
                               f"SELECT region, {_DA_COLS}, sales_reps FROM da"),
    "region_summary": with_wh(_scan() + _dim("region", "sales_rep", "sales_reps"),
                              _dim_summary("region", "total_regions", "average_sales_per_region",
                                           "best_performing_region", "best_region_sales")),
    "top5_regions": with_wh(_scan() + _dim("region", "sales_rep", "sales_reps"), """
SELECT region, CAST(total_sales AS DOUBLE) AS total_sales, order_count, unique_customers, sales_reps
FROM da ORDER BY total_sales DESC, region LIMIT 5"""),
    "rep_analysis": with_wh(_scan() + _dim("sales_rep", "region", "regions"),
                            f"SELECT sales_rep, {_DA_COLS}, regions FROM da"),
    "rep_summary": with_wh(_scan() + _dim("sales_rep", "region", "regions"),
                           _dim_summary("sales_rep", "total_sales_reps", "average_sales_per_rep",
                                        "top_performing_rep", "top_rep_sales")),
    "top5_reps": with_wh(_scan() + _dim("sales_rep", "region", "regions"), """
SELECT sales_rep, CAST(total_sales AS DOUBLE) AS total_sales, order_count, unique_customers, regions
FROM da ORDER BY total_sales DESC, sales_rep LIMIT 5"""),
    # documents
    "docs_customers": with_wh("", DOC_CUSTOMERS),
    "docs_sales": with_wh("", DOC_SALES),
    "docs_products": with_wh("", DOC_PRODUCTS),
    "docs_all": with_wh(DOCS_ALL_CTE, "SELECT * FROM docs"),
    "doc_facets": with_wh(DOCS_ALL_CTE, """
SELECT 'category' AS facet, category AS value, count(*) AS documents FROM docs GROUP BY category
UNION ALL
SELECT 'region', region, count(*) FROM docs GROUP BY region"""),
    # sinks
    "upsert_customers": with_wh(_split_wh(), _upsert_sql(
        "customer_id", _CUST_COLS, ("customer_segment", "region", "sales_rep", "total_orders",
                                    "total_sales_amount", "last_order_date"), "cust_old", "cust_new")),
    "upsert_products": with_wh(_split_wh(), _upsert_sql(
        "product_code", _PROD_COLS, ("product_category", "unit_price", "total_quantity_sold",
                                     "total_sales_amount"), "prod_old", "prod_new")),
    "replace_window_sales": with_wh("", f"SELECT {SALES_COLS} FROM sales"),
    # helpers
    "set_totals": with_wh("", f"""
SELECT count(*) AS rows, coalesce(CAST(sum(s.sales_amount) AS DOUBLE), 0.0) AS total_sales,
       coalesce(CAST(sum(s.sales_amount) AS DOUBLE) / count(*), 0.0) AS average_order_value
{ENRICHED_FROM} WHERE s.is_active AND {sales_where(prefix='s.', **FILTER)}"""),
    "unique_keys": with_wh("", f"""
SELECT DISTINCT 'customer' AS kind, s.customer_id AS key {ENRICHED_FROM} WHERE s.is_active AND {sales_where(prefix='s.', **FILTER)}
UNION ALL
SELECT DISTINCT 'product', s.product_code {ENRICHED_FROM} WHERE s.is_active AND {sales_where(prefix='s.', **FILTER)}"""),
    "rows_by_region": with_wh("", f"""
SELECT coalesce(nullif(s.region, ''), 'Unknown') AS group_key, {ENRICHED} {ENRICHED_FROM} WHERE s.is_active"""),
    "rows_by_customer": with_wh("", f"""
SELECT s.customer_id AS group_key, {ENRICHED} {ENRICHED_FROM} WHERE s.is_active"""),
    "validate_raw": with_wh("", """
SELECT 'ecc' AS kind, CASE WHEN quantity = 1 THEN 'missing quantity' END AS validation_errors, count(*) AS rows
FROM raw_ecc GROUP BY ALL
UNION ALL
SELECT 'bw', CASE WHEN 0 < sales_amount AND sales_amount < 2000 THEN 'negative sales_amount' END, count(*)
FROM raw_bw GROUP BY ALL"""),
    "document_roles": with_wh("", """
SELECT field, roles, documents FROM (
  SELECT unnest(['id', 'title', 'content', 'category', 'timestamp', 'metadata', 'customer_id', 'product_code', 'region',
                 'sales_rep', 'data_source', 'sales_amount', 'sales_quantity', 'order_number', 'sales_date']) AS field,
         unnest(['key', 'searchable', 'searchable', 'facetable,filterable', 'filterable,sortable', 'filterable', 'filterable',
                 'filterable', 'facetable,filterable', 'filterable', 'filterable', 'filterable,sortable', 'filterable,sortable',
                 'filterable', 'filterable,sortable']) AS roles,
         unnest([n, n, n, n, n, n, n, 0, r, p, n, n, 0, 0, l]) AS documents
  FROM (SELECT count(*) AS n, count(region) AS r, count(sales_rep) AS p, count(last_order_date) AS l FROM customers WHERE is_active))"""),
    "display_rows": with_wh("", """
SELECT customer_id, product_code, order_number, sales_date,
       CASE WHEN sales_amount < 0 THEN '-$' || format('{:,.2f}', -sales_amount) ELSE '$' || format('{:,.2f}', sales_amount) END AS amount_text,
       CASE WHEN sales_quantity = trunc(sales_quantity) THEN format('{:,}', CAST(sales_quantity AS BIGINT))
            ELSE rtrim(rtrim(format('{:,.3f}', sales_quantity), '0'), '.') END AS quantity_text,
       strftime(sales_date, '%b %-d, %Y') AS date_text,
       strftime(sales_date, '%b %-d, %Y, %I:%M %p') AS datetime_text
FROM sales"""),
    "product_performance_product": with_wh("", _product_perf(sales_where(prefix="s.", product_code=LOOKUP_PRODUCT))),
    "sales_enriched_customer": with_wh("", f"SELECT {ENRICHED} {ENRICHED_FROM} WHERE s.is_active AND s.customer_id = '{LOOKUP_CUSTOMER}'"),
    "customer_lookup_batch": with_wh("", f"""
SELECT customer_id, customer_segment, region, sales_rep, total_orders,
       coalesce(CAST(total_sales_amount AS DOUBLE), 0.0) AS total_sales_amount,
       last_order_date, created_date, updated_date
FROM customers
WHERE is_active AND customer_id IN (SELECT s.customer_id FROM sales s
                                    WHERE s.is_active AND {sales_where(prefix='s.', **FILTER)})"""),
    "products_recent": f"{_recent_wh()}\nSELECT {PRODUCT_COLS} FROM products",
    "sales_recent": f"{_recent_wh()}\nSELECT {SALES_COLS} FROM sales",
    "daily_sales_30d": with_wh(_scan(INSIGHT_DAYS) + _DAILY, """
SELECT sales_day, CAST(total_sales AS DOUBLE) AS total_sales, CAST(total_quantity AS DOUBLE) AS total_quantity,
       unique_customers FROM daily"""),
    "customer_analysis_30d": with_wh(_scan(INSIGHT_DAYS) + _CA, f"""
SELECT customer_id, CAST(total_sales AS DOUBLE) AS total_sales, order_count, {dbl_cents('aov_c')} AS avg_order_value,
       CAST(total_quantity AS DOUBLE) AS total_quantity, first_order, last_order, segment, region FROM ca"""),
    "product_analysis_30d": with_wh(_scan(INSIGHT_DAYS) + _PA, f"""
SELECT product_code, CAST(total_sales AS DOUBLE) AS total_sales, order_count, {dbl_cents('aov_c')} AS avg_order_value,
       CAST(total_quantity AS DOUBLE) AS total_quantity, {dbl_cents('aup_c')} AS avg_unit_price, category FROM pa"""),
    "region_analysis_30d": with_wh(_scan(INSIGHT_DAYS) + _dim("region", "sales_rep", "sales_reps"),
                                   f"SELECT region, {_DA_COLS}, sales_reps FROM da"),
    "rep_analysis_30d": with_wh(_scan(INSIGHT_DAYS) + _dim("sales_rep", "region", "regions"),
                                f"SELECT sales_rep, {_DA_COLS}, regions FROM da"),
    # streaming batch twins
    "error_alerts_5m": _alerts(5, 1, 5),
    "error_alerts_5m_low": _alerts(5, 1, ALERT_THRESHOLD_LOW),
    "failure_alerts_15m": _alerts(15, 5, 1),
    "failure_alerts_15m_stream": _alerts_closed(15, 5, 1),
    "error_alerts_5m_low_stream": _alerts_closed(5, 1, ALERT_THRESHOLD_LOW),
    "hourly_events_stream": """
SELECT * FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
         event_type, count(*) AS events
  FROM events GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "hourly_events": """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, count(*) AS events
FROM events GROUP BY 1, 2, 3""",
}


# ------------------------------------------------------------------ models

def _robust(rows: str, key: str, value: str, columns: str) -> str:
    """Rows far from their group's median, in whole units of 0.01."""
    return f"""
SELECT {columns}, med / 100 AS median, mad / 100 AS mad, CASE WHEN mad > 0 THEN (c - med) / (1.4826 * mad) END AS score
FROM (SELECT r.*, CAST({value} * 100 AS DOUBLE) AS c, med FROM {rows} r JOIN
        (SELECT {key} AS k, quantile_cont(CAST({value} * 100 AS DOUBLE), 0.5) AS med FROM {rows} GROUP BY {key}) m ON r.{key} IS NOT DISTINCT FROM m.k) x
JOIN (SELECT r.{key} AS k, quantile_cont(abs(CAST({value} * 100 AS DOUBLE) - med), 0.5) AS mad FROM {rows} r JOIN
        (SELECT {key} AS k, quantile_cont(CAST({value} * 100 AS DOUBLE), 0.5) AS med FROM {rows} GROUP BY {key}) m ON r.{key} IS NOT DISTINCT FROM m.k
      GROUP BY r.{key}) y ON x.{key} IS NOT DISTINCT FROM y.k
WHERE abs(c - med) > 3.0 * (1.4826 * mad)"""


_DAY_REGION = """,
day_region AS (SELECT region, CAST(sales_date AS DATE) AS sales_day, sum(sales_amount) AS total_sales FROM scan GROUP BY ALL)"""

_SERIES = """,
totals AS (SELECT region AS series, CAST(sales_date AS DATE) AS day, sum(sales_amount) AS total FROM scan WHERE region IS NOT NULL GROUP BY ALL),
span AS (SELECT series, min(day) AS first, max(day) AS last FROM totals GROUP BY series),
days AS (SELECT series, first, CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
series AS (SELECT d.series, d.day, date_diff('day', first, d.day) AS t, coalesce(total, 0) AS total
           FROM days d LEFT JOIN totals o ON d.series = o.series AND d.day = o.day)"""

_TREND = """
SELECT series, days, CASE WHEN uu > 0 THEN 2.0::DOUBLE * uy / uu / 100.0::DOUBLE END AS slope,
       CASE WHEN uu > 0 THEN y / days / 100.0::DOUBLE - (2.0::DOUBLE * uy / uu / 100.0::DOUBLE) * ((days - 1) / 2.0::DOUBLE) END AS intercept,
       CASE WHEN uu > 0 AND spread > 0 THEN uy * uy / uu * (CAST(days AS DOUBLE) / spread) END AS r2
FROM (SELECT series, n AS days, CAST(CAST(sum(u * c) AS VARCHAR) AS DOUBLE) AS uy, CAST(CAST(sum(u * u) AS VARCHAR) AS DOUBLE) AS uu,
             CAST(CAST(sum(c) AS VARCHAR) AS DOUBLE) AS y, CAST(CAST(n * sum(c * c) - sum(c) * sum(c) AS VARCHAR) AS DOUBLE) AS spread
      FROM (SELECT series, n, CAST(2 * t - (n - 1) AS HUGEINT) AS u, CAST(total * 100 AS HUGEINT) AS c
            FROM (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM series))
      GROUP BY series, n)"""

_LAGGED = """
SELECT series, day, t, CAST(total AS DOUBLE) AS total, dayofweek(day) + 1 AS weekday, CAST(l1 AS DOUBLE) AS lag_1, CAST(l7 AS DOUBLE) AS lag_7,
       CAST(l28 AS DOUBLE) AS lag_28, CAST(s7 AS DOUBLE) / 7 AS mean_7, CAST(s28 AS DOUBLE) / 28 AS mean_28
FROM (SELECT *, lag(total, 1) OVER w AS l1, lag(total, 7) OVER w AS l7, lag(total, 28) OVER w AS l28,
             sum(total) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7,
             sum(total) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS s28
      FROM series WINDOW w AS (PARTITION BY series ORDER BY day))
WHERE t >= 28"""

_NAIVE = """
SELECT series, fold, count(*) AS days, CAST(CAST(sum(off * off) AS VARCHAR) AS DOUBLE) / count(*) / 10000.0::DOUBLE AS mse
FROM (SELECT g.series, f.fold, CAST((total - guess) * 100 AS HUGEINT) AS off
      FROM (SELECT *, lag(total, 7) OVER (PARTITION BY series ORDER BY day) AS guess FROM series) g
      JOIN (SELECT series, last, unnest([1, 2, 3])::BIGINT AS fold FROM span) f ON f.series = g.series
      WHERE guess IS NOT NULL AND day >= last + CAST(1 - (4 - fold) * 28 AS INTEGER) AND day < last + CAST(1 - (3 - fold) * 28 AS INTEGER))
GROUP BY series, fold"""

_PAIRS = """,
items AS (SELECT DISTINCT order_number, product_code FROM sales WHERE is_active AND order_number IS NOT NULL),
support AS (SELECT product_code, count(*) AS n FROM items GROUP BY product_code),
pairs AS (SELECT x.product_code AS a, y.product_code AS b, count(*) AS orders
          FROM items x JOIN items y ON x.order_number = y.order_number AND x.product_code < y.product_code GROUP BY ALL HAVING count(*) >= 2)"""

ORACLE_SQL |= {
    "amount_quantiles": with_wh(_scan(), """
SELECT region, p, n, low + (high - low) * ((n - 1) * p - floor((n - 1) * p)) AS q
FROM (SELECT region, p, count(*) AS n, quantile_disc(CAST(sales_amount AS DOUBLE), 0.0) AS least,
             list_sort(list(CAST(sales_amount AS DOUBLE))) AS v, v[CAST(floor((count(*) - 1) * p) AS BIGINT) + 1] AS low, v[CAST(ceil((count(*) - 1) * p) AS BIGINT) + 1] AS high
      FROM scan, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE, 0.95::DOUBLE]) AS p) WHERE sales_amount IS NOT NULL GROUP BY region, p)"""),
    "sales_anomalies": with_wh(_scan() + _DAY_REGION, _robust("day_region", "region", "total_sales", "region, sales_day, CAST(total_sales AS DOUBLE) AS total_sales")),
    "quantity_anomalies": with_wh(_scan(), _robust("scan", "product_code", "sales_quantity", "product_code, customer_id, sales_date, CAST(sales_amount AS DOUBLE) AS sales_amount, CAST(sales_quantity AS DOUBLE) AS sales_quantity")),
    "forecast_trend": with_wh(_scan() + _SERIES, _TREND),
    "forecast_features": with_wh(_scan() + _SERIES, _LAGGED),
    "forecast_naive": with_wh(_scan() + _SERIES, _NAIVE),
    "co_purchase": with_wh(_PAIRS, "SELECT a, b, orders FROM pairs"),
    "recommendations": with_wh(_PAIRS, """
SELECT product_code, rank, recommended, orders, CAST(orders AS DOUBLE) / n AS confidence,
       CAST(orders * (SELECT count(DISTINCT order_number) FROM items) AS DOUBLE) / CAST(n * m AS DOUBLE) AS lift
FROM (SELECT e.*, row_number() OVER (PARTITION BY product_code ORDER BY orders DESC, recommended) AS rank
      FROM (SELECT a AS product_code, b AS recommended, orders FROM pairs UNION ALL SELECT b, a, orders FROM pairs) e)
JOIN support USING (product_code) JOIN (SELECT product_code AS recommended, n AS m FROM support) USING (recommended)
WHERE rank <= 3"""),
    "customer_rfm": with_wh(_scan(), f"""
SELECT customer_id, date_diff('day', CAST(max(sales_date) AS DATE), CAST({ts(AS_OF)} AS DATE)) AS recency, count(*) AS frequency,
       CAST(sum(sales_amount) * 100 AS BIGINT) AS money
FROM scan GROUP BY customer_id"""),
}

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
ORACLE_SQL |= {
    "docs_refreshed": with_wh("", f"""
SELECT id, CASE WHEN region = 'ASIA' AND category = 'Customer' THEN title || ' (changed)' ELSE title END AS title, content, category,
       CASE WHEN region = 'ASIA' AND category = 'Customer' THEN {_ISO.format('"timestamp" + INTERVAL 1 DAY')} ELSE {_ISO.format('"timestamp"')} END AS "timestamp",
       metadata, customer_id, product_code, region, sales_rep, data_source, sales_amount, sales_quantity, order_number, {_ISO.format('sales_date')} AS sales_date
FROM ({DOC_CUSTOMERS} UNION ALL {DOC_PRODUCTS}) WHERE region IS DISTINCT FROM 'EUROPE'"""),
    "refresh_batches": with_wh("", """
SELECT 'products' AS batch, (SELECT count(*) FROM products WHERE is_active) AS received, CAST(NULL AS VARCHAR) AS reason, 0::BIGINT AS rejected
UNION ALL SELECT 'texts', (SELECT count(*) FROM customers WHERE is_active AND region IN ('ASIA', 'AFRICA')) + 3, 'missing id', 3
UNION ALL SELECT 'deletions', (SELECT count(*) FROM customers WHERE is_active AND region = 'EUROPE'), NULL, 0"""),
}


def _alert_events(size_min: int, slide_min: int, threshold: int, closed: str = "TRUE") -> str:
    """Runs of windows above the threshold: their first end, and the end of the window after them."""
    windows = _alerts(size_min, slide_min, 0)
    return f"""
WITH w AS (SELECT window_end AS e, events FROM ({windows}) WHERE {closed.format(end='window_end')}),
h AS (SELECT e, lag(e) OVER (ORDER BY e) AS p, lead(e) OVER (ORDER BY e) AS n FROM w WHERE events > {threshold})
SELECT 'fire' AS kind, e AS at FROM h WHERE p IS NULL OR p < e - to_minutes({slide_min})
UNION ALL
SELECT 'resolve', e + to_minutes({slide_min}) FROM h
WHERE (n IS NULL OR n > e + to_minutes({slide_min})) AND e + to_minutes({slide_min}) <= (SELECT max(e) FROM w)"""


ORACLE_SQL |= {
    "last_day_events_stream": """
SELECT * FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events
  FROM events GROUP BY 1, 2, 3)
WHERE window_start > (SELECT time_bucket(INTERVAL 1 HOUR, max(ts)) FROM events) - INTERVAL 24 HOUR""",
    "error_alert_events": _alert_events(5, 1, ALERT_THRESHOLD_LOW),
    "error_alert_events_stream": _alert_events(5, 1, ALERT_THRESHOLD_LOW, "{end} <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 10 MINUTE"),
}


def _figures() -> str:
    """The scalars of the five summaries, one row each."""
    parts = []
    for report, name, numbers, texts in (
            ("sales_trends", "sales_trends", ("total_sales", "average_daily_sales", "sales_growth_rate", "total_unique_customers",
                                              "average_daily_customers", "distinct_customers", "days"), ()),
            ("customer_insights", "retention", ("total_customers", "recent_customers", "returning_customers", "customer_retention_rate"), ()),
            ("product_insights", "product_summary", ("total_products", "high_performing_products", "product_diversity_score"), ()),
            ("regional_insights", "region_summary", ("total_regions", "average_sales_per_region", "best_region_sales"), ("best_performing_region",)),
            ("sales_rep_insights", "rep_summary", ("total_sales_reps", "average_sales_per_rep", "top_rep_sales"), ("top_performing_rep",))):
        parts += [f"SELECT '{report}' AS report, '{n}' AS figure, CAST({n} AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS text FROM ({ORACLE_SQL[name]})" for n in numbers]
        parts += [f"SELECT '{report}', '{n}', NULL, {n} FROM ({ORACLE_SQL[name]})" for n in texts]
    return " UNION ALL ".join(parts)


ORACLE_SQL |= {"insight_figures": _figures(), "cube_days": ORACLE_SQL["daily_sales"], "cube_customers": ORACLE_SQL["customer_analysis"],
               "cube_products": ORACLE_SQL["product_analysis"], "cube_regions": ORACLE_SQL["region_analysis"], "cube_reps": ORACLE_SQL["rep_analysis"]}


def _record(name: str, *times: str) -> str:
    """A query's rows with their times as the ISO text of the API's records."""
    iso = ", ".join(f"strftime({t}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_trunc('second', {t}) = {t} THEN '' ELSE strftime({t}, '.%f') END AS {t}" for t in times)
    return f"SELECT * REPLACE ({iso}) FROM ({ORACLE_SQL[name]})" if times else ORACLE_SQL[name]


ORACLE_SQL |= {
    "api_customer_info": _record("customer_lookup", "last_order_date", "created_date", "updated_date"),
    "api_customer_orders": _record("customer_orders", "sales_date"),
    "api_sales_data": _record("sales_enriched_filtered", "sales_date"),
    "api_top_customers": _record("top_customers_filtered", "last_order_date"),
    "api_product_performance": _record("product_performance", "first_sale_date", "last_sale_date"),
    "api_regional_sales": _record("regional_sales_filtered"),
    "api_rep_performance": _record("rep_performance_filtered"),
}
