"""The function catalogue offered to API clients, as named, parameterised
DataFrame queries over the processed tables.

``CATALOGUE[name](tables, **params)`` returns a lazy DataFrame; ``tables``
holds ``sales``, ``customers`` and ``products`` DataFrames and ``as_of``.
Parameters follow the original functions: dates are 'YYYY-MM-DD', empty
values mean "no filter", limits default to 10.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators import helpers as H
from tidewater.operators import queries as Q


@dataclass
class Tables:
    sales: DataFrame
    customers: DataFrame
    products: DataFrame
    as_of: str

    @classmethod
    def from_store(cls, spark: SparkSession, sf_dir: str, as_of: str) -> "Tables":
        from tidewater.plans import store
        path = store.materialize(spark, sf_dir, as_of)
        return cls(store.read(spark, path, "sales"), store.read(spark, path, "customers"),
                   store.read(spark, path, "products"), as_of)


def get_customer_info(t: Tables, customer_id: str) -> DataFrame:
    return Q.customer_lookup(t.customers, customer_id)


def get_customer_orders(t: Tables, customer_id: str, limit: int = 10) -> DataFrame:
    return Q.customer_orders(t.sales, t.products, customer_id, limit=limit or 10)


def get_sales_data(t: Tables, start_date=None, end_date=None, region=None, customer_id=None) -> DataFrame:
    return Q.sales_enriched(t.sales, t.customers, t.products, start=start_date, end=end_date,
                            region=region, customer_id=customer_id, order=True)


def get_top_customers(t: Tables, limit: int = 10, start_date=None, end_date=None) -> DataFrame:
    return Q.top_customers(t.sales, t.customers, limit=limit or 10, start=start_date, end=end_date)


def get_product_performance(t: Tables, product_code=None, start_date=None, end_date=None) -> DataFrame:
    return Q.product_performance(t.sales, t.products, product_code=product_code,
                                 start=start_date, end=end_date)


def get_regional_sales(t: Tables, start_date=None, end_date=None) -> DataFrame:
    return Q.regional_sales(t.sales, start=start_date, end=end_date)


def get_sales_rep_performance(t: Tables, start_date=None, end_date=None) -> DataFrame:
    return Q.rep_performance(t.sales, start=start_date, end=end_date)


def get_current_date(t: Tables) -> str:
    return H.current_date(t.as_of)


def get_date_range(t: Tables, days: int = 30) -> dict:
    return H.date_range(t.as_of, days)


CATALOGUE: dict[str, Callable] = {
    "GetCustomerInfo": get_customer_info,
    "GetCustomerOrders": get_customer_orders,
    "GetSalesData": get_sales_data,
    "GetTopCustomers": get_top_customers,
    "GetProductPerformance": get_product_performance,
    "GetRegionalSales": get_regional_sales,
    "GetSalesRepPerformance": get_sales_rep_performance,
    "GetCurrentDate": get_current_date,
    "GetDateRange": get_date_range,
}


def call(t: Tables, name: str, **params):
    """Run a catalogue function by name; DataFrame results are returned as
    JSON record text (one row per record, see ``queries.api_records``)."""
    out = CATALOGUE[name](t, **params)
    return Q.api_records(out) if isinstance(out, DataFrame) else out
