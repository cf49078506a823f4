"""What all five reports need, from one scan of the sales.

``report_cube`` sends every row twice, narrow: to its customer and to its
product.  Where the rows of a customer are together they are grouped by
what the reports count customers of, without another shuffle:

    day, customer           daily totals and customers
    region, customer        regional totals and customers; customer totals, latest region
    rep, customer           rep totals and customers
    region, rep, customer   reps of a region, regions of a rep
    product                 product totals and prices

Pairs with the customer make the distinct counts plain counts at the next
level, and every buffer has a fixed width, so both levels are hash
aggregations.  ``Cube`` adds up the days, the reps and the pairs of region
and rep where their groups are (only partial sums of those are shuffled)
and writes the result once, a folder per set; each report reads its own
folders.  The functions below return what the flat analyses of
``operators.insights`` return, column by column.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import exprs as X
from tidewater.session import checkpoint_dir

SETS = {
    "day_customer": ("sales_day",),
    "region_customer": ("region",),
    "rep_customer": ("sales_rep",),
    "region_rep_customer": ("region", "sales_rep"),
}
ROLLED = {"day_customer": "day", "rep_customer": "rep", "region_rep_customer": "region_rep"}    # added up over the customers
PARTS = ("product", "region_customer", *ROLLED.values())
SPLIT = str(4 << 20)
SPREAD = 2                      # a row is sent twice
MONEY_SUM = "decimal(28,2)"     # the type of a sum of prices, so that means round as those of the flat analyses


def report_cube(scan: DataFrame) -> DataFrame:
    """The grouping sets of a scan, named by ``part``."""
    def none(col):
        return F.lit(None).cast(scan.schema[col].dataType).alias(col)

    rows = scan.select(F.inline(F.array(
        F.struct(F.lit(False).alias("of_product"), F.col("customer_id").alias("key"), "sales_date", "region", "sales_rep",
                 "sales_amount", "sales_quantity", none("unit_price")),
        F.struct(F.lit(True).alias("of_product"), F.col("product_code").alias("key"), none("sales_date"), none("region"), none("sales_rep"),
                 "sales_amount", "sales_quantity", "unit_price"))))
    rows = rows.repartition("of_product", "key")
    dims = {"sales_day": F.to_date("sales_date"), "region": F.col("region"), "sales_rep": F.col("sales_rep")}

    def keys(part, names):
        return F.struct(F.lit(part).alias("part"), *[(c if k in names else F.when(F.lit(False), c)).alias(k) for k, c in dims.items()])

    sets = F.when(F.col("of_product"), F.array(keys("product", ()))).otherwise(F.array(*[keys(p, names) for p, names in SETS.items()]))
    cube = rows.select("of_product", "key", "sales_date", "sales_amount", "sales_quantity", "unit_price", F.explode(sets).alias("s")) \
        .groupBy("of_product", "key", *[F.col(f"s.{k}").alias(k) for k in ("part", *dims)]).agg(
        F.sum("sales_amount").alias("amount"), F.count("sales_amount").alias("orders"), F.sum("sales_quantity").alias("quantity"),
        F.sum("unit_price").alias("price"), F.count("unit_price").alias("prices"),
        F.min("sales_date").alias("first_order"), F.max("sales_date").alias("last_order"))
    return cube.select("part", "sales_day", F.when(~F.col("of_product"), F.col("key")).alias("customer_id"),
                       F.when(F.col("of_product"), F.col("key")).alias("product_code"), "region", "sales_rep",
                       "amount", "orders", "quantity", "price", "prices", "first_order", "last_order")


def _rolled(cube: DataFrame) -> DataFrame:
    """The sets of ROLLED added up over their customers, which are counted; the others as they are.  Measures
    that a set is not read for stay behind: of pairs of region and rep only that they exist."""
    summed, found = F.col("part").isin("day_customer", "rep_customer"), F.col("part").isin(*ROLLED)
    part = F.col("part")
    for name, to in ROLLED.items():
        part = F.when(F.col("part") == name, to).otherwise(part)
    rows = cube.select(part.alias("part"), "sales_day", F.when(~found, F.col("customer_id")).alias("customer_id"), "product_code", "region", "sales_rep",
                       *[F.when(summed | ~found, F.col(c)).alias(c) for c in ("amount", "orders", "quantity")],
                       *[F.when(~found, F.col(c)).alias(c) for c in ("price", "prices", "first_order", "last_order")],
                       (summed & F.col("customer_id").isNotNull()).alias("customer"))
    return rows.groupBy("part", "sales_day", "customer_id", "product_code", "region", "sales_rep").agg(
        *[F.sum(c).alias(c) for c in ("amount", "orders", "quantity", "price", "prices")],
        F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"), F.count_if("customer").alias("customers"))


class Cube:
    """A written cube.  ``remove`` deletes it when its reports are saved."""

    def __init__(self, scan: DataFrame):
        self.spark = scan.sparkSession
        self.path = f"{checkpoint_dir(self.spark).rstrip('/')}/tidewater-cubes/{uuid.uuid4().hex}"
        cube = _rolled(report_cube(scan))
        self.schema = cube.schema
        # Written where the sums are: a file per set and task, all open at once, so without a sort.  A task that sends rows reads
        # SPLIT bytes at most (row groups of the store are no larger); one that groups them holds up to four groups per row,
        # so they go to SPREAD times the usual partitions.
        conf = self.spark.conf
        parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        own = {"spark.sql.maxConcurrentOutputFileWriters": str(len(PARTS)), "spark.sql.files.maxPartitionBytes": SPLIT,
               parts: str(SPREAD * int(conf.get(parts, None) or conf.get("spark.sql.shuffle.partitions")))}
        before = {k: conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                conf.set(k, v)
            cube.write.option("compression", "zstd").partitionBy("part").parquet(self.path)
        finally:
            for k, v in before.items():
                conf.set(k, v) if v is not None else conf.unset(k)

    def part(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("part") == name).drop("part")

    def remove(self) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def daily_sales(self) -> DataFrame:
        """A11."""
        return self.part("day").select("sales_day", F.col("amount").alias("total_sales"), F.col("quantity").alias("total_quantity"),
                                       F.col("customers").alias("unique_customers"))

    def distinct_customers(self) -> DataFrame:
        """One row: the customers of the scan."""
        return self.customers().agg(F.count("customer_id").alias("distinct_customers"))

    def customers(self) -> DataFrame:
        """A14 without the segment."""
        per = self.part("region_customer").groupBy("customer_id").agg(
            F.sum("amount").alias("total_sales"), F.sum("orders").alias("order_count"), F.sum("quantity").alias("total_quantity"),
            F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"),
            F.max(F.when(F.col("region").isNotNull(), F.struct("last_order", "region")))["region"].alias("region"))
        return per.select("customer_id", "total_sales", "order_count", _mean("total_sales", "order_count").alias("avg_order_value"),
                          "total_quantity", "first_order", "last_order", "region")

    def customer_analysis(self, customers: DataFrame) -> DataFrame:
        """A14."""
        segments = customers.select("customer_id", F.col("customer_segment").alias("segment"))
        return self.customers().join(segments, "customer_id", "left").select(
            "customer_id", "total_sales", "order_count", "avg_order_value", "total_quantity", "first_order", "last_order", "segment", "region")

    def product_analysis(self, products: DataFrame) -> DataFrame:
        """A17."""
        categories = products.select("product_code", F.col("product_category").alias("category"))
        amount, quantity, price = (F.col(c).cast(MONEY_SUM) for c in ("amount", "quantity", "price"))
        return self.part("product").select(
            "product_code", amount.alias("total_sales"), F.col("orders").alias("order_count"),
            _mean("amount", "orders").alias("avg_order_value"), quantity.alias("total_quantity"),
            _mean(price, "prices").alias("avg_unit_price")).join(categories, "product_code", "left")

    def _dimension(self, totals: DataFrame, key: str, other: str, name: str) -> DataFrame:
        others = self.part("region_rep").where(F.col(key).isNotNull()).groupBy(key).agg(F.count(other).alias(name))
        return totals.join(others, key).select(key, "total_sales", "order_count", _mean("total_sales", "order_count").alias("avg_order_value"),
                                               "total_quantity", "unique_customers", name)

    def region_analysis(self) -> DataFrame:
        """A20."""
        totals = self.part("region_customer").where(F.col("region").isNotNull()).groupBy("region").agg(
            F.sum("amount").alias("total_sales"), F.sum("orders").alias("order_count"), F.sum("quantity").alias("total_quantity"),
            F.count("customer_id").alias("unique_customers"))
        return self._dimension(totals, "region", "sales_rep", "sales_reps")

    def rep_analysis(self) -> DataFrame:
        """A22."""
        totals = self.part("rep").where(F.col("sales_rep").isNotNull()).select(
            "sales_rep", F.col("amount").alias("total_sales"), F.col("orders").alias("order_count"),
            F.col("quantity").alias("total_quantity"), F.col("customers").alias("unique_customers"))
        return self._dimension(totals, "sales_rep", "region", "regions")


def _mean(total, count: str):
    """Half-even to cents on the exact ratio; NULL without rows."""
    return F.bround(F.try_divide(X._c(total).cast(MONEY_SUM), F.col(count)), 2)
