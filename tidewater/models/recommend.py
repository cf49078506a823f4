"""M3: products bought together.

Pairs of products by the number of orders that hold both.  A pair cannot be
in more orders than either product, so products below the support go before
pairs are made.  The products of an order are dealt to blocks of about
BLOCK; each pair of blocks is a row of its own, so a very large order is
spread over tasks and no task holds more than two blocks of it.  No order
is cut short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
MIN_ORDERS = 2


def baskets(sales: DataFrame) -> DataFrame:
    """(order_number, product_code) of the active sales with an order, once each."""
    return sales.where(F.col("is_active") & F.col("order_number").isNotNull() & F.col("product_code").isNotNull()) \
        .select("order_number", "product_code").distinct()


def product_pairs(items: DataFrame, *, min_orders: int = MIN_ORDERS, block: int = BLOCK) -> DataFrame:
    """(a, b, orders) with a < b: all pairs in at least ``min_orders`` orders."""
    support = items.groupBy("product_code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_orders)
    frequent = items.join(support.select("product_code"), "product_code", "left_semi")
    sizes = frequent.groupBy("order_number").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m")).where("m > 1")
    dealt = frequent.join(sizes, "order_number").withColumn("own", F.pmod(F.xxhash64("product_code"), F.col("blocks")).cast("int"))
    # Every block meets every block of its order, itself included: (i, j) with i <= j.
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = dealt.select("order_number", "product_code", "own", others.alias("other")).groupBy(
        "order_number", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("product_code"))).alias("left"),
        F.collect_list(F.when(F.col("own") >= F.col("other"), F.col("product_code"))).alias("right"))
    one = met.select("i", "j", "right", F.explode("left").alias("x"))
    two = one.select("i", "j", "x", F.explode("right").alias("y")).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y")))
    return two.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("orders")) \
        .where(F.col("orders") >= min_orders)


def recommendations(items: DataFrame, *, k: int = 3, min_orders: int = MIN_ORDERS, block: int = BLOCK) -> DataFrame:
    """The ``k`` products most often ordered with each product (ties: the
    smaller code), with the share of the product's orders and the lift over
    independent orders."""
    pairs = product_pairs(items, min_orders=min_orders, block=block)
    each = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("product_code"), F.col("b").alias("recommended")),
                                          F.struct(F.col("b").alias("product_code"), F.col("a").alias("recommended")))).alias("p"), "orders").select("p.*", "orders")
    rank = F.row_number().over(Window.partitionBy("product_code").orderBy(F.col("orders").desc(), "recommended"))
    top = each.withColumn("rank", rank).where(F.col("rank") <= k)
    support = items.groupBy("product_code").agg(F.count(F.lit(1)).alias("n"))
    total = items.agg(F.count_distinct("order_number")).scalar()
    return (top.join(support, "product_code").join(support.select(F.col("product_code").alias("recommended"), F.col("n").alias("m")), "recommended")
            .select("product_code", F.col("rank").cast("long").alias("rank"), "recommended", "orders",
                    (F.col("orders") / F.col("n")).alias("confidence"),
                    ((F.col("orders") * total).cast("double") / (F.col("n") * F.col("m")).cast("double")).alias("lift")))
