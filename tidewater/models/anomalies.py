"""M4: anomalies by median and median absolute deviation per group.

Both medians are exact (``functions.quantile``): a value is an anomaly if
it lies more than ``limit`` robust standard deviations (SCALE times the
median absolute deviation) from its group's median.  All figures are whole
numbers of a quarter of the value's last decimal place until the end, so
they do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.quantile import BITS, ROUNDS, order_statistics, span_bits, whole_number

SCALE = 1.4826      # fixed value: the standard deviation of a normal distribution over its median absolute deviation
LIMIT = 3.0


def with_robust_scores(df: DataFrame, value: str, keys: list[str], *, measured: bool = False) -> DataFrame:
    """The rows with a value, with their group's ``median``, ``mad`` and the
    robust score (value - median) / (SCALE * mad), NULL where mad is 0.
    NULL keys are a group of their own.  ``measured``: a first scan finds how
    far the values lie apart, which saves rounds over all rows."""
    if not keys:
        raise ValueError("name the columns of a group")
    whole, unit = whole_number(df, value)
    rows = df.where(F.col(value).isNotNull())
    most = BITS * ROUNDS
    bits = span_bits(rows, whole) if measured else most
    middle = order_statistics(rows, whole, [0.5], keys, bits=bits).select(*keys, (F.col("low") + F.col("high")).alias("_twice"))
    rows = _by_group(rows, middle, keys)
    off = 2 * whole - F.col("_twice")
    # Twice a distance from the middle is at most twice the largest distance.
    spread = order_statistics(rows, F.abs(off), [0.5], keys, bits=min(most, bits + 1)).select(*keys, (F.col("low") + F.col("high")).alias("_four"))
    rows = _by_group(rows, spread, keys)
    # In units of the last place: deviation off / 2, median absolute deviation _four / 4.
    mad = F.col("_four") / F.lit(4.0)
    out = rows.withColumns({
        "median": F.col("_twice") / F.lit(2.0 * unit), "mad": F.col("_four") / F.lit(4.0 * unit),
        "score": F.when(F.col("_four") > 0, (off / F.lit(2.0)) / (F.lit(SCALE) * mad)),
        "_far": (F.abs(off) / F.lit(2.0)), "_mad": mad})
    return out.drop("_twice", "_four")


def _by_group(rows: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's figures (one row per group), NULL keys too."""
    named = figures.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *[c for c in figures.columns if c not in keys])
    match = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_g{i}"))
        match = same if match is None else match & same
    return rows.join(named, match).drop(*[f"_g{i}" for i in range(len(keys))])


def anomalies(df: DataFrame, value: str, keys: list[str], *, limit: float = LIMIT, measured: bool = False) -> DataFrame:
    """The rows further than ``limit`` robust standard deviations from their
    group's median; where mad is 0, all that differ from the median."""
    scored = with_robust_scores(df, value, keys, measured=measured)
    return scored.where(F.col("_far") > F.lit(limit) * (F.lit(SCALE) * F.col("_mad"))).drop("_far", "_mad")


def daily_region_anomalies(scan: DataFrame, *, limit: float = LIMIT) -> DataFrame:
    """Days on which a region's total stands out among its days with sales."""
    daily = scan.groupBy("region", F.to_date("sales_date").alias("sales_day")).agg(F.sum("sales_amount").alias("total_sales"))
    return anomalies(daily, "total_sales", ["region"], limit=limit)


def product_amount_anomalies(scan: DataFrame, *, limit: float = LIMIT) -> DataFrame:
    """Sales whose quantity stands out among those of their product."""
    rows = scan.select("product_code", "customer_id", "sales_date", "sales_amount", "sales_quantity")
    return anomalies(rows, "sales_quantity", ["product_code"], limit=limit, measured=True)
