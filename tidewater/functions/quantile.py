"""Exact quantiles per group by counting, without gathering a column.

``percentile(x, p)`` keeps every distinct value of a group in one buffer,
and ranking the values needs one task per group.  Here the values, as whole
numbers of the column's last decimal place, are searched digit by digit:
each round counts the values per digit of BITS bits below the digits found
so far and goes on in the digit that holds the wanted rank.  A round shuffles
counts, and its window sees at most 2^BITS digits of one wanted rank, however
many rows the group has.  The whole is one plan, without an action.

Without more knowledge, the distances of a long need three rounds.  Where a
scan of the column costs less than rounds over all rows, :func:`span_bits`
measures how many bits they have, and as few rounds as these take run, with
digits of equal size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 21
ROUNDS = 3          # 63 bits: any distance that a long holds


def whole_number(df: DataFrame, col: str) -> tuple[Column, int]:
    """A column of whole numbers as longs of its last decimal place, and
    that place's number of units in 1."""
    t = df.schema[col].dataType
    if isinstance(t, T.DecimalType):
        unit = 10 ** t.scale
        return (F.col(col) * F.lit(unit)).cast("long"), unit
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(col).cast("long"), 1
    raise ValueError(f"{col}: quantiles are searched in whole numbers and decimals, not {t.simpleString()}")


def span_bits(df: DataFrame, value: Column) -> int:
    """The bits of the largest distance between two values (an action that
    scans the column; one row reaches the driver)."""
    least, most = df.agg(F.min(value), F.max(value)).first()
    return 1 if least is None else max(1, min(BITS * ROUNDS, (most - least).bit_length()))


def order_statistics(df: DataFrame, value: Column, ps: list[float], keys: list[str] | tuple = (), *, bits: int = BITS * ROUNDS) -> DataFrame:
    """(keys, p, n, low, high): for each group and each of ``ps`` the long
    values at the ranks floor and ceil of (n - 1) * p, and the rows n that
    are not NULL.  Groups without a value give no row; NULL keys are a group.
    No distance within a group has more than ``bits`` bits; one that does
    fails the query."""
    keys = list(keys)
    rounds = -(-bits // BITS)
    width = -(-bits // rounds)
    rows = df.where(value.isNotNull()).select(*keys, value.alias("_v"))
    far = F.col("_v") - F.col("_least")
    if not keys:
        rows = rows.withColumn("_far", F.col("_v") - rows.agg(F.min("_v")).scalar())
        far = F.col("_far")
    n = F.col("_n") - 1
    targets = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("_p"), F.lit(side).alias("_side"), r.cast("long").alias("_rank"))
                                  for p in ps for side, r in ((0, F.floor(n * F.lit(float(p)))), (1, F.ceil(n * F.lit(float(p)))))]))
    # Always 0, but no literal: the first round is a hash join as the others are.
    nothing = F.least(F.lit(0).cast("long"), F.col("_n")).alias("_found")
    span = F.max("_v") - F.min("_v")
    least = F.when(F.shiftrightunsigned(span, min(rounds * width, 63)) == 0, F.min("_v")).otherwise(F.raise_error(F.lit(f"values further apart than {bits} bits")).cast("long"))
    if bits == BITS * ROUNDS:
        least = F.min("_v")
    state = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), least.alias("_least")).where("_n > 0")
             .select(*keys, "_n", "_least", targets.alias("_t")).select(*keys, "_n", "_least", "_t.*", nothing))
    own = ["_n", "_least", "_p", "_side", "_rank", "_found"]
    for step in range(rounds - 1, -1, -1):
        shift = width * step
        names = {k: f"_key{i}" for i, k in enumerate(keys)}
        side = state.select(*[F.col(k).alias(a) for k, a in names.items()], *own)
        match = F.shiftrightunsigned(far, min(shift + width, 63)) == F.col("_found")      # nothing above the first digit
        for k, a in names.items():
            match = match & F.col(k).eqNullSafe(F.col(a))
        joined = rows.join(side if keys else F.broadcast(side), match)      # without keys, two rows for each of ps
        digit = F.shiftrightunsigned(far, shift).bitwiseAND((1 << width) - 1)
        counts = joined.groupBy(*keys, *own, digit.alias("_digit")).agg(F.count(F.lit(1)).alias("_rows"))
        upto = F.sum("_rows").over(Window.partitionBy(*keys, "_p", "_side").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        state = (counts.withColumn("_upto", upto).where((F.col("_upto") - F.col("_rows") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
                 .select(*keys, "_n", "_least", "_p", "_side", (F.col("_rank") - F.col("_upto") + F.col("_rows")).alias("_rank"),
                         F.shiftleft("_found", width).bitwiseOR(F.col("_digit")).alias("_found")))
    at = lambda side: F.max(F.when(F.col("_side") == side, F.col("_least") + F.col("_found")))
    return state.groupBy(*keys, F.col("_p").alias("p"), F.col("_n").alias("n")).agg(at(0).alias("low"), at(1).alias("high"))


def quantiles(df: DataFrame, col: str, ps: list[float], keys: list[str] | tuple = (), *, measured: bool = False) -> DataFrame:
    """(keys, p, n, q): exact quantiles with numpy/pandas ``linear``
    interpolation, as doubles (NULL values ignored).  ``measured``: see
    :func:`span_bits`."""
    value, unit = whole_number(df, col)
    found = order_statistics(df, value, ps, keys, bits=span_bits(df, value) if measured else BITS * ROUNDS)
    a, b = ((F.col(c) / F.lit(unit)).cast("double") if unit == 1 else F.col(c).cast("double") / F.lit(float(unit)) for c in ("low", "high"))
    h = (F.col("n") - 1) * F.col("p")
    return found.select(*keys, "p", "n", (a + (b - a) * (h - F.floor(h))).alias("q"))


def exact_quantile(df: DataFrame, col: str, p: float) -> DataFrame:
    """One row, one column ``q``: the quantile of the whole column (NULL
    without values)."""
    return quantiles(df, col, [p]).agg(F.max("q").alias("q"))
