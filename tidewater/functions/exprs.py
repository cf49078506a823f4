"""Column helpers: one place for every semantic decision about NULLs,
rounding, ordering, text and time.  All of them are built-in Spark
expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------- time

def ts_lit(value) -> Column:
    """Wall-clock timestamp literal (timestamp_ntz), independent of the
    session time zone.  Accepts 'YYYY-MM-DD[ HH:MM:SS]', date or datetime."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def days_before(as_of, days: int) -> Column:
    """``as_of - n days`` (DATEADD(day, -n, now))."""
    return F.timestamp_add("DAY", F.lit(-int(days)), ts_lit(as_of))


def lookback(col, as_of, days: int | None) -> Column | None:
    """``col >= as_of - days``; lower bound only.  None = no window."""
    if days is None or as_of is None:
        return None
    return _c(col) >= days_before(as_of, days)


def add_days(col, n) -> Column:
    return F.timestamp_add("DAY", _c(n) if not isinstance(n, int) else F.lit(n), _c(col))


def day_start(col) -> Column:
    """Midnight of the day of ``col`` (keeps timestamp_ntz)."""
    return F.to_date(_c(col)).cast("timestamp_ntz")


# --------------------------------------------------------------- filtering

def and_all(preds) -> Column | None:
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def where_opt(df, pred):
    return df if pred is None else df.where(pred)


def collated(x, collation: str | None) -> Column:
    """A string column under ``collation`` (None: binary).  With
    ``"UTF8_LCASE_RTRIM"`` comparisons, joins and groups ignore case and
    trailing spaces, as a case-insensitive database collation does."""
    c = _c(x)
    return c if not collation else F.collate(c, collation)


def sales_filter(prefix: str = "", *, start=None, end=None, region=None,
                 customer_id=None, product_code=None, date_col="sales_date",
                 collation: str | None = None) -> Column | None:
    """Conjunction of the optional filters.  Falsy values (None, '') mean
    "no filter"; both date bounds are inclusive and a bare date means
    midnight, so ``end`` excludes later rows of that day.  ``collation``
    applies to the text keys (see :func:`collated`)."""
    p = prefix
    preds = []
    if start:
        preds.append(F.col(p + date_col) >= ts_lit(start))
    if end:
        preds.append(F.col(p + date_col) <= ts_lit(end))
    for name, val in (("region", region), ("customer_id", customer_id), ("product_code", product_code)):
        if val:
            preds.append(collated(F.col(p + name), collation) == F.lit(val))
    return and_all(preds)


# -------------------------------------------------------------- aggregates

def latest_non_null(value, order) -> Column:
    """First non-null value when rows are read newest-first: the non-null
    value with the greatest ``order``.  Ties break on the value itself, so
    the result does not depend on row order; needs no window and aggregates
    partially before the shuffle, which carries the value once, beside its
    ``order`` (``max_by`` would carry it twice)."""
    v = _c(value)
    o = order if isinstance(order, Column) else F.col(order)
    return F.max(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v"))))["v"]


def sum0(x) -> Column:
    """Sum where an all-NULL group gives 0 (pandas semantics)."""
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def dsum(x) -> Column:
    """Exact decimal sum presented as double."""
    return F.sum(_c(x)).cast("double")


def dmean(x) -> Column:
    """Mean of a decimal column as ``double(sum) / count``: the same bits in
    every engine, unlike rounding a double average."""
    return F.sum(_c(x)).cast("double") / F.count(_c(x))


def mean2(x) -> Column:
    """Mean rounded half-to-even to two decimals, computed on the exact
    decimal ratio (numpy's ``.round(2)`` semantics without float error)."""
    return F.bround(F.sum(_c(x)) / F.count(_c(x)), 2)


def safe_div(num, den) -> Column:
    return F.try_divide(_c(num), _c(den))


def pct(part, whole) -> Column:
    """``part / whole * 100`` in double; 0.0 when ``whole`` is 0."""
    w = _c(whole).cast("double")
    return F.when(w > 0, _c(part).cast("double") / w * F.lit(100.0)).otherwise(F.lit(0.0))


# --------------------------------------------------------------------- text

def text_cat(*parts) -> Column:
    """CONCAT that reads NULL as ''.  Plain strings are literal text."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def opt(prefix: str, x, suffix: str = "") -> Column:
    """``prefix + x + suffix`` when x is not NULL, else ''."""
    v = _c(x)
    return F.when(v.isNotNull(), F.concat(F.lit(prefix), v.cast("string"), F.lit(suffix))).otherwise(F.lit(""))


def nz(x, default="") -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(default))


def n2(x) -> Column:
    """``FORMAT(x, 'N2')``: thousands separators, two decimals."""
    return F.format_number(_c(x), 2)


def money_text(x) -> Column:
    """Display currency: ``$1,234.50`` and ``-$1,234.50``."""
    v = _c(x)
    return F.when(v < 0, F.concat(F.lit("-$"), F.format_number(-v, 2))) \
            .otherwise(F.concat(F.lit("$"), F.format_number(v, 2)))


def iso_ts(x) -> Column:
    """ISO text of a time; microseconds only where there are any."""
    c = _c(x)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("SECOND", c.cast("timestamp")) == c.cast("timestamp"), whole) \
            .otherwise(F.concat(whole, F.date_format(c, ".SSSSSS")))


def key_or_unknown(x) -> Column:
    """Group key with NULL and '' folded into 'Unknown'."""
    from tidewater.schemas import UNKNOWN_REGION
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(UNKNOWN_REGION))
