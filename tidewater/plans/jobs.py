"""The three scheduled runs as Spark jobs over landed files and published
tables:

* ``run_etl``        raw exports (last ``lookback_days`` of processing) ->
                      customers / products upserted, sales loaded (K6);
* ``run_insights``   the five reports over the last ``days`` of sales,
                      added as the insight rows of that run (A30 + K7);
* ``run_documents``  the document set rebuilt and published (K11).

Each returns a small status dict (counts observed while writing, no extra
pass).  Inputs and outputs are folders, so the jobs can run on any cluster
that sees them; a failed run leaves the previous table versions readable.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas as S
from tidewater.functions import exprs as X
from tidewater.operators import insights as I
from tidewater.operators import rollups as R
from tidewater.operators.cube import Cube
from tidewater.sources import sinks as K
from tidewater.sources.tables import scan_raw_bw, scan_raw_ecc


def _raw(spark: SparkSession, path: str, schema, as_of, lookback_days: int | None) -> DataFrame:
    """Landed raw rows; the look-back window as a filter on the partition
    column, so that earlier directories are not read."""
    df = spark.read.parquet(path)
    if lookback_days is not None:
        first = X.days_before(as_of, lookback_days)
        if "processed_day" in df.columns:
            df = df.where(F.col("processed_day").cast("date") >= F.to_date(first))
        if "processed_month" in df.columns:
            df = df.where(F.col("processed_month").cast("string") >= F.date_format(first, "yyyy-MM"))
    return df.select(*[f.name for f in schema.fields])


def _start(as_of, lookback_days: int | None) -> _dt.datetime | None:
    """First moment of the look-back window."""
    if lookback_days is None:
        return None
    at = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime.fromisoformat(str(as_of))
    return at - _dt.timedelta(days=lookback_days)


def run_etl(spark: SparkSession, raw_root: str, out_root: str, *, as_of,
            lookback_days: int | None = 7, sales_mode: str = "replace_window",
            unit_price_mode: str = "reference", granularity: str = "day") -> dict:
    """Nightly consolidation.  ``raw_root`` holds ``raw_ecc`` and ``raw_bw``
    as landed by ``sinks.land_raw`` (partitioned by processing period, so
    the look-back window prunes directories).  Nothing is written when both
    scans are empty."""
    ecc = scan_raw_ecc(_raw(spark, f"{raw_root}/raw_ecc", S.RAW_ECC, as_of, lookback_days), as_of=as_of,
                       lookback_days=lookback_days)
    bw = scan_raw_bw(_raw(spark, f"{raw_root}/raw_bw", S.RAW_BW, as_of, lookback_days), as_of=as_of,
                     lookback_days=lookback_days)
    if ecc.isEmpty() and bw.isEmpty():
        return {"customers": None, "products": None, "sales_rows": 0}
    customers = R.build_customers(ecc, bw, as_of=as_of)
    products = R.build_products(ecc, bw, as_of=as_of, unit_price_mode=unit_price_mode)
    sales = R.unify_sales(ecc, bw, as_of=as_of)
    return K.save_processed(customers, products, sales, out_root, as_of=as_of, sales_mode=sales_mode,
                            granularity=granularity, start=_start(as_of, lookback_days))


def _processed(spark: SparkSession, root: str, as_of=None, days: int | None = None):
    """(sales, customers, products) of the last run; with ``days``, only the
    directories of sales months that the window meets."""
    start = _start(as_of, days) if as_of is not None else None
    found = K.read_processed(spark, root, months_from=start and start.strftime("%Y-%m"))
    if found is None:
        raise FileNotFoundError(f"no completed run under {root}")
    sales, customers, products = found
    return sales.select(*[f.name for f in S.SALES.fields]), customers, products


def run_insights(spark: SparkSession, processed_root: str, insights_path: str, *, as_of,
                 days: int | None = 30) -> dict:
    """Insight run over one window of the sales; a rerun for the same
    ``as_of`` replaces its rows."""
    sales, customers, products = _processed(spark, processed_root, as_of, days)
    obs = Observation("insights")
    cube = Cube(I.insight_scan(sales, None, None, as_of=as_of, days=days))
    try:
        rows = I.insight_rows(cube, customers, products, as_of=as_of)
        K.save_insights(rows.observe(obs, F.count(F.lit(1)).alias("n")), insights_path, run=as_of)
    finally:
        cube.remove()
    return {"insight_rows": int(obs.get["n"])}


def run_documents(spark: SparkSession, processed_root: str, docs_root: str, *, as_of,
                  days: int | None = 30) -> dict:
    """Document rebuild: customers, recent sales and products -> new version."""
    sales, customers, products = _processed(spark, processed_root)
    version, n = K.rebuild_documents(customers, sales, products, docs_root, as_of=as_of, days=days)
    return {"version": version, "documents": n}
