"""Named, parameterised queries over a folder of driver tables.

``QUERIES[name](spark, sf_dir)`` returns a lazy DataFrame.  Each query
derives the raw tables from the given parquet files (see
``sources.tables.raw_from_tpch``) and runs the operator over the whole
history; windowed variants use ``AS_OF``.  Decimal results are presented
as doubles so that every engine reports the same numbers.
"""

from __future__ import annotations

from functools import cached_property
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import quantile as Z
from tidewater.models import anomalies as MA
from tidewater.models import forecast as MF
from tidewater.models import recommend as MR
from tidewater.models import segments as MS
from tidewater.operators import documents as D
from tidewater.operators import helpers as H
from tidewater.operators import insights as I
from tidewater.operators import queries as Q
from tidewater.operators import rollups as R
from tidewater.operators.cube import Cube
from tidewater.sources import docstore as DS
from tidewater.sources import sinks as K
from tidewater.sources import tables as T
from tidewater.session import spread_shuffles
from tidewater.streaming import jobs as ST
from tidewater.functions import exprs as X
from tidewater.plans import api, store

# Parameters of the registered queries.
AS_OF = "2001-11-05"          # one day after the last ship date in the driver data
RAW_LOOKBACK_DAYS = 7
INSIGHT_DAYS = 30
FILTER = dict(start="1998-01-01", end="1999-12-31", region="ASIA")
LOOKUP_CUSTOMER = "C100"
LOOKUP_PRODUCT = "P100"
UPSERT_SPLIT = "1998-07-01"   # the old table holds rows processed before this day
TOP_K = 10
ALERT_THRESHOLD_LOW = 2
LOST_IDS = 3                  # changes without an id in the document refresh


_TABLES: dict = {}


class Ctx:
    """Handles on one folder of driver tables.

    ``raw_ecc`` / ``raw_bw`` and the processed ``sales`` / ``customers`` /
    ``products`` come from the warehouse store (written once per input, see
    ``plans.store``); ``wh`` recomputes the consolidation from the raw
    tables for the queries that exercise it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark = spark
        self.as_of = as_of
        self.sf_dir = sf_dir
        key = (spark.sparkContext.applicationId, id(spark), sf_dir)
        self.t = _TABLES.setdefault(key, T.load_tables(spark, sf_dir))
        spread_shuffles(spark, sf_dir)

    def stored(self, table: str) -> DataFrame:
        """A table of the store, built by the first query that reads it."""
        return store.read(self.spark, store.materialize(self.spark, self.sf_dir, self.as_of, [table]), table)

    @cached_property
    def flagged_ecc(self):
        """Raw rows with the adapter's soft deletes, for the scan queries."""
        return self.stored("raw_ecc")

    @cached_property
    def flagged_bw(self):
        return self.stored("raw_bw")

    @cached_property
    def raw_ecc(self):
        return store.all_rows(self.flagged_ecc)

    @cached_property
    def raw_bw(self):
        return store.all_rows(self.flagged_bw)

    @cached_property
    def wh(self):
        return R.Warehouse(self.raw_ecc, self.raw_bw, as_of=self.as_of, lookback_days=None)

    @property
    def ecc(self):
        return self.wh.ecc

    @property
    def bw(self):
        return self.wh.bw

    @cached_property
    def sales(self):
        return self.stored("sales")

    @cached_property
    def customers(self):
        return self.stored("customers")

    @cached_property
    def products(self):
        return self.stored("products")

    def scan(self, days=None, *, customers=True, products=True):
        """Insight scan, joining only the dimensions the report reads."""
        return I.insight_scan(self.sales, self.customers if customers else None,
                              self.products if products else None, as_of=self.as_of, days=days)


def _dbl(df: DataFrame) -> DataFrame:
    """Decimal columns as double (exact sums and cents convert identically
    in every engine)."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
                       for c, t in df.dtypes])


def _q(fn: Callable[[Ctx], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _dbl(fn(Ctx(spark, sf_dir)))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


# ----------------------------------------------------------------- scans

def scan_raw_ecc(c: Ctx):
    """S3/F1 over all history."""
    return T.scan_raw_ecc(c.flagged_ecc, as_of=c.as_of, lookback_days=None)


def scan_raw_bw(c: Ctx):
    return T.scan_raw_bw(c.flagged_bw, as_of=c.as_of, lookback_days=None)


def scan_raw_ecc_recent(c: Ctx):
    """The nightly 7-day window."""
    return T.scan_raw_ecc(c.flagged_ecc, as_of=c.as_of, lookback_days=RAW_LOOKBACK_DAYS)


def scan_raw_bw_recent(c: Ctx):
    return T.scan_raw_bw(c.flagged_bw, as_of=c.as_of, lookback_days=RAW_LOOKBACK_DAYS)


# ----------------------------------------------------------- consolidation

def sales_unified(c: Ctx):
    return c.wh.sales


def customer_rollup_ecc(c: Ctx):
    return R.customer_rollup_ecc(c.ecc)


def customer_rollup_bw(c: Ctx):
    return R.customer_rollup_bw(c.bw)


def customers(c: Ctx):
    return c.wh.customers


def product_rollup_ecc(c: Ctx):
    return R.product_rollup_ecc(c.ecc)


def product_rollup_bw(c: Ctx):
    return R.product_rollup_bw(c.bw)


def products(c: Ctx):
    return c.wh.products


def products_ecc_price(c: Ctx):
    return R.build_products(c.ecc, c.bw, as_of=c.as_of, unit_price_mode="ecc_only")


def customers_recent(c: Ctx):
    """A3 over the nightly 7-day window (the reference's run)."""
    w = R.Warehouse(c.raw_ecc, c.raw_bw, as_of=c.as_of, lookback_days=RAW_LOOKBACK_DAYS)
    return w.customers


# ------------------------------------------------------------- catalogue

def customer_lookup(c: Ctx):
    return Q.customer_lookup(c.customers, LOOKUP_CUSTOMER)


def product_lookup(c: Ctx):
    return Q.product_lookup(c.products, LOOKUP_PRODUCT)


def sales_enriched(c: Ctx):
    return Q.sales_enriched(c.sales, c.customers, c.products)


def sales_enriched_filtered(c: Ctx):
    return Q.sales_enriched(c.sales, c.customers, c.products, **FILTER)


def customer_orders(c: Ctx):
    return Q.customer_orders(c.sales, c.products, LOOKUP_CUSTOMER, limit=50)


def latest_orders_per_customer(c: Ctx):
    return Q.latest_orders_per_customer(c.sales, c.products, limit=TOP_K)


def product_performance(c: Ctx):
    return Q.product_performance(c.sales, c.products)


def product_performance_filtered(c: Ctx):
    return Q.product_performance(c.sales, c.products, start=FILTER["start"], end=FILTER["end"])


def regional_sales(c: Ctx):
    return Q.regional_sales(c.sales)


def regional_sales_filtered(c: Ctx):
    return Q.regional_sales(c.sales, start=FILTER["start"], end=FILTER["end"])


def rep_performance(c: Ctx):
    return Q.rep_performance(c.sales)


def rep_performance_filtered(c: Ctx):
    return Q.rep_performance(c.sales, start=FILTER["start"], end=FILTER["end"])


def top_customers(c: Ctx):
    return Q.top_customers(c.sales, c.customers, limit=TOP_K)


def top_customers_filtered(c: Ctx):
    return Q.top_customers(c.sales, c.customers, limit=TOP_K, start=FILTER["start"], end=FILTER["end"])


# ---------------------------------------------------------------- insights

def daily_sales(c: Ctx):
    return I.daily_sales(c.scan(customers=False, products=False))


def sales_trends(c: Ctx):
    return I.sales_trends(c.scan(customers=False, products=False))


def sales_trends_30d(c: Ctx):
    return I.sales_trends(c.scan(INSIGHT_DAYS, customers=False, products=False))


def sales_growth(c: Ctx):
    return I.growth(I.daily_sales(c.scan(customers=False, products=False)))


def top_days(c: Ctx):
    return I.top_days(c.scan(customers=False, products=False))


def _cust(c: Ctx, days=None):
    return I.customer_analysis(c.scan(days, customers=False, products=False), c.customers)


def customer_analysis(c: Ctx):
    return _cust(c)


def segment_analysis(c: Ctx):
    return I.segment_analysis(_cust(c))


def retention(c: Ctx):
    return I.retention(_cust(c), as_of=c.as_of)


def retention_30d(c: Ctx):
    return I.retention(_cust(c, INSIGHT_DAYS), as_of=c.as_of)


def top10_customers(c: Ctx):
    return I.top_customers_report(_cust(c))


def _prod(c: Ctx, days=None):
    return I.product_analysis(c.scan(days, customers=False, products=False), c.products)


def product_analysis(c: Ctx):
    return _prod(c)


def category_analysis(c: Ctx):
    return I.category_analysis(_prod(c))


def product_summary(c: Ctx):
    return I.product_summary(_prod(c))


def top10_products(c: Ctx):
    return I.top_products_report(_prod(c))


def region_analysis(c: Ctx):
    return I.region_analysis(c.scan(customers=False, products=False))


def region_summary(c: Ctx):
    return I.region_summary(I.region_analysis(c.scan(customers=False, products=False)))


def top5_regions(c: Ctx):
    return I.top_regions_report(I.region_analysis(c.scan(customers=False, products=False)))


def rep_analysis(c: Ctx):
    return I.rep_analysis(c.scan(customers=False, products=False))


def rep_summary(c: Ctx):
    return I.rep_summary(I.rep_analysis(c.scan(customers=False, products=False)))


def top5_reps(c: Ctx):
    return I.top_reps_report(I.rep_analysis(c.scan(customers=False, products=False)))


def insight_rows(c: Ctx):
    return I.all_insights(c.sales, c.customers, c.products, as_of=c.as_of, days=INSIGHT_DAYS)


def insight_rows_all(c: Ctx):
    return I.all_insights(c.sales, c.customers, c.products, as_of=c.as_of, days=None)


def _cube(c: Ctx):
    return Cube(c.scan(customers=False, products=False))


def cube_days(c: Ctx):
    """A11 read from the shared roll-up of A30; likewise below."""
    return _cube(c).daily_sales()


def cube_customers(c: Ctx):
    return _cube(c).customer_analysis(c.customers)


def cube_products(c: Ctx):
    return _cube(c).product_analysis(c.products)


def cube_regions(c: Ctx):
    return _cube(c).region_analysis()


def cube_reps(c: Ctx):
    return _cube(c).rep_analysis()


def insight_figures(c: Ctx):
    """Every scalar of the five reports' summaries, over one cube."""
    parts = I.report_parts(_cube(c), c.customers, c.products, as_of=c.as_of)
    out = None
    for name in ("sales_trends", "customer_insights", "product_insights", "regional_insights", "sales_rep_insights"):
        df = parts[name]
        figures = [(n, F.col(n).cast("double") if t != "string" else F.lit(None).cast("double"), F.col(n) if t == "string" else F.lit(None).cast("string"))
                   for n, t in df.dtypes if not t.startswith("array")]
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("report"), F.lit(n).alias("figure"), v.alias("value"), x.alias("text"))
                                             for n, v, x in figures])).alias("f")).select("f.*")
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------------ models

def _plain(c: Ctx):
    return c.scan(customers=False, products=False)


def amount_quantiles(c: Ctx):
    """F8 per group: exact quantiles of the sale amounts of every region."""
    return Z.quantiles(_plain(c), "sales_amount", [0.25, 0.5, 0.8, 0.95], ["region"], measured=True)


def sales_anomalies(c: Ctx):
    """M4: days that stand out from their region's daily totals."""
    return MA.daily_region_anomalies(_plain(c))


def quantity_anomalies(c: Ctx):
    """M4 with a group per product."""
    return MA.product_amount_anomalies(_plain(c))


def forecast_trend(c: Ctx):
    """M2: the line through the daily sales of every region."""
    return MF.trend(MF.daily_series(_plain(c), "region"))


def forecast_features(c: Ctx):
    return MF.lag_features(MF.daily_series(_plain(c), "region"))


def forecast_naive(c: Ctx):
    return MF.naive_scores(MF.daily_series(_plain(c), "region"))


def forecast_models(c: Ctx):
    """M2: linear and forest regressors on rolling origins."""
    return MF.model_scores(c.spark, MF.daily_series(_plain(c)))


def co_purchase(c: Ctx):
    """M3: products ordered together."""
    return MR.product_pairs(MR.baskets(c.sales))


def recommendations(c: Ctx):
    return MR.recommendations(MR.baskets(c.sales))


def customer_rfm(c: Ctx):
    """M1: the features of the segments."""
    return MS.rfm(_plain(c), as_of=c.as_of)


def customer_segments(c: Ctx):
    return MS.customer_segments(_plain(c), as_of=c.as_of)


# --------------------------------------------------------------- documents

def docs_customers(c: Ctx):
    return D.customer_documents(c.customers)


def docs_sales(c: Ctx):
    return D.sales_documents(c.sales, as_of=c.as_of, days=INSIGHT_DAYS)


def docs_products(c: Ctx):
    return D.product_documents(c.products)


def docs_all(c: Ctx):
    return D.all_documents(c.customers, c.sales, c.products, as_of=c.as_of, days=INSIGHT_DAYS)


def _refreshed(c: Ctx):
    """A document store of the customers, then three batches of changes."""
    import uuid
    from tidewater.session import checkpoint_dir
    root = f"{checkpoint_dir(c.spark).rstrip('/')}/tidewater-documents/{uuid.uuid4().hex}"
    customers = D.customer_documents(c.customers).withColumn("is_deleted", F.lit(False))
    later, earlier = (F.timestamp_add("DAY", F.lit(n), F.col("timestamp")) for n in (1, -1))
    K.write_documents(customers.drop("is_deleted"), root)
    batches = {
        # All products are new.
        "products": D.product_documents(c.products),
        # One region gets newer texts, another older ones, which do not count; the few last ids are missing.
        "texts": customers.where("region = 'ASIA'").withColumns({"title": F.concat("title", F.lit(" (changed)")), "timestamp": later})
        .unionByName(customers.where("region = 'AFRICA'").withColumns({"title": F.lit("late"), "timestamp": earlier}))
        .unionByName(customers.orderBy(F.col("id").desc()).limit(LOST_IDS).withColumn("id", F.lit(None).cast("string"))),
        # A third region's documents are deleted.
        "deletions": customers.where("region = 'EUROPE'").withColumns({"is_deleted": F.lit(True), "timestamp": later}),
    }
    return root, [(name, DS.apply(changes, root, name, buckets=16)) for name, changes in batches.items()]


def docs_refreshed(c: Ctx):
    """ST4: the document set after the batches, merged on read."""
    return DS.read(c.spark, _refreshed(c)[0])


def refresh_batches(c: Ctx):
    """K8: received and rejected changes per batch; rejected ones as read
    back from the dead letters."""
    root, done = _refreshed(c)
    counts = c.spark.createDataFrame([(n, x["received"]) for n, x in done], "batch string, received long")
    dead = DS.rejected(c.spark, root).groupBy("batch", "reason").agg(F.count(F.lit(1)).alias("rejected"))
    return counts.join(dead, "batch", "left").select("batch", "received", "reason", F.coalesce("rejected", F.lit(0)).alias("rejected"))


def doc_facets(c: Ctx):
    return D.all_facets(c.customers, c.sales, c.products, as_of=c.as_of, days=INSIGHT_DAYS)


# ------------------------------------------------------------------ sinks

def _split(c: Ctx):
    old = R.Warehouse(c.raw_ecc.where(F.col("processed_date") < X.ts_lit(UPSERT_SPLIT)),
                      c.raw_bw.where(F.col("processed_date") < X.ts_lit(UPSERT_SPLIT)),
                      as_of=UPSERT_SPLIT, lookback_days=None)
    new = R.Warehouse(c.raw_ecc.where(F.col("processed_date") >= X.ts_lit(UPSERT_SPLIT)),
                      c.raw_bw.where(F.col("processed_date") >= X.ts_lit(UPSERT_SPLIT)),
                      as_of=c.as_of, lookback_days=None)
    return old, new


def upsert_customers(c: Ctx):
    old, new = _split(c)
    return K.upsert_customers(old.customers, new.customers, as_of=c.as_of)


def upsert_products(c: Ctx):
    old, new = _split(c)
    return K.upsert_products(old.products, new.products, as_of=c.as_of)


def replace_window_sales(c: Ctx):
    """The table after two appending runs of the last window (each
    window row twice), repaired by one idempotent run of that window."""
    start = X.days_before(c.as_of, RAW_LOOKBACK_DAYS)
    window = c.sales.where(F.col("processed_date") >= start)
    doubled = c.sales.unionByName(window)
    return K.replace_window(doubled, window, window_col="processed_date",
                            start=f"{_minus_days(c.as_of, RAW_LOOKBACK_DAYS)}")


def _minus_days(d: str, n: int) -> str:
    import datetime as dt
    return (dt.date.fromisoformat(d) - dt.timedelta(days=n)).isoformat()


# ---------------------------------------------------------------- helpers

def set_totals(c: Ctx):
    return H.set_totals(_filtered_sales(c))


def unique_keys(c: Ctx):
    return H.unique_keys(_filtered_sales(c))


def _nested(groups, key: str):
    """Every nested row with the key it stands under."""
    return groups.select(F.col(key).alias("group_key"), F.explode("rows").alias("r")).select("group_key", "r.*")


def rows_by_region(c: Ctx):
    return _nested(H.rows_by_region(Q.sales_enriched(c.sales, c.customers, c.products)), "region")


def rows_by_customer(c: Ctx):
    return _nested(H.rows_by_customer(Q.sales_enriched(c.sales, c.customers, c.products)), "customer_id")


def validate_raw(c: Ctx):
    """V1 over all raw rows: rows per table and broken rule (NULL: valid)."""
    def of(raw, kind):
        return T.validate_raw(raw, kind).groupBy("validation_errors").agg(F.count(F.lit(1)).alias("rows")) \
            .select(F.lit(kind).alias("kind"), "validation_errors", "rows")
    # A unit price or quantity of 1 as a missing one, and cheap lines as returns, so that there is something to find.
    ecc = c.raw_ecc.withColumn("quantity", F.nullif(F.col("quantity"), F.lit(1).cast("decimal(18,2)")))
    bw = c.raw_bw.withColumn("sales_amount", F.when(F.col("sales_amount") < 2000, -F.col("sales_amount")).otherwise(F.col("sales_amount")).cast("decimal(18,2)"))
    return of(ecc, "ecc").unionByName(of(bw, "bw"))


def document_roles(c: Ctx):
    """The roles of the document fields, with the documents that fill them."""
    from tidewater import schemas as S
    docs = D.customer_documents(c.customers)
    filled = docs.select(*[F.count(F.col(f)).alias(f) for f in S.DOCUMENT_COLUMNS])
    roles = S.field_roles()
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(",".join(roles[f])).alias("roles"), F.col(f).alias("documents")) for f in S.DOCUMENT_COLUMNS])
    return filled.select(F.explode(pairs).alias("p")).select("p.*")


def display_rows(c: Ctx):
    return H.display_rows(c.sales)


# --------------------------------------------------------------- streaming

def error_alerts_5m(c: Ctx):
    return ST.error_alerts(c.t["events"])


def error_alerts_5m_low(c: Ctx):
    return ST.error_alerts(c.t["events"], threshold=ALERT_THRESHOLD_LOW)


def failure_alerts_15m(c: Ctx):
    return ST.failure_alerts(c.t["events"])


def hourly_events(c: Ctx):
    return ST.hourly_events(c.t["events"])


def _stream_alerts(c: Ctx, size: str, slide: str, threshold: int):
    """Run the streaming alert job on the events table (file stream,
    watermark, append mode, availableNow) into a parquet sink under the
    shared checkpoint folder, and read its output back."""
    import uuid
    from tidewater.session import checkpoint_dir
    root = f"{checkpoint_dir(c.spark).rstrip('/')}/tidewater-streams/{uuid.uuid4().hex}"
    stream = ST.streaming_alerts(ST.read_table_stream(c.spark, c.sf_dir, "events"),
                                 size=size, slide=slide, threshold=threshold)
    ST.run_to_table(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{root}/out")


def failure_alerts_15m_stream(c: Ctx):
    """ST2 as a stream: only windows closed by the watermark are emitted."""
    return _stream_alerts(c, ST.FAILURE_RULE[0], ST.FAILURE_RULE[1], ST.FAILURE_RULE[2])


def error_alerts_5m_low_stream(c: Ctx):
    """ST1 as a stream (threshold 2, see error_alerts_5m_low)."""
    return _stream_alerts(c, ST.ERROR_RULE[0], ST.ERROR_RULE[1], ALERT_THRESHOLD_LOW)


def hourly_events_stream(c: Ctx):
    """ST3 as a stream: hourly counts per event type, emitted as each hour
    closes (watermark 10 minutes)."""
    import uuid
    from tidewater.session import checkpoint_dir
    root = f"{checkpoint_dir(c.spark).rstrip('/')}/tidewater-streams/{uuid.uuid4().hex}"
    stream = ST.streaming_hourly(ST.read_table_stream(c.spark, c.sf_dir, "events"))
    ST.run_to_table(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{root}/out")


def last_day_events_stream(c: Ctx):
    """ST3 with its declared bound: hourly counts of the last 24 hours."""
    import uuid
    from tidewater.session import checkpoint_dir
    root = f"{checkpoint_dir(c.spark).rstrip('/')}/tidewater-streams/{uuid.uuid4().hex}"
    ST.last_day_counts(ST.read_table_stream(c.spark, c.sf_dir, "events"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return K.read_current(c.spark, f"{root}/out")


def error_alert_events(c: Ctx):
    """ST1 as alert states: one event when the rule begins to hold and one
    when it ends (threshold 2, see error_alerts_5m_low)."""
    size, slide, _ = ST.ERROR_RULE
    return ST.alert_events(ST.window_counts(c.t["events"], size=size, slide=slide), slide=slide, threshold=ALERT_THRESHOLD_LOW)


def error_alert_events_stream(c: Ctx):
    """The same as a stream: events of the windows closed by the watermark."""
    import uuid
    from tidewater.session import checkpoint_dir
    root = f"{checkpoint_dir(c.spark).rstrip('/')}/tidewater-streams/{uuid.uuid4().hex}"
    size, slide, _ = ST.ERROR_RULE
    ST.alert_event_stream(ST.read_table_stream(c.spark, c.sf_dir, "events"), f"{root}/out", f"{root}/checkpoint",
                          size=size, slide=slide, threshold=ALERT_THRESHOLD_LOW).awaitTermination()
    return ST.read_alert_events(c.spark, f"{root}/out")


def product_performance_product(c: Ctx):
    """A7 with the product filter."""
    return Q.product_performance(c.sales, c.products, product_code=LOOKUP_PRODUCT)


def sales_enriched_customer(c: Ctx):
    """J1 with the customer filter."""
    return Q.sales_enriched(c.sales, c.customers, c.products, customer_id=LOOKUP_CUSTOMER)


def _filtered_sales(c: Ctx):
    """The rows of the filtered sales-data call (the left joins of the
    enriched form add columns, never rows, so set-level figures need no
    join)."""
    return X.where_opt(c.sales.where(F.col("is_active")), X.sales_filter(**FILTER))


def customer_lookup_batch(c: Ctx):
    """F5 as a batch: every customer that bought in the filter's region and
    period, looked up with a semi join."""
    return Q.customer_lookup(c.customers, _filtered_sales(c).select("customer_id"))


def products_recent(c: Ctx):
    """A6 over the nightly 7-day window."""
    w = R.Warehouse(c.raw_ecc, c.raw_bw, as_of=c.as_of, lookback_days=RAW_LOOKBACK_DAYS)
    return w.products


def sales_recent(c: Ctx):
    """P3 over the nightly 7-day window (one night's sales load)."""
    w = R.Warehouse(c.raw_ecc, c.raw_bw, as_of=c.as_of, lookback_days=RAW_LOOKBACK_DAYS)
    return w.sales


def daily_sales_30d(c: Ctx):
    return I.daily_sales(c.scan(INSIGHT_DAYS, customers=False, products=False))


def customer_analysis_30d(c: Ctx):
    return _cust(c, INSIGHT_DAYS)


def product_analysis_30d(c: Ctx):
    return _prod(c, INSIGHT_DAYS)


def region_analysis_30d(c: Ctx):
    return I.region_analysis(c.scan(INSIGHT_DAYS, customers=False, products=False))


def rep_analysis_30d(c: Ctx):
    return I.rep_analysis(c.scan(INSIGHT_DAYS, customers=False, products=False))


# ------------------------------------------- the client catalogue (§2.13, P5)

PERIOD = dict(start_date=FILTER["start"], end_date=FILTER["end"])


def _records(c: Ctx, name: str, **params) -> DataFrame:
    """A catalogue call as its clients see it: the JSON records, each field
    read back out of the text (times stay ISO text, amounts are numbers)."""
    t = api.Tables(c.sales, c.customers, c.products, c.as_of)
    shape = {n: "string" if d.startswith("timestamp") else "double" if d.startswith("decimal") else d for n, d in api.CATALOGUE[name](t, **params).dtypes}
    ddl = ", ".join(f"{n} {d}" for n, d in shape.items())
    # Records that are no JSON objects of these fields fail the query.
    return api.call(t, name, **params).select(F.from_json("json", ddl, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def api_customer_info(c: Ctx):
    """GetCustomerInfo."""
    return _records(c, "GetCustomerInfo", customer_id=LOOKUP_CUSTOMER)


def api_customer_orders(c: Ctx):
    """GetCustomerOrders."""
    return _records(c, "GetCustomerOrders", customer_id=LOOKUP_CUSTOMER, limit=50)


def api_sales_data(c: Ctx):
    """GetSalesData of a region and period."""
    return _records(c, "GetSalesData", region=FILTER["region"], **PERIOD)


def api_top_customers(c: Ctx):
    """GetTopCustomers of a period."""
    return _records(c, "GetTopCustomers", limit=TOP_K, **PERIOD)


def api_product_performance(c: Ctx):
    """GetProductPerformance."""
    return _records(c, "GetProductPerformance")


def api_regional_sales(c: Ctx):
    """GetRegionalSales of a period."""
    return _records(c, "GetRegionalSales", **PERIOD)


def api_rep_performance(c: Ctx):
    """GetSalesRepPerformance of a period."""
    return _records(c, "GetSalesRepPerformance", **PERIOD)


_FNS = [
    scan_raw_ecc, scan_raw_bw, scan_raw_ecc_recent, scan_raw_bw_recent,
    sales_unified, customer_rollup_ecc, customer_rollup_bw, customers, customers_recent,
    product_rollup_ecc, product_rollup_bw, products, products_ecc_price,
    customer_lookup, product_lookup, sales_enriched, sales_enriched_filtered,
    customer_orders, latest_orders_per_customer,
    product_performance, product_performance_filtered, regional_sales, regional_sales_filtered,
    rep_performance, rep_performance_filtered, top_customers, top_customers_filtered,
    daily_sales, sales_trends, sales_trends_30d, sales_growth, top_days,
    customer_analysis, segment_analysis, retention, retention_30d, top10_customers,
    product_analysis, category_analysis, product_summary, top10_products,
    region_analysis, region_summary, top5_regions, rep_analysis, rep_summary, top5_reps,
    insight_rows, insight_rows_all, insight_figures, cube_days, cube_customers, cube_products, cube_regions, cube_reps,
    amount_quantiles, sales_anomalies, quantity_anomalies, forecast_trend, forecast_features, forecast_naive, forecast_models,
    co_purchase, recommendations, customer_rfm, customer_segments,
    docs_customers, docs_sales, docs_products, docs_all, docs_refreshed, refresh_batches, doc_facets,
    upsert_customers, upsert_products, replace_window_sales,
    set_totals, unique_keys, rows_by_region, rows_by_customer, display_rows, validate_raw, document_roles,
    error_alerts_5m, error_alerts_5m_low, failure_alerts_15m, hourly_events,
    product_performance_product, sales_enriched_customer, customer_lookup_batch,
    products_recent, sales_recent, daily_sales_30d, customer_analysis_30d,
    product_analysis_30d, region_analysis_30d, rep_analysis_30d,
    failure_alerts_15m_stream, error_alerts_5m_low_stream, hourly_events_stream,
    last_day_events_stream, error_alert_events, error_alert_events_stream,
    api_customer_info, api_customer_orders, api_sales_data, api_top_customers, api_product_performance, api_regional_sales, api_rep_performance,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _q(f) for f in _FNS}
