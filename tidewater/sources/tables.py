"""Table sources: the driver's parquet tables, raw exports (CSV / JDBC) and
the scans the consolidation reads."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import schemas as S
from tidewater.functions import exprs as X

TPCH_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


class Tables(dict):
    """Lazily loaded parquet tables of one folder, by name."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__()
        self.spark = spark
        self.root = root.rstrip("/")

    def __missing__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        self[name] = df
        return df


def load_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root)


# ---------------------------------------------------------------------------
# Adapter: driver tables -> raw order lines (ECC) and warehouse sales (BW).
# Open lines ('O') become order lines, finished lines ('F') warehouse sales.
# NULLs, zero quantities and soft deletes are derived from the keys so that
# any engine can reproduce the same raw tables.
# ---------------------------------------------------------------------------

def _line_base(t) -> DataFrame:
    """Line items with order, customer (region), part and supplier columns.

    Join order is chosen for what the joins send: line items meet the parts
    as they are, then, two columns wider, the orders, which have met their
    customers before (orders are a quarter of the line rows) and bring the
    most columns; the suppliers' names come last.  Columns that only one of
    the two raw tables reads are kept on its lines alone, before they are
    sent on.  nation (25 rows) and region (5 rows) are fixed-size code
    tables and are broadcast; every other join is left to the planner, which
    broadcasts only what its size check admits (AQE at run time).
    """
    region = t["region"].select("r_regionkey", "r_name")
    nation = t["nation"].select("n_nationkey", "n_regionkey")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey) \
                .select("n_nationkey", "r_name")
    cust = t["customer"].select("c_custkey", "c_nationkey", "c_mktsegment") \
        .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")) \
        .select("c_custkey", "c_mktsegment", "r_name")
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority") \
        .join(cust, F.col("o_custkey") == F.col("c_custkey")) \
        .drop("c_custkey")
    li = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate")
    supp = t["supplier"].select("s_suppkey", "s_name")
    part = t["part"].select("p_partkey", "p_type", "p_retailprice")
    b = li.where(F.col("l_linestatus").isin("O", "F")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    b = b.select(*li.columns, _of("F", "p_type"), _of("O", "p_retailprice"))
    b = b.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    b = b.select(*li.columns, "p_type", "p_retailprice", "o_custkey", "r_name",
                 _of("O", "o_orderstatus"), _of("F", "o_orderpriority"), _of("F", "c_mktsegment"))
    return b.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))


def _of(status: str, col: str) -> F.Column:
    return F.when(F.col("l_linestatus") == status, F.col(col)).alias(col)


def _row_id(*cols) -> F.Column:
    """Deterministic 128-bit row id: stable across task retries, unlike uuid()."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256), 1, 32)


LINES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate",
         "o_custkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name", "s_name", "p_type", "p_retailprice")


def lines_from_tpch(t) -> DataFrame:
    """The line items of both raw tables with what these are derived from,
    and their processing date: narrow rows, to be stored and shuffled in
    place of the wide raw ones.  Prices are cents, as both raw tables have
    them."""
    money = ("l_extendedprice", "p_retailprice")
    return _line_base(t).select(*[F.col(c).cast(S.MONEY).alias(c) if c in money else c for c in LINES],
                                X.add_days("l_shipdate", F.col("l_linenumber") % 3).alias("processed_date"))


def raw_from_tpch(t) -> tuple[DataFrame, DataFrame]:
    """(raw_ecc, raw_bw) in the raw table schemas, derived from the driver's
    TPC-H style tables."""
    return raw_from_lines(lines_from_tpch(t))


def raw_from_lines(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw_ecc, raw_bw) of the rows of :func:`lines_from_tpch`: a projection."""
    common = dict(
        customer_id=F.concat(F.lit("C"), F.col("o_custkey").cast("string")),
        product_code=F.concat(F.lit("P"), F.col("l_partkey").cast("string")),
        processed_date=F.col("processed_date"),
        sales_rep=F.when(F.col("l_suppkey") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")),
        region=F.when(F.col("o_custkey") % 20 == 0, F.lit(None).cast("string")).otherwise(F.col("r_name")),
        is_active=F.col("l_orderkey") % 50 != 0,
        is_deleted=F.col("l_partkey") % 97 == 0,
        validation_errors=F.lit(None).cast("string"),
    )
    amount = F.col("l_extendedprice").cast(S.MONEY)
    qty = F.col("l_quantity").cast(S.MONEY)
    key_cols = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")

    ecc_src = b.where(F.col("l_linestatus") == "O")
    ecc = ecc_src.select(
        _row_id(*key_cols).alias("id"),
        common["customer_id"].alias("customer_id"),
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("order_number"),
        F.col("l_shipdate").alias("order_date"),
        common["product_code"].alias("product_code"),
        qty.alias("quantity"),
        F.col("p_retailprice").cast(S.MONEY).alias("unit_price"),
        amount.alias("total_amount"),
        F.col("o_orderstatus").alias("status"),
        common["sales_rep"].alias("sales_rep"),
        common["region"].alias("region"),
        common["processed_date"].alias("processed_date"),
        F.lit(S.SOURCE_ECC).alias("data_source"),
        common["is_active"].alias("is_active"),
        common["is_deleted"].alias("is_deleted"),
        common["validation_errors"].alias("validation_errors"),
    )
    bw_src = b.where(F.col("l_linestatus") == "F")
    bw = bw_src.select(
        _row_id(*key_cols).alias("id"),
        common["customer_id"].alias("customer_id"),
        common["product_code"].alias("product_code"),
        amount.alias("sales_amount"),
        F.when(F.col("l_orderkey") % 101 == 0, F.lit(0).cast(S.MONEY)).otherwise(qty).alias("sales_quantity"),
        F.col("l_shipdate").alias("sales_date"),
        common["sales_rep"].alias("sales_rep"),
        common["region"].alias("region"),
        F.col("o_orderpriority").alias("channel"),
        F.when(F.col("l_partkey") % 25 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("product_category"),
        F.when(F.col("o_custkey") % 15 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("customer_segment"),
        common["processed_date"].alias("processed_date"),
        F.lit(S.SOURCE_BW).alias("data_source"),
        common["is_active"].alias("is_active"),
        common["is_deleted"].alias("is_deleted"),
        common["validation_errors"].alias("validation_errors"),
    )
    return ecc, bw


# ---------------------------------------------------------------------------
# Raw exports: CSV files (S1/S2), JDBC tables (S7) and load defaults (K2).
# ---------------------------------------------------------------------------

def snake(name: str) -> str:
    """'CustomerID' -> 'customer_id', 'SalesAmount' -> 'sales_amount'."""
    s = re.sub(r"[\s\-]+", "_", name.strip())
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    return s.lower()


def _schema_for(kind: str) -> T.StructType:
    return {"ecc": S.RAW_ECC, "bw": S.RAW_BW}[kind]


def conform_raw(df: DataFrame, kind: str, *, rename: dict | None = None,
                as_of=None) -> DataFrame:
    """Give an export the raw table schema.

    Header names are mapped to snake_case (plus an optional ``rename`` map
    for other layouts); missing columns become NULL or take the table
    defaults (K2); values that do not cast are set to NULL and named in
    ``validation_errors``.  Everything is one projection, no shuffle.
    """
    schema = _schema_for(kind)
    rename = {snake(k): v for k, v in (rename or {}).items()}
    src = {}
    for c in df.columns:
        n = snake(c)
        src[rename.get(n, n)] = F.col(f"`{c}`")
    cols, errors = [], []
    for f in schema.fields:
        if f.name in src:
            raw = src[f.name]
            if isinstance(f.dataType, T.StringType):
                val = raw.cast("string")
            else:
                val = raw.try_cast(f.dataType)
                errors.append(F.when(raw.isNotNull() & val.isNull(), F.lit(f"bad {f.name}")))
            cols.append((f.name, val))
        else:
            cols.append((f.name, None))
    out = []
    defaults = _defaults(kind, as_of)
    for name, val in cols:
        f = schema[name]
        if val is None:
            val = defaults.get(name, F.lit(None).cast(f.dataType))
        elif name in defaults:
            val = F.coalesce(val, defaults[name])
        out.append(val.alias(name))
    err = F.nullif(F.concat_ws(";", *errors), F.lit("")) if errors else F.lit(None).cast("string")
    res = df.select(*out, err.alias("_errors"))
    keys = S.ECC_SCAN_COLUMNS if kind == "ecc" else S.BW_SCAN_COLUMNS
    res = res.withColumn("id", F.coalesce(F.col("id"), _row_id(*keys))) \
             .withColumn("validation_errors", F.nullif(F.concat_ws(";", F.nullif(F.col("validation_errors"), F.lit("")), F.col("_errors")), F.lit("")))
    return res.drop("_errors")


def _defaults(kind: str, as_of) -> dict:
    src = S.SOURCE_ECC if kind == "ecc" else S.SOURCE_BW
    d = {
        "data_source": F.lit(src),
        "is_active": F.lit(True),
        "is_deleted": F.lit(False),
    }
    # The time of loading, unless the caller fixes it.
    d["processed_date"] = F.localtimestamp() if as_of is None else X.ts_lit(as_of)
    return d


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """Every ``*.csv`` under ``path`` (recursive), or the file itself."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isFile():
        return [path]
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next().getPath()
        if f.getName().endswith(".csv"):
            found.append(f.toString())
    return sorted(found)


def csv_header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The column names of one CSV file, in its order (reads one line)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(file)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([(line or "").lstrip("\ufeff")]), ()))


def read_raw_csv(spark: SparkSession, path, kind: str, *, rename: dict | None = None,
                 as_of=None) -> DataFrame:
    """Every ``*.csv`` under ``path`` (recursive; or a list of files),
    header row, comma, UTF-8.  Columns go by name: files are read together
    with those of the same header, and each such set is typed by
    :func:`conform_raw`, so neither another column order nor a missing
    column nor a malformed value moves or loses a value."""
    files = csv_files(spark, path) if isinstance(path, str) else list(path)
    by_header: dict[tuple, list[str]] = {}
    for f in files:
        if header := csv_header(spark, f):
            by_header.setdefault(header, []).append(f)
    out = spark.createDataFrame([], _schema_for(kind))
    for header, own in by_header.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        df = spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(own)
        out = out.unionByName(conform_raw(df, kind, rename=rename, as_of=as_of))
    return out


# What a raw row must satisfy (V1), in order: (rule, columns or amounts it is about).
REQUIRED = {"ecc": ("customer_id", "order_number", "order_date", "product_code", "quantity", "unit_price", "total_amount"),
            "bw": ("customer_id", "product_code", "sales_amount", "sales_quantity", "sales_date")}
NOT_NEGATIVE = {"ecc": ("quantity", "unit_price", "total_amount"), "bw": ("sales_amount", "sales_quantity")}


def validate_raw(raw: DataFrame, kind: str) -> DataFrame:
    """V1: the rows with every rule they break added to
    ``validation_errors`` (NULL: valid).  Values that did not cast are named
    there by :func:`conform_raw` already."""
    broken = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED[kind]]
    broken += [F.when(F.col(c) < 0, F.lit(f"negative {c}")) for c in NOT_NEGATIVE[kind]]
    text = F.concat_ws(";", F.nullif(F.col("validation_errors"), F.lit("")), *broken)
    return raw.withColumn("validation_errors", F.nullif(text, F.lit("")))


def split_valid(raw: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows) by :func:`validate_raw`."""
    checked = validate_raw(raw, kind)
    return checked.where("validation_errors IS NULL"), checked.where("validation_errors IS NOT NULL")


def read_jdbc(spark: SparkSession, url: str, table: str, kind: str | None = None, *,
              properties: dict | None = None, partition_column: str | None = None,
              lower_bound=None, upper_bound=None, num_partitions: int | None = None) -> DataFrame:
    """A database table read in parallel slices of ``partition_column``."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions or 8))
    df = r.load()
    return conform_raw(df, kind) if kind else df.toDF(*[snake(c) for c in df.columns])


# ---------------------------------------------------------------------------
# Scans read by the consolidation (S3/S4): active, not deleted, look-back.
# ---------------------------------------------------------------------------

def scan_raw(raw: DataFrame, columns, *, as_of=None, lookback_days: int | None = 7) -> DataFrame:
    pred = X.and_all([F.col("is_active") & ~F.col("is_deleted"),
                      X.lookback("processed_date", as_of, lookback_days)])
    return raw.where(pred).select(*columns)


def scan_raw_ecc(raw_ecc: DataFrame, *, as_of=None, lookback_days: int | None = 7) -> DataFrame:
    return scan_raw(raw_ecc, S.ECC_SCAN_COLUMNS, as_of=as_of, lookback_days=lookback_days)


def scan_raw_bw(raw_bw: DataFrame, *, as_of=None, lookback_days: int | None = 7) -> DataFrame:
    return scan_raw(raw_bw, S.BW_SCAN_COLUMNS, as_of=as_of, lookback_days=lookback_days)
