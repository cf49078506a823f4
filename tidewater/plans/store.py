"""The warehouse store: processed tables written once per input.

The nightly consolidation is a batch job whose outputs are tables; the
query catalogue, reports and documents read those tables, not the raw
exports.  ``materialize`` writes, for one folder of driver tables,

    lines                      (the joined line items that the raw tables
                                raw_ecc and raw_bw are projections of, K1/K2)
    sales, customers, products (the consolidated tables, P3/A3/A6)

as parquet under the shared folder named by ``spark.checkpoint.dir``, each
when it is first asked for.  The line items are joined once, as narrow rows;
they and the sales are written where they are, without another shuffle.  The
location is keyed by the input files (name, size, modification time) and by
a hash of the code that derives the tables, so a changed input or changed
logic never reads a stale store.  A table is written to a private staging
folder and renamed into place when complete; a concurrent or failed build
leaves no partial table behind.  Written tables also cut the lineage, so a
lost executor never recomputes the consolidation.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas as S
from tidewater.session import checkpoint_dir

TABLES = ("lines", "sales", "customers", "products")
SCHEMAS = {"sales": S.SALES, "customers": S.CUSTOMERS, "products": S.PRODUCTS}
RAW = ("raw_ecc", "raw_bw")         # read from the lines
ROW_GROUP = str(4 << 20)            # bytes: what dates and splits are cut to
CODEC = "zstd"                      # two thirds of the bytes of snappy
KEYS = {"sales": "200000", "customers": "50000", "products": "50000"}   # what a row group's bloom filter is made for
_LOCK = threading.Lock()
_READ_CACHE: dict = {}


def _code_hash() -> str:
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for rel in ("schemas.py", "functions/exprs.py", "sources/tables.py", "operators/rollups.py",
                "plans/store.py"):
        with open(os.path.join(here, rel), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def source_key(spark: SparkSession, sf_dir: str, as_of: str) -> str:
    from tidewater.sources.tables import TPCH_TABLES
    h = hashlib.sha1(f"{as_of}|{_code_hash()}".encode())
    for name in TPCH_TABLES:
        fs, p, _ = _fs(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        st = fs.getFileStatus(p)
        h.update(f"{name}|{st.getLen()}|{st.getModificationTime()}|{p.toString()}".encode())
        if st.isDirectory():
            for c in fs.listStatus(p):
                h.update(f"{c.getPath().getName()}|{c.getLen()}|{c.getModificationTime()}".encode())
    return h.hexdigest()[:16]


def store_path(spark: SparkSession, sf_dir: str, as_of: str) -> str:
    root = checkpoint_dir(spark).rstrip("/")
    return f"{root}/tidewater-store/{source_key(spark, sf_dir, as_of)}"


def materialize(spark: SparkSession, sf_dir: str, as_of: str, tables=TABLES) -> str:
    """Build those of ``tables`` that the store for ``sf_dir`` lacks; return
    its path."""
    path = store_path(spark, sf_dir, as_of)
    for table in tables:
        table = "lines" if table in RAW else table
        if not _complete(spark, path, table):
            with _LOCK:
                _build(spark, path, sf_dir, as_of, table)
    return path


def _complete(spark: SparkSession, path: str, table: str) -> bool:
    fs, p, _ = _fs(spark, f"{path}/{table}/_SUCCESS")
    return fs.exists(p)


def _build(spark: SparkSession, path: str, sf_dir: str, as_of: str, table: str) -> None:
    from tidewater.operators.rollups import Warehouse
    from tidewater.sources.tables import lines_from_tpch, load_tables
    if _complete(spark, path, table):
        return
    staging = f"{path}.staging-{uuid.uuid4().hex[:8]}"
    if table == "lines":
        lines = lines_from_tpch(load_tables(spark, sf_dir))
        _writer(_by_date(lines, "l_linestatus", "processed_date")).option("parquet.block.size", ROW_GROUP).partitionBy("l_linestatus").parquet(staging)
    else:
        _build(spark, path, sf_dir, as_of, "lines")
        ecc, bw = (all_rows(read(spark, path, raw)) for raw in RAW)
        wh = Warehouse(ecc, bw, as_of=as_of, lookback_days=None)
        if table == "sales":
            _bloom(table, _writer(_by_date(wh.sales, "sales_date")).option("parquet.block.size", ROW_GROUP), "customer_id", "product_code").parquet(staging)
        elif table == "customers":
            _bloom(table, _writer(wh.customers.repartition("customer_id")), "customer_id").parquet(staging)
        else:
            _bloom(table, _writer(wh.products.repartition("product_code")), "product_code").parquet(staging)
    fs, p, jvm = _fs(spark, staging)
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    fs.mkdirs(done.getParent())
    # Someone else finished first: use theirs.
    if _complete(spark, path, table) or not fs.rename(p, done):
        fs.delete(p, True)


def all_rows(raw: DataFrame) -> DataFrame:
    """A raw table with every row active: the soft deletes that the adapter
    derives from the keys are there for the scan queries alone."""
    return raw.withColumn("is_active", F.lit(True)).withColumn("is_deleted", F.lit(False))


def _writer(df: DataFrame):
    return df.write.option("compression", CODEC)


def _by_date(df: DataFrame, *cols: str) -> DataFrame:
    """Files sorted by date: parquet's statistics of row groups and pages
    then let date filters skip all but the pages that hold the dates.  No
    shuffle brings a date's rows together, so no date is too large for a
    task, and file sizes follow the partitions of the step before."""
    return df.sortWithinPartitions(*cols)


def _bloom(table, writer, *cols):
    """Parquet bloom filters on key columns: an equality filter on a key
    (point look-ups, one customer's orders) skips every row group that
    cannot hold the key, although the files are sorted by date.  A filter is
    as large as KEYS ask for; more keys in a row group only skip less."""
    for c in cols:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", KEYS[table])
    return writer


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table (plans are cached per session; the data is not)."""
    key = (spark.sparkContext.applicationId, id(spark), path, table)
    df = _READ_CACHE.get(key)
    if df is None:
        if table in RAW:
            from tidewater.sources.tables import raw_from_lines
            df = raw_from_lines(spark.read.parquet(f"{path}/lines"))[RAW.index(table)]
        else:
            df = spark.read.parquet(f"{path}/{table}").select(*[f.name for f in SCHEMAS[table].fields])
        _READ_CACHE[key] = df
    return df
