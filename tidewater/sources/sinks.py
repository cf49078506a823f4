"""Sinks: landing raw files, keyed upserts, idempotent sales loads, insight
rows and document sets.

There is no table format with MERGE here, so a keyed upsert is a full
outer join of the current table with the new rows, written as a new
*version* directory; readers take the newest complete version.  A path is
never overwritten while it is being read, and a failed write leaves the
previous version in place (a version counts once its _SUCCESS marker is
written); its number is not used again.

Sales are kept as *loads*, each partitioned by processing period and sales
month.  A small state file names the loads that hold each period; a load
becomes visible when a new state file is renamed into place.  The processed
tables of a run (customers, products, sales) are named by one state file, so
readers see all of a run or nothing.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas as S
from tidewater.functions import exprs as X


# -------------------------------------------------------------- file system

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p, jvm = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("version=") and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def current_version(spark: SparkSession, root: str) -> int | None:
    v = _versions(spark, root)
    return v[-1] if v else None


def read_current(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """The newest complete version of a published table (None if none), with
    the changes applied to it since, if it is a document set with a store
    (:mod:`tidewater.sources.docstore`)."""
    from tidewater.sources import docstore
    state = docstore.state_of(spark, root)
    if state is not None:
        return docstore.read(spark, root, state)
    v = current_version(spark, root)
    if v is None:
        return None
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{root}/version={v}")


def _next_number(spark: SparkSession, root: str, prefix: str) -> int:
    """One past every directory of that prefix, complete or not."""
    fs, p, _ = _fs(spark, root)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return 1 + max([0, *(int(n.split("=", 1)[1]) for n in names if n.startswith(prefix) and n.split("=", 1)[1].isdigit())])


def publish(df: DataFrame, root: str, *, partition_by=None, max_records_per_file=None) -> int:
    """Write ``df`` as the next version of the table at ``root``."""
    spark = df.sparkSession
    v = _next_number(spark, root, "version=")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.parquet(f"{root}/version={v}")
    return v


# -------------------------------------------------------------- state files

def read_state(spark: SparkSession, root: str) -> dict | None:
    """The newest state file under ``root`` (None if there is none)."""
    fs, p, jvm = _fs(spark, f"{root}/_state")
    if not fs.exists(p):
        return None
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
    if not numbers:
        return None
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(p, f"{max(numbers)}.json"))
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) | {"number": max(numbers)}


def read_states(spark: SparkSession, root: str, last: int) -> list[dict]:
    """The newest ``last`` states, newest first."""
    fs, p, jvm = _fs(spark, f"{root}/_state")
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    numbers = sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)[:last]
    out = []
    for n in numbers:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(p, f"{n}.json"))
        try:
            out.append(json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": n})
        finally:
            stream.close()
    return out


def write_state(spark: SparkSession, root: str, state: dict) -> None:
    """Make ``state`` the newest: written aside, then renamed into place.
    Raises if another run took the number meanwhile."""
    now = read_state(spark, root)
    number = (now["number"] if now else 0) + 1
    fs, p, jvm = _fs(spark, f"{root}/_state")
    fs.mkdirs(p)
    aside = jvm.org.apache.hadoop.fs.Path(p, f"{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "number"}).encode()))
    finally:
        out.close()
    final = jvm.org.apache.hadoop.fs.Path(p, f"{number}.json")
    if fs.exists(final) or not fs.rename(aside, final):
        raise RuntimeError(f"another run has written state {number} of {root}")


# ---------------------------------------------------------------- retention

def _expire_dirs(spark: SparkSession, root: str, prefix: str, keep: set) -> list[str]:
    """Delete the directories ``<prefix><name>`` of ``root`` whose name is not
    kept.  Numbered ones above every kept number belong to a run that has not
    published yet, and stay."""
    fs, p, _ = _fs(spark, root)
    if not fs.exists(p) or not keep:
        return []
    newest = max((int(k) for k in keep if str(k).isdigit()), default=None)
    gone = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if not name.startswith(prefix):
            continue
        own = name[len(prefix):]
        if own in {str(k) for k in keep} or (own.isdigit() and (newest is None or int(own) > newest)):
            continue
        fs.delete(st.getPath(), True)
        gone.append(name)
    return sorted(gone)


def _expire_states(spark: SparkSession, root: str, kept: list[dict]) -> None:
    fs, p, _ = _fs(spark, f"{root}/_state")
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) < min(s["number"] for s in kept):
            fs.delete(st.getPath(), False)


def expire_versions(spark: SparkSession, root: str, *, keep: int = 2) -> list[str]:
    """K9: delete all but the newest ``keep`` complete versions of a
    published table; readers of those go on."""
    return _expire_dirs(spark, root, "version=", set(_versions(spark, root)[-keep:]))


def expire_processed(spark: SparkSession, root: str, *, keep: int = 2) -> list[str]:
    """K5/K6: delete the loads and table versions that none of the newest
    ``keep`` states names; readers of those states go on."""
    states = read_states(spark, root, keep)
    if not states:
        return []
    loads = {n for s in states for numbers in s["sales"]["periods"].values() for n in numbers}
    gone = _expire_dirs(spark, f"{root}/sales", "load=", loads)
    for table in ("customers", "products"):
        gone += _expire_dirs(spark, f"{root}/{table}", "version=", {s[table] for s in states})
    _expire_states(spark, root, states)
    return gone


def expire_sales(spark: SparkSession, path: str, *, keep: int = 2) -> list[str]:
    """K5: the same for a sales table with states of its own."""
    states = read_states(spark, path, keep)
    if not states:
        return []
    gone = _expire_dirs(spark, path, "load=", {n for s in states for numbers in s["periods"].values() for n in numbers})
    _expire_states(spark, path, states)
    return gone


def expire_documents(spark: SparkSession, root: str, *, keep: int = 2) -> list[str]:
    """K8/K9: delete the bases and deltas of a document store that none of
    its newest ``keep`` states names."""
    states = [s for s in read_states(spark, root, keep) if "buckets" in s]
    if not states:
        return []
    gone = _expire_dirs(spark, root, "base=", {n for s in states for n in s["base"].values()})
    gone += _expire_dirs(spark, root, "delta=", {d for s in states for names in s["deltas"].values() for d in names} | {s["batch"] for s in states if s["batch"]})
    _expire_states(spark, root, states)
    return gone


# -------------------------------------------------------------- raw landing

def land_raw(df: DataFrame, path: str, *, fmt: str = "parquet", granularity: str = "day", load=None) -> None:
    """K1: append an export to the lake, partitioned by processing day
    (or month) so a later scan with a look-back window prunes whole
    directories.  With ``load`` (the export's name) the rows lie under that
    name, so an export that is landed again replaces its own rows."""
    name = "processed_" + granularity
    w = (df.withColumn(name, _period(F.col("processed_date"), granularity))
           .hint("rebalance", name)       # a period's rows meet in as few files as their size allows
           .write.partitionBy(name).format(fmt))
    if load is None:
        w.mode("append").save(path)
    else:
        w.mode("overwrite").save(f"{path}/load={_run_name(load)}")


def _period(c, granularity: str):
    if granularity == "day":
        return F.to_date(c)
    if granularity == "month":
        return F.date_format(c, "yyyy-MM")
    raise ValueError(granularity)


# ------------------------------------------------------------------ upserts

def upsert(target: DataFrame | None, source: DataFrame, key: str, update_cols, *,
           as_of, insert_defaults: dict | None = None) -> DataFrame:
    """Keyed MERGE as a DataFrame.

    matched      -> ``update_cols`` from the source, ``updated_date = as_of``,
                    every other column kept from the target;
    not matched  -> source row inserted with created/updated = ``as_of``,
                    is_active = true (plus ``insert_defaults``);
    target only  -> kept unchanged.

    Both sides are unique by key: one full outer join on it, whatever the
    sizes; AQE sizes its partitions at run time.
    """
    cols = target.columns if target is not None else source.columns
    if target is None:
        target = source.sparkSession.createDataFrame([], source.schema)
    src = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns])
    tgt = target.select(*[F.col(c).alias(f"t_{c}") for c in cols])
    both = tgt.join(src, F.col(f"t_{key}") == F.col(f"s_{key}"), "full_outer")
    return _merge_cols(both, target, source, key, update_cols, as_of, insert_defaults)


def _merge_cols(j: DataFrame, target: DataFrame, source: DataFrame, key: str, update_cols,
                as_of, insert_defaults) -> DataFrame:
    now = X.ts_lit(as_of)
    matched = F.col(f"t_{key}").isNotNull() & F.col(f"s_{key}").isNotNull()
    new = F.col(f"t_{key}").isNull()
    defaults = dict(insert_defaults or {})
    out = []
    for c in target.columns:
        t, s = F.col(f"t_{c}"), (F.col(f"s_{c}") if c in source.columns else F.lit(None))
        if c == key:
            v = F.coalesce(t, s)
        elif c in update_cols:
            v = F.when(new | matched, s).otherwise(t)
        elif c == "updated_date":
            v = F.when(new | matched, now).otherwise(t)
        elif c == "created_date":
            v = F.when(new, now).otherwise(t)
        elif c == "is_active":
            v = F.when(new, F.lit(True)).otherwise(t)
        elif c in defaults:
            v = F.when(new, F.coalesce(s, defaults[c])).otherwise(t)
        else:
            v = F.when(new, s).otherwise(t)
        out.append(v.cast(target.schema[c].dataType).alias(c))
    return j.select(*out)


CUSTOMER_UPDATE = ("customer_segment", "region", "sales_rep", "total_orders",
                   "total_sales_amount", "last_order_date")
PRODUCT_UPDATE = ("product_category", "unit_price", "total_quantity_sold", "total_sales_amount")


def upsert_customers(target: DataFrame | None, source: DataFrame, *, as_of) -> DataFrame:
    """K3."""
    return upsert(target, source, "customer_id", CUSTOMER_UPDATE, as_of=as_of)


def upsert_products(target: DataFrame | None, source: DataFrame, *, as_of) -> DataFrame:
    """K4."""
    return upsert(target, source, "product_code", PRODUCT_UPDATE, as_of=as_of)


# -------------------------------------------------------------- sales loads

def replace_window(target: DataFrame, new: DataFrame, *, window_col: str = "processed_date",
                   start) -> DataFrame:
    """K5 idempotent mode as a DataFrame: drop the target rows of the load
    window, then add the new rows.  Running the same window twice gives the
    same table."""
    keep = target.where(F.col(window_col).isNull() | (F.col(window_col) < X.ts_lit(start)))
    return keep.unionByName(new.select(*target.columns))


def _period_text(value, granularity: str) -> str:
    """The partition value of a time, as a directory has it."""
    day = str(value)[:10]
    return day if granularity == "day" else day[:7]


def read_sales(spark: SparkSession, path: str, state: dict | None = None, *, months_from: str | None = None) -> DataFrame | None:
    """The sales table of ``state`` (default: the newest one at ``path``),
    with its partition columns.  ``months_from`` (yyyy-MM) leaves out
    directories of earlier sales months."""
    state = state or read_state(spark, path)
    if not state or not state["periods"]:
        return None
    col = "processed_" + state["granularity"]
    dirs = [f"{path}/load={n}/{col}={p}" for p, loads in state["periods"].items() for n in loads]
    df = spark.read.option("basePath", path).schema(_sales_file_schema(col)).parquet(*dirs)
    return df if months_from is None else df.where(F.col("sales_month") >= months_from)


def _sales_file_schema(col: str):
    from pyspark.sql import types as T
    return T.StructType([*S.SALES.fields, T.StructField("load", T.IntegerType()),
                         T.StructField(col, T.StringType()), T.StructField("sales_month", T.StringType())])


def _stage_sales(sales: DataFrame, path: str, state: dict | None, *, mode: str, granularity: str, start) -> tuple[int, dict]:
    """Write a load; the rows written and the state that makes it visible."""
    from pyspark.sql import Observation
    spark = sales.sparkSession
    if state and state["granularity"] != granularity:
        raise ValueError(f"the table is partitioned by {state['granularity']}")
    col = "processed_" + granularity
    new = sales.select(*[f.name for f in S.SALES.fields])
    obs = Observation("sales_rows")
    new = new.observe(obs, F.count(F.lit(1)).alias("n"))
    periods = dict(state["periods"]) if state else {}
    if mode == "replace_window":
        if start is None:
            periods = {}
        else:
            edge = _period_text(start, granularity)
            held = periods.get(edge)
            periods = {p: n for p, n in periods.items() if p < edge or p.startswith("__HIVE")}
            if held:                        # rows of the first period from before the window
                before = read_sales(spark, path, {"granularity": granularity, "periods": {edge: held}})
                new = new.unionByName(before.where(F.col("processed_date") < X.ts_lit(start)).select(*new.columns))
    elif mode != "append":
        raise ValueError(mode)
    number = _next_number(spark, path, "load=")
    out = f"{path}/load={number}"
    (new.withColumn(col, _period(F.col("processed_date"), granularity).cast("string"))
        .withColumn("sales_month", F.date_format("sales_date", "yyyy-MM"))
        .hint("rebalance", col, "sales_month")
        .write.partitionBy(col, "sales_month").parquet(out))
    fs, p, _ = _fs(spark, out)
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(col + "="):
            period = name.split("=", 1)[1]
            periods[period] = [*periods.get(period, []), number]
    return int(obs.get["n"]), {"granularity": granularity, "periods": periods}


def write_sales(sales: DataFrame, path: str, *, mode: str = "append", granularity: str = "day", start=None) -> int:
    """K5: ``append`` adds the rows (re-running a window duplicates them, as
    the original load does); ``replace_window`` replaces the rows processed
    from ``start`` on (None: all rows) by ``sales``, those of periods without
    a new row, too, and keeps the earlier rows of the period that ``start``
    falls in, so re-running a window is idempotent at any hour.  Files are
    partitioned by processing day (or month) and sales month (V3).  Returns
    the number of rows of ``sales``, observed during the write."""
    spark = sales.sparkSession
    n, state = _stage_sales(sales, path, read_state(spark, path), mode=mode, granularity=granularity, start=start)
    write_state(spark, path, state)
    return n


def read_processed(spark: SparkSession, root: str, *, months_from: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(sales, customers, products) of the last complete run."""
    state = read_state(spark, root)
    if state is None:
        return None
    sales = read_sales(spark, f"{root}/sales", state["sales"], months_from=months_from)
    if sales is None:
        sales = spark.createDataFrame([], _sales_file_schema("processed_" + state["sales"]["granularity"]))
    tables = (spark.read.parquet(f"{root}/{t}/version={state[t]}") for t in ("customers", "products"))
    return sales, *tables


def save_processed(customers: DataFrame, products: DataFrame, sales: DataFrame, root: str, *,
                   as_of, sales_mode: str = "replace_window", granularity: str = "day", start=None) -> dict:
    """K6: upsert customers and products into new versions and load sales,
    then publish all three with one state file.  A missing unit price is
    saved as 0.  (Callers skip empty inputs by checking the raw scans, which
    costs one row read, not an extra job over the aggregates.)"""
    spark = customers.sparkSession
    state = read_state(spark, root) or {}
    priced = lambda df: df.withColumn("unit_price", F.coalesce("unit_price", F.lit(0)).cast(df.schema["unit_price"].dataType))
    out = {}
    for name, df, fn in (("customers", customers, upsert_customers),
                         ("products", priced(products), upsert_products)):
        cur = spark.read.parquet(f"{root}/{name}/version={state[name]}") if name in state else None
        out[name] = publish(fn(cur, df, as_of=as_of), f"{root}/{name}")
    out["sales_rows"], loads = _stage_sales(priced(sales), f"{root}/sales", state.get("sales"), mode=sales_mode,
                                            granularity=granularity, start=start)
    write_state(spark, root, {"customers": out["customers"], "products": out["products"], "sales": loads})
    return out


def _run_name(run) -> str:
    """A run or load as a directory name."""
    return re.sub(r"[^0-9A-Za-z_.-]", "_", str(run))


def save_insights(rows: DataFrame, path: str, *, run=None) -> None:
    """K7: append the insight rows of a run.  With ``run`` (its as-of time)
    the rows are kept under that name, so a run that is tried again replaces
    its own rows."""
    if run is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/run={_run_name(run)}")


# ----------------------------------------------------------------- documents

def document_records(docs: DataFrame, keep=()) -> DataFrame:
    """K8 cleaning: timestamps as ISO text, NaN as NULL (``keep``: further
    columns to pass on)."""
    cols = []
    for f in S.DOCUMENT.fields:
        c = F.col(f.name)
        if f.name in ("timestamp", "sales_date"):
            c = X.iso_ts(c)
        elif f.dataType == S.DOCUMENT["sales_amount"].dataType:
            c = F.nanvl(c, F.lit(None).cast("double"))
        cols.append(c.alias(f.name))
    return docs.select(*cols, *keep)


def write_documents(docs: DataFrame, root: str, *, batch_size: int | None = None) -> int:
    """Replace the document set (a new version; the previous one
    stays readable until the new one is complete).  Files follow the size of
    the data; ``batch_size`` limits the documents per file for a consumer
    that uploads file by file."""
    return publish(document_records(docs).hint("rebalance"), root, max_records_per_file=batch_size)


def rebuild_documents(customers: DataFrame, sales: DataFrame, products: DataFrame, root: str, *,
                      as_of, days: int | None = 30, batch_size: int | None = None) -> tuple[int, int]:
    """Build the whole document set (one job), publish it as a new
    version and return (version, documents written).  The count is observed
    while writing, not by a second pass.  An empty set publishes an empty
    version: the previous set is replaced (cleared), as a rebuild does."""
    from pyspark.sql import Observation
    from tidewater.operators.documents import all_documents
    docs = all_documents(customers, sales, products, as_of=as_of, days=days)
    obs = Observation("documents")
    v = write_documents(docs.observe(obs, F.count(F.lit(1)).alias("n")), root, batch_size=batch_size)
    return v, int(obs.get["n"])
