"""ST4/K8/K9: a document set that is changed in place, merge on read.

Documents lie in buckets by a hash of their id.  ``base=<n>/bucket=<b>``
holds a bucket's documents, ``delta=<batch>/bucket=<b>`` the newest change
of each id of a batch, ``rejected/batch=<batch>`` the changes that cannot be
applied, with the reason.  A state file names, for every bucket, its base
and its deltas in order; a batch becomes visible when its state is renamed
into place.  A batch writes its deltas; a bucket with ``merge_every`` deltas
gets a new base, the others stay as they are.

A change counts if its ``timestamp`` is not older than that of the stored
document; of equally new changes of a batch a deletion, then the greatest
(content, metadata) wins, and a later batch wins over an earlier one.  A
deleted document stays as a marker, so an older change does not revive it.

The failure budget is the declared indexer's: a batch with more than
``per_batch`` rejected changes, or with which ``total`` is passed, is not
applied and raises; its rejected rows stay to be looked at.  A batch that is
tried again replaces its own files, and one that is applied already is
skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas as S
from tidewater.sources import sinks as K

BUCKETS = 256
MERGE_EVERY = 8
# The failure budget of the document indexer, in all and in one batch.
MAX_FAILED = 10
MAX_FAILED_PER_BATCH = 5

COLUMNS = [f.name for f in S.DOCUMENT.fields]


class FailureBudget(RuntimeError):
    """Too many changes of a batch, or of all batches, were rejected."""


def rejection(df: DataFrame):
    """Why a document cannot be stored; NULL if it can."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    gone = F.coalesce(F.col("is_deleted"), F.lit(False)) if "is_deleted" in df.columns else F.lit(False)
    return (F.when(empty("id"), "missing id").when(F.col("timestamp").isNull(), "missing timestamp")
            .when(~gone & empty("content"), "missing content"))


def split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected documents with ``reason``)."""
    judged = docs.withColumn("reason", rejection(docs))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _records(docs: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("is_deleted"), F.lit(False)) if "is_deleted" in docs.columns else F.lit(False)
    return K.document_records(docs.withColumn("is_deleted", gone), keep=("is_deleted",))


def _newest(rows: DataFrame) -> DataFrame:
    """One row per (bucket, id), by (timestamp, _seq, deletion, content, metadata)."""
    cols = [*COLUMNS[1:], "is_deleted"]
    order = F.struct("timestamp", "_seq", F.col("is_deleted").cast("int"), "content", "metadata")
    return rows.groupBy("bucket", "id").agg(F.max_by(F.struct(*cols), order).alias("d")).select("bucket", "id", *[F.col(f"d.{c}").alias(c) for c in cols])


def _dirs(spark: SparkSession, path: str) -> list[str]:
    """Buckets that have a directory under ``path``."""
    fs, p, _ = K._fs(spark, path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return [n.split("=", 1)[1] for n in names if n.startswith("bucket=")]


def _write(rows: DataFrame, path: str) -> list[str]:
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return _dirs(rows.sparkSession, path)


def state_of(spark: SparkSession, root: str) -> dict | None:
    """The state of the store, unless a whole set was published since."""
    state = K.read_state(spark, root)
    if not state or "buckets" not in state or state["version"] != (K.current_version(spark, root) or 0):
        return None
    return state


def create(spark: SparkSession, root: str, *, buckets: int = BUCKETS) -> dict:
    """A store of the published version of ``root`` (none: empty).  Documents
    of one id are reduced to the newest."""
    version = K.current_version(spark, root) or 0
    state = {"buckets": buckets, "version": version, "base": {}, "deltas": {}, "failed": 0, "batch": None}
    if version:
        docs = spark.read.parquet(f"{root}/version={version}").select(*COLUMNS)
        rows = docs.withColumns({"is_deleted": F.lit(False), "_seq": F.lit(0), "bucket": _bucket(buckets)})
        number = K._next_number(spark, root, "base=")
        state["base"] = {b: number for b in _write(_newest(rows), f"{root}/base={number}")}
    K.write_state(spark, root, state)
    return state


def _schema():
    from pyspark.sql import types as T
    text = ("timestamp", "sales_date")
    return T.StructType([*[T.StructField(f.name, T.StringType() if f.name in text else f.dataType) for f in S.DOCUMENT.fields], T.StructField("is_deleted", T.BooleanType())])


def _read_dirs(spark: SparkSession, root: str, dirs: list[tuple[str, str]], seq: int) -> DataFrame:
    """Rows of (folder, bucket) directories with their place in the order."""
    out = None
    for folder in dict.fromkeys(f for f, _ in dirs):
        paths = [f"{root}/{folder}/bucket={b}" for f, b in dirs if f == folder]
        rows = spark.read.schema(_schema()).option("basePath", f"{root}/{folder}").parquet(*paths)
        rows = rows.select(*COLUMNS, "is_deleted", F.col("bucket").cast("int").alias("bucket"), F.lit(seq).alias("_seq"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], _schema()).withColumns({"bucket": F.lit(0), "_seq": F.lit(seq)})
    return out


def _merged(spark: SparkSession, root: str, state: dict, buckets) -> DataFrame:
    """The rows of some buckets, markers included, over base and deltas."""
    buckets = set(buckets)
    rows = _read_dirs(spark, root, [(f"base={n}", b) for b, n in state["base"].items() if b in buckets], 0)
    order = list(dict.fromkeys(d for b in sorted(buckets) for d in state["deltas"].get(b, [])))
    order.sort(key=lambda d: state["order"].index(d))
    for i, name in enumerate(order):
        rows = rows.unionByName(_read_dirs(spark, root, [(f"delta={name}", b) for b in buckets if name in state["deltas"].get(b, [])], i + 1))
    return _newest(rows)


def read(spark: SparkSession, root: str, state: dict | None = None) -> DataFrame:
    """The documents of the store: buckets without deltas are read as they
    are, the others merged."""
    state = state or state_of(spark, root)
    plain = _read_dirs(spark, root, [(f"base={n}", b) for b, n in state["base"].items() if not state["deltas"].get(b)], 0)
    changed = [b for b, names in state["deltas"].items() if names]
    rows = plain.select(*COLUMNS, "is_deleted")
    if changed:
        rows = rows.unionByName(_merged(spark, root, state, changed).select(*COLUMNS, "is_deleted"))
    return rows.where(~F.col("is_deleted")).drop("is_deleted")


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """The dead letters of all batches: batch, reason and the document."""
    fs, p, _ = K._fs(spark, f"{root}/rejected")
    if not fs.exists(p):
        return spark.createDataFrame([], _schema()).select(F.lit(None).cast("string").alias("batch"), F.lit(None).cast("string").alias("reason"), *COLUMNS)
    return spark.read.parquet(f"{root}/rejected").select(F.col("batch").cast("string").alias("batch"), "reason", *COLUMNS)


def apply(changes: DataFrame, root: str, batch: str, *, buckets: int = BUCKETS, merge_every: int = MERGE_EVERY,
          max_failed: int = MAX_FAILED, max_failed_per_batch: int = MAX_FAILED_PER_BATCH) -> dict:
    """Apply a batch of changed documents (``is_deleted`` removes one);
    returns its counts: received, rejected, buckets touched, bases rewritten."""
    spark = changes.sparkSession
    batch = K._run_name(batch)
    state = state_of(spark, root) or create(spark, root, buckets=buckets)
    if state["batch"] == batch:
        return {"received": 0, "rejected": 0, "touched": 0, "rewritten": 0}
    good, bad = split(changes)
    seen, failed = Observation("received"), Observation("rejected")
    gone = F.col("is_deleted") if "is_deleted" in bad.columns else F.lit(False)
    dead = K.document_records(bad.withColumn("is_deleted", gone), keep=("reason",))
    dead.observe(failed, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{root}/rejected/batch={batch}")
    n_bad = int(failed.get["n"])
    if n_bad > max_failed_per_batch or state["failed"] + n_bad > max_failed:
        raise FailureBudget(f"batch {batch}: {n_bad} rejected changes, {state['failed']} before it")
    rows = _records(good).observe(seen, F.count(F.lit(1)).alias("n")).withColumns({"_seq": F.lit(0), "bucket": _bucket(state["buckets"])})
    touched = _write(_newest(rows), f"{root}/delta={batch}")
    deltas = {b: list(names) for b, names in state["deltas"].items()}
    for b in touched:
        deltas.setdefault(b, []).append(batch)
    new = dict(state, deltas=deltas, base=dict(state["base"]), failed=state["failed"] + n_bad, batch=batch, order=[*state.get("order", []), batch])
    full = [b for b in touched if len(deltas[b]) >= merge_every]
    if full:
        number = K._next_number(spark, root, "base=")
        new["base"].update({b: number for b in _write(_merged(spark, root, new, full), f"{root}/base={number}")})
        for b in full:
            deltas.pop(b)
    held = {d for names in deltas.values() for d in names}
    new["order"] = [d for d in new["order"] if d in held]
    K.write_state(spark, root, new)
    return {"received": int(seen.get["n"]) + n_bad, "rejected": n_bad, "touched": len(touched), "rewritten": len(full)}
