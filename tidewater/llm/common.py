"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tidewater.session import checkpoint_dir

# Fixed by the contract: a word is a run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Rows handed to Python code at once, at most; a batch is also cut at BATCH_BYTES.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package's code, once per application (what
    ``--py-files`` does), so that tasks find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        at = Path(tempfile.mkdtemp(prefix="tidewater-code-")) / "tidewater_code.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)


def tune(spark: SparkSession) -> None:
    """Session settings the operators rely on: small Arrow batches (texts can
    be long) and run-time splitting of skewed join partitions."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read
    back: later steps start from the files, so a lost executor costs no
    recomputation, and ids given by position stay what they are."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BATCH_BYTES (one row at least)."""
    step = max(1, int(len(batch) * BATCH_BYTES / max(1, batch.nbytes)))
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], ddl: str | StructType) -> DataFrame:
    """Run a Python function over slices of rows.

    ``make()`` is called once per task and returns the function, which gets
    the columns as lists and returns the columns of ``ddl``.
    """
    schema = schema_of(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in bounded(batch):
                out = fn(part.to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Running totals over a whole table in a global order, without one task
    seeing all rows: range partitions, totals per partition, then a window
    inside each partition.  ``sums``: result column -> summed column; a
    result holds the total of the rows before this one.
    """
    spark = df.sparkSession
    parts = written(df.repartitionByRange(shuffle_parts(spark), *order)
                    .withColumn("_pid", F.spark_partition_id()), name)
    # One row per partition: a proven bound.
    each = parts.groupBy("_pid").agg(*[F.sum(v).alias(f"_s_{k}") for k, v in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_pid", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(each), "_pid")
    for k, v in sums.items():
        out = out.withColumn(k, F.col(f"_b_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)))
    return out.drop("_pid", *[f"_b_{k}" for k in sums])


FILTER_BITS = 24


def seen_filter(hashes: DataFrame, name: str) -> Callable[[Column], Column]:
    """A test on 64-bit hashes that is true for all of ``hashes`` (one
    column) and for few others: their low FILTER_BITS bits are kept as a
    table of bits, 2 MB whatever the input.  The more hashes there are, the
    more others pass; a join after it decides."""
    spark = hashes.sparkSession
    h = F.col(hashes.columns[0])
    words = (hashes.select(F.shiftright(h.bitwiseAND((1 << FILTER_BITS) - 1), 6).alias("w"), h.bitwiseAND(63).cast("int").alias("b"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")))
    dense = spark.range(1 << (FILTER_BITS - 6)).join(words, F.col("id") == F.col("w"), "left")
    bits = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0)).alias("v")))), lambda x: x["v"]).alias("bits"))
    table_ = written(bits, name).scalar()

    def seen(c: Column) -> Column:
        word = F.get(table_, F.shiftright(c.bitwiseAND((1 << FILTER_BITS) - 1), 6).cast("int"))
        return F.getbit(word, c.bitwiseAND(63).cast("int")) == 1
    return seen
