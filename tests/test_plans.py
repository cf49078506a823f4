"""Plan shape of every registered query: JVM-only, no pair-emitting joins,
filters and projections pushed into the scans."""

import contextlib
import io

import pytest

import __spark_entry__ as E
from tidewater.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_is_jvm_only_without_pair_joins(spark, name):
    text = plan(E.queries()[name](spark, SF), "simple")
    for node in FORBIDDEN:
        assert node not in text, f"{name}: {node}"


def test_date_filter_reaches_scan(spark):
    text = plan(E.queries()["regional_sales_filtered"](spark, SF))
    assert "PushedFilters: [IsNotNull(is_active), IsNotNull(sales_date), EqualTo(is_active,true), " \
           "GreaterThanOrEqual(sales_date,1998-01-01T00:00), LessThanOrEqual(sales_date,1999-12-31T00:00)]" in text


def test_projection_pruned_at_scan(spark):
    text = plan(E.queries()["regional_sales"](spark, SF))
    scan = [ln for ln in text.splitlines() if ln.startswith("ReadSchema")]
    assert scan == ["ReadSchema: struct<customer_id:string,sales_amount:decimal(18,2),"
                    "sales_quantity:decimal(18,2),region:string,is_active:boolean>"]


def test_codegen_and_partial_aggregation(spark):
    text = plan(E.queries()["customer_analysis"](spark, SF), "simple")
    assert "partial_" in text               # map-side combine before the exchange
    assert text.count("Exchange hashpartitioning(customer_id") == 1
    df = E.queries()["regional_sales"](spark, SF)
    df.collect()                            # AQE shows codegen stages in the final plan
    text = plan(df, "formatted")
    assert "* HashAggregate" in text and "* Filter" in text   # inside whole-stage codegen


def test_top_k_is_take_ordered(spark):
    for name in ("top_customers", "top10_customers", "top_days", "customer_orders"):
        assert "TakeOrderedAndProject" in plan(E.queries()[name](spark, SF), "simple"), name


def test_group_limit_before_shuffle(spark):
    text = plan(E.queries()["latest_orders_per_customer"](spark, SF), "simple")
    assert text.count("WindowGroupLimit") == 2      # partial (map side) + final


def test_store_builds_only_what_a_query_reads(spark, tmp):
    """daily sales need the lines and the sales, and sales are written without a shuffle of their own."""
    import os
    import shutil

    from pyspark.sql import functions as F

    from tidewater.plans import store
    from tidewater.sources import tables as T
    sf = f"{tmp}/sf"
    shutil.copytree(SF, sf)
    got = {r["sales_day"]: r["total_sales"] for r in E.queries()["daily_sales"](spark, sf).collect()}
    path = store.store_path(spark, sf, "2001-11-05")
    assert sorted(os.listdir(path.removeprefix("file:"))) == ["lines", "sales"]
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    want = {r["d"]: r["s"] for r in li.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("s")).collect()}
    assert got == want
    # Stored raw rows are those derived from the tables.
    for name, direct in zip(store.RAW, T.raw_from_tpch(T.load_tables(spark, sf))):
        kept = store.read(spark, path, name)
        assert kept.schema.simpleString() == direct.schema.simpleString()
        assert kept.exceptAll(direct).isEmpty() and direct.exceptAll(kept).isEmpty()
    text = plan(store._by_date(E.queries()["sales_unified"](spark, sf), "sales_date"), "simple")
    assert "Exchange" not in text


def test_shuffles_start_with_partitions_for_the_input(spark, tmp):
    """what one task holds does not grow with the input."""
    from tidewater.session import SPREAD_BYTES, spread_shuffles
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        with open(f"{tmp}/a.parquet", "wb") as f:
            f.truncate(40 * SPREAD_BYTES)
        assert spread_shuffles(spark, tmp) == 40 and spark.conf.get(name) == "40"
        assert spread_shuffles(spark, f"{tmp}/none") == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(name)


def test_merged_shuffle_partitions_stay_small(spark, tmp):
    """F16: a task gets no more merged partitions than it can sort or group in memory."""
    from tidewater.session import MERGE_BYTES, spread_shuffles
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64MB")
        spread_shuffles(spark, f"{tmp}/none")
        assert spark.conf.get(name) == str(MERGE_BYTES) and MERGE_BYTES <= 16 << 20
    finally:
        spark.conf.set(name, before)


def test_cube_tasks_read_no_more_than_a_small_row_group(spark, tmp):
    """F16: the store's row groups and the cube's splits bound what a task groups; its own settings do not stay."""
    import glob

    import pyarrow.parquet as pq

    from tidewater.operators import cube
    from tidewater.plans import store
    from tidewater.plans.catalog import Ctx
    assert int(store.ROW_GROUP) <= int(cube.SPLIT) <= 4 << 20
    c, name = Ctx(spark, SF), "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name)
    cube.Cube(c.scan(customers=False, products=False)).remove()
    assert spark.conf.get(name) == before
    path = store.store_path(spark, SF, "2001-11-05").removeprefix("file:")
    sizes = [m.row_group(i).total_byte_size for m in (pq.read_metadata(f) for f in glob.glob(f"{path}/sales/*.parquet")) for i in range(m.num_row_groups)]
    assert sizes and max(sizes) < 6 << 20


def test_cube_is_written_without_second_shuffle(spark, tmp, monkeypatch):
    """the cube's groups are written where they are, and its settings do not stay."""
    from tidewater.operators import cube
    from tidewater.plans.catalog import Ctx
    seen = []
    real = cube.report_cube
    monkeypatch.setattr(cube, "report_cube", lambda scan: seen.append(real(scan)) or seen[-1])
    names = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.files.maxPartitionBytes")
    before = [spark.conf.get(n) for n in names]
    hints = []
    scan = Ctx(spark, SF).scan(customers=False, products=False)
    monkeypatch.setattr(type(scan), "hint", lambda self, *a: hints.append(a) or self)
    made = cube.Cube(scan)
    assert not hints and [spark.conf.get(n) for n in names] == before
    assert made.part("product").count() == seen[0].where("part = 'product'").count() > 0


def test_store_lines_hold_what_their_raw_table_reads(spark, tmp):
    """Texts of the other raw table are not sent or stored, prices are cents, files are zstd."""
    import glob

    import pyarrow.parquet as pq

    from tidewater.plans import store
    from tidewater.sources import tables as T
    lines = T.lines_from_tpch(T.load_tables(spark, SF))
    assert dict(lines.dtypes)["l_extendedprice"] == dict(lines.dtypes)["p_retailprice"] == "decimal(18,2)"
    for status, kept, left in (("O", ("o_orderstatus", "p_retailprice"), ("o_orderpriority", "c_mktsegment", "p_type")),
                               ("F", ("o_orderpriority", "c_mktsegment", "p_type"), ("o_orderstatus", "p_retailprice"))):
        of = lines.where(f"l_linestatus = '{status}'")
        assert of.count() == of.dropna(subset=list(kept)).count() > 0
        assert of.dropna(how="all", subset=list(left)).isEmpty()
    path = store.materialize(spark, SF, "2001-11-05").removeprefix("file:")
    for table in store.TABLES:
        files = glob.glob(f"{path}/{table}/**/*.parquet", recursive=True)
        assert {pq.read_metadata(f).row_group(0).column(0).compression for f in files if pq.read_metadata(f).num_row_groups} == {"ZSTD"}


def test_latest_values_are_sent_once(spark):
    """The buffer of a latest value is its order and the value, not the value twice."""
    from tidewater.functions import exprs as X
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 1, "y"), ("b", 1, None), ("c", None, "z")], "k string, o int, v string")
    out = df.groupBy("k").agg(X.latest_non_null("v", "o").alias("v"))
    assert {r.k: r.v for r in out.collect()} == {"a": "y", "b": None, "c": "z"}
    assert "max_by" not in plan(out, "simple")
