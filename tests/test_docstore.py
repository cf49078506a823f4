"""The document store: buckets, deltas, dead letters, failure budget, retention."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewater import schemas as S
from tidewater.sources import docstore as DS
from tidewater.sources import sinks as K
from conftest import ts

CHANGE = "id string, timestamp timestamp_ntz, content string, is_deleted boolean"


def docs(spark, rows):
    cols = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.DOCUMENT.fields if f.name not in ("id", "timestamp", "content", "metadata")]
    return spark.createDataFrame(rows, CHANGE).select("*", F.lit("m").alias("metadata"), *cols)


def contents(df):
    rows = df.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r["content"] for r in rows}


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}


def test_batches_against_a_plain_dict(spark, tmp):
    rng, root, want = random.Random(6), f"{tmp}/d", {}
    K.write_documents(docs(spark, [(f"i{k}", ts("2001-01-01"), f"c{k}", None) for k in range(40)]), root)
    want = {f"i{k}": ("2001-01-01T00:00:00", f"c{k}", False) for k in range(40)}
    for b in range(7):
        rows = [(f"i{rng.randrange(50)}", ts(f"2001-01-0{rng.randrange(1, 9)}"), f"b{b}-{j}", rng.random() < 0.3) for j in range(12)]
        DS.apply(docs(spark, rows), root, str(b), buckets=8, merge_every=3)
        newest: dict = {}
        for i, t, c, gone in rows:
            newest[i] = max(newest.get(i, ()), (t.isoformat(), gone, c))
        for i, (t, gone, c) in newest.items():
            if i not in want or t >= want[i][0]:
                want[i] = (t, c, gone)
        assert contents(DS.read(spark, root)) == contents(K.read_current(spark, root)) == {i: c for i, (_, c, gone) in want.items() if not gone}
    assert DS.apply(docs(spark, [("new", ts("2009-01-01"), "x", None)]), root, "6")["received"] == 0       # applied already
    K.write_documents(docs(spark, [("only", ts("2001-01-01"), "whole", None)]), root)                        # a rebuild replaces all
    assert contents(K.read_current(spark, root)) == {"only": "whole"}
    DS.apply(docs(spark, [("two", ts("2001-01-01"), "2", None)]), root, "7", buckets=8)
    assert contents(K.read_current(spark, root)) == {"only": "whole", "two": "2"}


def test_small_batch_touches_few_files(spark, tmp):
    root = f"{tmp}/d"
    K.write_documents(spark.range(20000).select(F.concat(F.lit("i"), "id").alias("id"), F.lit("t").alias("content"), F.lit("m").alias("metadata"),
                      F.lit("2001-01-01").cast("timestamp_ntz").alias("timestamp"),
                      *[F.lit(None).cast(f.dataType).alias(f.name) for f in S.DOCUMENT.fields if f.name not in ("id", "timestamp", "content", "metadata")]), root)
    DS.create(spark, root)
    before = files(root)
    base = [f for f in before if "/base=" in f]
    assert len(base) == DS.BUCKETS
    change = lambda b: docs(spark, [(f"i{k}", ts("2001-02-01"), f"n{b}", None) for k in range(10)])
    for b in range(DS.MERGE_EVERY):
        got = DS.apply(change(b), root, f"b{b}")
        assert got["touched"] <= 10 and got["rewritten"] == (got["touched"] if b == DS.MERGE_EVERY - 1 else 0)
    after = files(root)
    assert all(after[f] == t for f, t in before.items())                     # nothing is written over
    rewritten = [f for f in after if "/base=" in f and f not in before]
    assert 0 < len(rewritten) <= 10 < 0.05 * len(base)
    assert contents(DS.read(spark, root))["i3"] == f"n{DS.MERGE_EVERY - 1}" and DS.read(spark, root).count() == 20000


def test_dead_letters_and_budget(spark, tmp):
    root = f"{tmp}/d"
    bad = [(None, ts("2001-01-01"), "x", None), (" ", ts("2001-01-01"), "x", None), ("a", None, "x", None), ("b", ts("2001-01-01"), None, None)]
    got = DS.apply(docs(spark, bad + [("ok", ts("2001-01-01"), "fine", None), ("gone", ts("2001-01-01"), None, True)]), root, "1", buckets=4)
    assert got == {"received": 6, "rejected": 4, "touched": got["touched"], "rewritten": 0}
    assert sorted(r["reason"] for r in DS.rejected(spark, root).collect()) == ["missing content", "missing id", "missing id", "missing timestamp"]
    assert contents(DS.read(spark, root)) == {"ok": "fine"}
    with pytest.raises(DS.FailureBudget):                                     # six in one batch
        DS.apply(docs(spark, bad + bad[:2] + [("late", ts("2001-01-01"), "x", None)]), root, "2")
    assert DS.apply(docs(spark, bad[:3]), root, "3")["rejected"] == 3
    with pytest.raises(DS.FailureBudget):                                     # eleven in all
        DS.apply(docs(spark, bad), root, "4")
    assert contents(DS.read(spark, root)) == {"ok": "fine"} and DS.state_of(spark, root)["failed"] == 7
    assert DS.apply(docs(spark, bad[:3] + [("more", ts("2001-01-01"), "x", None)]), root, "5")["rejected"] == 3


def test_retention(spark, tmp):
    root = f"{tmp}/d"
    for b in range(6):
        DS.apply(docs(spark, [("a", ts("2001-01-01"), f"v{b}", None), (f"n{b}", ts("2001-01-01"), "x", None)]), root, f"b{b}", buckets=2, merge_every=2)
    reader = DS.read(spark, root)
    last = DS.state_of(spark, root)
    gone = K.expire_documents(spark, root, keep=1)
    assert gone and not any(os.path.exists(f"{root}/{g}") for g in gone) and [f for f in os.listdir(f"{root}/_state") if f.endswith(".json")] == [f"{last['number']}.json"]
    want = {"a": "v5", **{f"n{b}": "x" for b in range(6)}}
    assert contents(reader) == contents(DS.read(spark, root)) == want        # the reader was opened before
    DS.apply(docs(spark, [("a", ts("2001-01-02"), "v6", None)]), root, "b6", buckets=2)
    assert contents(K.read_current(spark, root)) == want | {"a": "v6"}
    for k in range(4):
        K.publish(spark.range(k), f"{tmp}/t")
    held = K.read_current(spark, f"{tmp}/t")
    assert K.expire_versions(spark, f"{tmp}/t", keep=2) == ["version=1", "version=2"] and held.count() == 3
    assert K.publish(spark.range(9), f"{tmp}/t") == 5


def test_expired_loads(spark, tmp):
    from tidewater.operators import rollups as R
    from conftest import bw_rows, ecc_rows
    for day in (3, 4, 5):
        ecc = ecc_rows(spark, [dict(customer_id=f"C{day}", processed_date=ts(f"2001-01-0{day}"))])
        bw = bw_rows(spark, [dict(customer_id="C9", processed_date=ts(f"2001-01-0{day}"))])
        at = f"2001-01-0{day}"
        K.save_processed(R.build_customers(ecc, bw, as_of=at), R.build_products(ecc, bw, as_of=at), R.unify_sales(ecc, bw, as_of=at), f"{tmp}/p", as_of=at, start=None)
    sales, customers, _ = K.read_processed(spark, f"{tmp}/p")
    assert K.expire_processed(spark, f"{tmp}/p", keep=1) == ["load=1", "load=2", "version=1", "version=2", "version=1", "version=2"]
    assert sales.count() == 2 and customers.count() == 4 and K.read_processed(spark, f"{tmp}/p")[0].count() == 2


def test_reruns_replace_their_rows(spark, tmp):  # K1, K7
    from conftest import ecc_rows
    for _ in range(2):
        K.land_raw(ecc_rows(spark, [{}, {}]), f"{tmp}/raw", load="export 1")
        K.save_insights(spark.range(3), f"{tmp}/i", run="2001-01-01 03:00:00")
    K.land_raw(ecc_rows(spark, [{}]), f"{tmp}/raw", load="export 2")
    K.save_insights(spark.range(1), f"{tmp}/i", run="2001-01-02 03:00:00")
    assert spark.read.parquet(f"{tmp}/raw").count() == 3 and spark.read.parquet(f"{tmp}/i").count() == 4
