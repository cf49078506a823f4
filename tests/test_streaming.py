"""Streaming jobs equal their batch twins; late rows are dropped; a replay
from the checkpoint adds nothing."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from conftest import ts
from tidewater.streaming import jobs as ST

EVENTS = "/root/testdata/sf0.001/events.parquet"


def _stream_dir(spark, tmp, df, name="events"):
    path = os.path.join(tmp, name)
    df.write.parquet(path)
    return path


def test_stream_equals_batch_twin_complete_mode(spark, tmp):  # ST2
    ev = spark.read.parquet(EVENTS)
    src = _stream_dir(spark, tmp, ev.repartition(4))
    q = (ST.streaming_alerts(ST.read_event_stream(spark, src, max_files_per_trigger=1),
                             size="15 minutes", slide="5 minutes", threshold=0)
         .writeStream.format("memory").queryName("alerts15").outputMode("complete")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(spark.table("alerts15").collect())
    want = sorted(ST.alert_windows(ev, size="15 minutes", slide="5 minutes", threshold=0).collect())
    assert got == want and len(got) > 0


def test_append_mode_emits_closed_windows_and_replay_adds_nothing(spark, tmp):  # ST1
    ev = spark.read.parquet(EVENTS)
    src = _stream_dir(spark, tmp, ev)
    out, ck = os.path.join(tmp, "out"), os.path.join(tmp, "ck")
    stream = ST.streaming_alerts(ST.read_event_stream(spark, src), size="15 minutes",
                                 slide="5 minutes", threshold=0)
    ST.run_to_table(stream, out, ck).awaitTermination()
    first = spark.read.parquet(out).count()
    batch = ST.alert_windows(ev, size="15 minutes", slide="5 minutes", threshold=0)
    closed = batch.where(F.col("window_end") <= F.lit(
        ev.where("event_type = 'error'").agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10))
        .cast("timestamp_ntz"))
    assert closed.count() <= first < batch.count()
    ST.run_to_table(ST.streaming_alerts(ST.read_event_stream(spark, src), size="15 minutes",
                                        slide="5 minutes", threshold=0), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == first


def test_late_event_dropped(spark, tmp):  # ST1 late data
    schema = ST.EVENT_SCHEMA
    src = os.path.join(tmp, "ev")
    first = spark.createDataFrame([(1, ts("2024-01-01 01:00:00"), 1, "error", 1.0, "{}")], schema)
    first.write.parquet(os.path.join(src, "a"))
    q = (ST.streaming_alerts(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src),
                             size="5 minutes", slide="5 minutes", threshold=0, watermark="1 minute")
         .writeStream.format("memory").queryName("late").outputMode("append").start())
    q.processAllAvailable()
    late = spark.createDataFrame([(2, ts("2024-01-01 00:10:00"), 1, "error", 1.0, "{}")], schema)
    late.write.parquet(os.path.join(src, "b"))
    q.processAllAvailable()
    push = spark.createDataFrame([(3, ts("2024-01-01 02:00:00"), 1, "error", 1.0, "{}")], schema)
    push.write.parquet(os.path.join(src, "c"))
    q.processAllAvailable()
    q.stop()
    starts = [r.window_start for r in spark.table("late").collect()]
    assert ts("2024-01-01 01:00:00") in starts
    assert ts("2024-01-01 00:10:00") not in starts


def test_hourly_stream_matches_batch(spark, tmp):  # ST3
    ev = spark.read.parquet(EVENTS)
    src = _stream_dir(spark, tmp, ev)
    q = (ST.streaming_hourly(ST.read_event_stream(spark, src)).writeStream.format("memory")
         .queryName("hourly").outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(spark.table("hourly").collect()) == sorted(ST.hourly_events(ev).collect())


def test_csv_ingest_stream(spark, tmp):  # ST5 + S1/K2
    src = os.path.join(tmp, "csv")
    os.makedirs(os.path.join(src, "day1"))
    with open(os.path.join(src, "day1", "ecc.csv"), "w") as f:
        f.write("CustomerID,OrderNumber,OrderDate,ProductCode,Quantity,UnitPrice,TotalAmount,Status\n")
        f.write("C1,O1,2001-01-01 00:00:00,P1,2,10.00,20.00,O\n")
        f.write("C2,O2,2001-01-02 00:00:00,P2,x,10.00,20.00,O\n")
    dest, ck = os.path.join(tmp, "raw"), os.path.join(tmp, "ck")
    ST.ingest_csv(spark, src, dest, ck, "ecc", as_of="2001-01-03").awaitTermination()
    rows = {r.customer_id: r for r in spark.read.parquet(dest).collect()}
    assert rows["C1"].quantity == 2 and rows["C1"].data_source == "SAP_ECC" and rows["C1"].is_active
    assert rows["C2"].quantity is None and rows["C2"].validation_errors == "bad quantity"
    ST.ingest_csv(spark, src, dest, ck, "ecc", as_of="2001-01-03").awaitTermination()
    assert spark.read.parquet(dest).count() == 2


def test_document_refresh_stream(spark, tmp):  # ST4
    from tidewater import schemas as S
    from tidewater.sources import sinks as K
    root, ck, src = os.path.join(tmp, "docs"), os.path.join(tmp, "ck"), os.path.join(tmp, "changes")
    cols = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in S.DOCUMENT.fields
            if f.name not in ("id", "timestamp", "content", "metadata")]

    def changes(rows, sub):
        df = spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, content string, is_deleted boolean")
        df.selectExpr("*", "'' AS metadata", *cols).write.parquet(os.path.join(src, sub))

    changes([("a", ts("2001-01-01"), "A1", False), ("b", ts("2001-01-01"), "B1", False)], "1")
    schema = spark.read.parquet(os.path.join(src, "1")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    ST.refresh_documents(stream, root, ck).awaitTermination()
    changes([("a", ts("2001-01-02"), "A2", False), ("b", ts("2001-01-02"), "B1", True)], "2")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
    ST.refresh_documents(stream, root, ck).awaitTermination()
    got = {r.id: r.content for r in K.read_current(spark, root).collect()}
    assert got == {"a": "A2"}


def test_table_folder_stream(spark, tmp):  # ST1-ST3 on a folder of part files
    ev = spark.read.parquet(EVENTS)
    ev.repartition(5).write.parquet(os.path.join(tmp, "events.parquet"))
    stream = ST.streaming_hourly(ST.read_table_stream(spark, tmp))
    q = stream.writeStream.format("memory").queryName("folder").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("folder").collect()) == sorted(ST.hourly_events(ev).collect()) != []


def test_csv_ingest_by_name(spark, tmp):  # ST5: headers in another order, no as_of
    src = os.path.join(tmp, "csv")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("CustomerID,ProductCode,SalesAmount,SalesQuantity,SalesDate\nC1,P1,10,1,2001-01-01 00:00:00\n")
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write("SalesQuantity,SalesAmount,SalesDate,ProductCode,CustomerID\n2,20,2001-01-02 00:00:00,P2,C2\n")
    ST.ingest_csv(spark, src, f"{tmp}/raw", f"{tmp}/ck", "bw").awaitTermination()
    rows = {r.customer_id: (float(r.sales_amount), float(r.sales_quantity), r.processed_date is not None) for r in spark.read.parquet(f"{tmp}/raw").collect()}
    assert rows == {"C1": (10, 1, True), "C2": (20, 2, True)}


def test_late_change_is_not_applied(spark, tmp):  # ST4
    from tidewater import schemas as S
    from tidewater.sources import sinks as K
    cols = [f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in S.DOCUMENT.fields
            if f.name not in ("id", "timestamp", "content", "metadata")]
    root, src = os.path.join(tmp, "docs"), os.path.join(tmp, "changes")
    for i, rows in enumerate([[("a", ts("2001-01-05"), "new", False), ("b", ts("2001-01-05"), "B", None)],
                              [("a", ts("2001-01-02"), "late", False), ("c", ts("2001-01-02"), "C", False), ("c", ts("2001-01-02"), "C", True)]]):
        df = spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, content string, is_deleted boolean")
        df.selectExpr("*", "'' AS metadata", *cols).write.parquet(os.path.join(src, str(i)))
        stream = spark.readStream.schema(spark.read.parquet(os.path.join(src, "0")).schema).option("recursiveFileLookup", True).parquet(src)
        ST.refresh_documents(stream, root, os.path.join(tmp, "ck")).awaitTermination()
    assert {r.id: r.content for r in K.read_current(spark, root).collect()} == {"a": "new", "b": "B"}


def test_alert_events_over_batches(spark, tmp):  # ST1/ST2 as states
    """Events of a stream in several runs are those of all closed windows at
    once: one fire and one resolve per run of windows."""
    rng = random.Random(5)
    minute = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    # Bursts with quiet times between, some across the borders of the batches.
    times = sorted(m + rng.random() for start in (3, 4, 30, 58, 59, 61, 119, 121, 200, 239, 260) for m in (start, start, start + 1) for _ in range(rng.randrange(1, 3)))
    src, root, ck = os.path.join(tmp, "src"), os.path.join(tmp, "out"), os.path.join(tmp, "ck")
    for i, (a, b) in enumerate([(0, 60), (60, 120), (120, 240), (240, 400)]):
        rows = [(k, minute(t), 1, "error", 1.0, "{}") for k, t in enumerate(times) if a <= t < b] + [(-1, minute(a + 1), 1, "click", 1.0, "{}")]
        rng.shuffle(rows)
        spark.createDataFrame(rows, ST.EVENT_SCHEMA).write.mode("append").parquet(src)
        ST.alert_event_stream(ST.read_event_stream(spark, src), root, ck, threshold=2).awaitTermination()
        if i == 1:      # a run without new files changes nothing
            ST.alert_event_stream(ST.read_event_stream(spark, src), root, ck, threshold=2).awaitTermination()
    got = sorted((r.at, r.kind) for r in ST.read_alert_events(spark, root).collect())
    closed = max(times) - 10
    want, firing, seen = [], False, max(e for e in range(0, 400) if e <= closed and any(e - 5 <= t < e for t in times))
    for end in range(1, seen + 1):
        high = sum(end - 5 <= t < end for t in times) > 2
        if high != firing:
            want.append((minute(end), "fire" if high else "resolve"))
        firing = high
    assert got == want and len(got) > 6
    ev = spark.read.parquet(src)
    batch = ST.alert_events(ST.window_counts(ev, size="5 minutes", slide="1 minute").where(F.col("window_end") <= F.lit(minute(closed))), slide="1 minute", threshold=2)
    assert sorted((r.at, r.kind) for r in batch.collect()) == want


def test_last_day_counts(spark, tmp):  # ST3 with its bound
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=5)
    src, root, ck = os.path.join(tmp, "src"), os.path.join(tmp, "out"), os.path.join(tmp, "ck")
    for hours in (range(0, 20), range(18, 40), range(39, 61)):
        spark.createDataFrame([(h, hour(h), 1, t, 1.0, "{}") for h in hours for t in ("a", "b", "b")], ST.EVENT_SCHEMA).write.mode("append").parquet(src)
        ST.last_day_counts(ST.read_event_stream(spark, src), root, ck, watermark="3 hours").awaitTermination()
    from tidewater.sources import sinks as K
    got = {(r.window_start, r.event_type): r.events for r in K.read_current(spark, root).collect()}
    want = {(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), t): n * (1 + (h == 39)) for h in range(37, 61) for t, n in (("a", 1), ("b", 2))}
    assert got == want
    assert len([d for d in os.listdir(root) if d.startswith("version=")]) == 2


def test_ingest_retry_on_another_day(spark, tmp):  # ST5
    """A batch that is tried again after midnight replaces its rows."""
    src, dest = os.path.join(tmp, "csv"), os.path.join(tmp, "raw")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("CustomerID,ProductCode,SalesAmount,SalesQuantity,SalesDate\nC1,P1,10,1,2001-01-01 00:00:00\n")
    for i, day in enumerate(("2001-01-03", "2001-01-04")):      # the first attempt's checkpoint is lost, its rows are not
        ST.ingest_csv(spark, src, dest, os.path.join(tmp, f"ck{i}"), "bw", as_of=day).awaitTermination()
    rows = spark.read.parquet(dest).collect()
    assert [(r.customer_id, str(r.processed_day)) for r in rows] == [("C1", "2001-01-04")]


def test_alert_events_are_written_by_many_tasks(spark, tmp, monkeypatch):
    """a batch's joins are not merged into the one task that writes."""
    from pyspark.sql import functions as F
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=20 * i), 1, "error" if i % 90 < 30 else "view", 1.0, None) for i in range(900)]
    spark.createDataFrame(rows, ST.EVENT_SCHEMA).write.parquet(f"{tmp}/events.parquet")
    called = []
    real = type(spark.range(1)).coalesce
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda self, n: called.append(n) or real(self, n))
    stream = ST.read_table_stream(spark, tmp)
    ST.alert_event_stream(stream, f"{tmp}/out", f"{tmp}/ck", threshold=2).awaitTermination()
    got = sorted((r["at"], r["kind"]) for r in ST.read_alert_events(spark, f"{tmp}/out").collect())
    events = spark.read.schema(ST.EVENT_SCHEMA).parquet(f"{tmp}/events.parquet").where(F.col("ts") < base + dt.timedelta(hours=4))
    want = sorted((r["at"], r["kind"]) for r in ST.alert_events(ST.window_counts(events, size="5 minutes", slide="1 minute"), slide="1 minute", threshold=2).collect())
    assert not called and len(want) > 4 and set(want) <= set(got)
