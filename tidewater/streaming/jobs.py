"""Structured Streaming jobs: sliding-window alerts over the event stream,
hourly event counts, incremental CSV ingest and incremental document
refresh.  Every job has a batch twin (same windows, same counts) used for
testing and back-fills.

Event timestamps are wall-clock (timestamp_ntz); watermarks need a
``timestamp``, so streams cast ``ts`` under the session's UTC zone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import exprs as X
from tidewater.sources import docstore, sinks
from tidewater.sources.tables import conform_raw, csv_files, csv_header, read_raw_csv

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# Alert rules: (window, slide, threshold); an alert fires when the count of
# matching events in a window is strictly greater than the threshold.
ERROR_RULE = ("5 minutes", "1 minute", 5)
FAILURE_RULE = ("15 minutes", "5 minutes", 1)


def _windowed_counts(events: DataFrame, size: str, slide: str | None, *, by=()) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("events"))


def _flatten(df: DataFrame, *by) -> DataFrame:
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("w.end").cast("timestamp_ntz").alias("window_end"), *by, "events")


# ------------------------------------------------------------- batch twins

def alert_windows(events: DataFrame, *, event_type: str = "error", size: str, slide: str,
                  threshold: int) -> DataFrame:
    """ST1/ST2 batch twin: sliding windows whose count of ``event_type``
    events exceeds ``threshold``.  Each event falls into size/slide windows
    (an Expand of fixed width before the partial aggregation)."""
    e = events.where(F.col("event_type") == event_type).select("ts")
    return _flatten(_windowed_counts(e, size, slide)).where(F.col("events") > threshold)


def error_alerts(events: DataFrame, *, threshold: int = ERROR_RULE[2]) -> DataFrame:
    return alert_windows(events, size=ERROR_RULE[0], slide=ERROR_RULE[1], threshold=threshold)


def failure_alerts(events: DataFrame, *, threshold: int = FAILURE_RULE[2]) -> DataFrame:
    return alert_windows(events, size=FAILURE_RULE[0], slide=FAILURE_RULE[1], threshold=threshold)


def hourly_events(events: DataFrame) -> DataFrame:
    """ST3 batch twin: tumbling one-hour counts per event type."""
    return _flatten(_windowed_counts(events.select("ts", "event_type"), "1 hour", None,
                                     by=("event_type",)), "event_type")


# ------------------------------------------------------------ alert states

def window_counts(events: DataFrame, *, event_type: str = "error", size: str, slide: str) -> DataFrame:
    """All sliding windows that hold an event of the type, with their counts."""
    return _flatten(_windowed_counts(events.where(F.col("event_type") == event_type).select("ts"), size, slide))


def alert_events(windows: DataFrame, *, slide: str, threshold: int, opened=None, seen=None) -> DataFrame:
    """(kind, at): ``fire`` at the end of the first window above the
    threshold, ``resolve`` at the end of the first one after it that is not.
    A run of windows above it gives one event of each kind, and no resolve
    before a later window is seen.  ``opened`` is the end of the last window
    of a run that goes on from before, ``seen`` the latest window end known
    from before.

    Windows meet their neighbours by an equi-join on the window end."""
    spark = windows.sparkSession
    step = F.expr(f"INTERVAL {slide}")
    high = windows.where(F.col("events") > threshold).select("window_end", F.lit(False).alias("before"))
    if opened is not None:
        high = high.unionByName(spark.range(1).select(X.ts_lit(opened).alias("window_end"), F.lit(True).alias("before")))
    ends = high.select(F.col("window_end").alias("own"))
    fires = high.where("NOT before").join(ends, F.col("window_end") == F.col("own") + step, "left_anti")
    known = windows.agg(F.max("window_end")).scalar()
    if seen is not None:
        known = F.greatest(known, X.ts_lit(seen))
    resolves = high.join(ends, F.col("window_end") + step == F.col("own"), "left_anti").select((F.col("window_end") + step).alias("at")).where(F.col("at") <= known)
    return fires.select(F.lit("fire").alias("kind"), F.col("window_end").alias("at")).unionByName(resolves.select(F.lit("resolve").alias("kind"), "at"))


# --------------------------------------------------------------- streaming

def read_event_stream(spark: SparkSession, path: str, *, fmt: str = "parquet",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def read_table_stream(spark: SparkSession, folder: str, table: str = "events", *,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table of ``folder`` (``<table>.parquet`` file or folder) as
    a file stream: files are picked up once, in arrival order."""
    path = f"{folder.rstrip('/')}/{table}.parquet"
    fs, p, _ = sinks._fs(spark, path)
    r = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if fs.getFileStatus(p).isDirectory():       # a folder of part files
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def streaming_alerts(stream: DataFrame, *, event_type: str = "error", size: str = ERROR_RULE[0],
                     slide: str = ERROR_RULE[1], threshold: int = ERROR_RULE[2],
                     watermark: str = "10 minutes") -> DataFrame:
    """ST1/ST2: the alert rule on a stream.  Rows older than the watermark
    are dropped; in append mode a window is emitted once it closes."""
    e = (stream.where(F.col("event_type") == event_type)
               .select(F.col("ts").cast("timestamp").alias("ts"))
               .withWatermark("ts", watermark))
    return _flatten(_windowed_counts(e, size, slide)).where(F.col("events") > threshold)


def streaming_hourly(stream: DataFrame, *, watermark: str = "10 minutes") -> DataFrame:
    """ST3 on a stream."""
    e = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type") \
              .withWatermark("ts", watermark)
    return _flatten(_windowed_counts(e, "1 hour", None, by=("event_type",)), "event_type")


def last_day_counts(stream: DataFrame, root: str, checkpoint: str, *, hours: int = 24, watermark: str = "10 minutes"):
    """ST3 with its bound: a published table of the hourly counts per event
    type of the last ``hours`` hours.  The windows' state ends with the
    watermark, older rows leave the table, and the versions before the last
    two are deleted, so nothing grows with the stream.  A count only grows,
    so a batch that is tried again changes nothing."""
    e = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", watermark)
    counts = _flatten(_windowed_counts(e, "1 hour", None, by=("event_type",)), "event_type")

    def publish(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        held = sinks.read_current(spark, root)
        rows = batch if held is None else batch.unionByName(held.select(*batch.columns))
        rows = rows.groupBy("window_start", "window_end", "event_type").agg(F.max("events").alias("events"))
        newest = rows.agg(F.max("window_start")).scalar()
        sinks.publish(rows.where(F.col("window_start") > newest - F.expr(f"INTERVAL {hours} HOURS")), root)
        sinks.expire_versions(spark, root, keep=2)

    return counts.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_event_stream(stream: DataFrame, root: str, checkpoint: str, *, event_type: str = "error", size: str = ERROR_RULE[0],
                       slide: str = ERROR_RULE[1], threshold: int = ERROR_RULE[2], watermark: str = "10 minutes"):
    """ST1/ST2 as alert states: the events of :func:`alert_events` from the
    windows closed by the watermark, late rows within it included.  A state
    file holds the open run and the latest window end; a batch writes its
    own folder of events, so a batch that is tried again replaces them."""
    e = stream.where(F.col("event_type") == event_type).select(F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    windows = _flatten(_windowed_counts(e, size, slide))

    def step(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        state = sinks.read_state(spark, root) or {"opened": None, "seen": None, "epoch": -1}
        if state["epoch"] >= epoch_id:
            return
        rows = batch.groupBy("window_start", "window_end").agg(F.max("events").alias("events"))
        events = alert_events(rows, slide=slide, threshold=threshold, opened=state["opened"], seen=state["seen"])
        events.write.mode("overwrite").parquet(f"{root}/events/batch={epoch_id}")
        last = rows.agg(F.max("window_end").cast("string").alias("seen"),
                        F.max(F.when(F.col("events") > threshold, F.col("window_end"))).cast("string").alias("high")).first()
        done = read_alert_events(spark, root).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
        n = {r["kind"]: r["n"] for r in done}
        goes_on = n.get("fire", 0) > n.get("resolve", 0)
        sinks.write_state(spark, root, {"opened": (last["high"] or state["opened"]) if goes_on else None, "seen": last["seen"] or state["seen"], "epoch": epoch_id})

    return windows.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_alert_events(spark: SparkSession, root: str) -> DataFrame:
    """All events written so far."""
    return spark.read.schema("kind string, at timestamp_ntz, batch int").parquet(f"{root}/events").select("kind", "at")


def run_to_table(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append",
                 fmt: str = "parquet", available_now: bool = True):
    """Start a streaming query that writes ``df`` to files.  With
    ``available_now`` it processes what is there and stops; the checkpoint
    makes a re-run pick up only new input (exactly-once file sink)."""
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(path)


# ---------------------------------------------------------------- ingest

def csv_ingest_stream(spark: SparkSession, path: str, kind: str, *, columns=None, rename=None,
                      as_of=None) -> DataFrame:
    """ST5: new CSV export files as a stream, typed into the raw schema.

    A file stream needs its schema up front and reads columns by position:
    ``columns`` is the header that all files share; when omitted it is taken
    from the files already present, which must agree.  For files with
    differing headers use :func:`ingest_csv`."""
    if columns is None:
        headers = {csv_header(spark, f) for f in csv_files(spark, path)}
        if len(headers) != 1:
            raise ValueError(f"{len(headers)} different headers under {path}")
        columns = headers.pop()
    text = ", ".join(f"`{c}` string" for c in columns)
    raw = (spark.readStream.option("header", True).option("pathGlobFilter", "*.csv")
           .option("recursiveFileLookup", True).schema(text).csv(path))
    return conform_raw(raw, kind, rename=rename, as_of=as_of)


def ingest_csv(spark: SparkSession, src: str, dest: str, checkpoint: str, kind: str, *, rename=None, as_of=None,
               max_files_per_trigger: int = 1000):
    """ST5 + K1/K2: land new export files as raw parquet, partitioned by
    processing day.  The stream follows the files, not their rows; each
    micro-batch reads its new files by the names in their headers.  A batch
    has a directory of its own and replaces it when it is tried again, on
    whatever day, so each file lands once.  Returns the started query
    (availableNow)."""
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
             .option("maxFilesPerTrigger", max_files_per_trigger)
             .schema("path string, modificationTime timestamp, length long, content binary").load(src).select("path"))

    def land(batch: DataFrame, batch_id: int) -> None:
        names = [r["path"] for r in batch.collect()]        # at most max_files_per_trigger
        if names:
            (read_raw_csv(batch.sparkSession, names, kind, rename=rename, as_of=as_of)
             .withColumn("processed_day", F.to_date("processed_date"))
             .hint("rebalance", "processed_day").write.mode("overwrite").option("partitionOverwriteMode", "static")
             .partitionBy("processed_day").parquet(f"{dest}/batch={batch_id}"))

    return files.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------ document refresh

def refresh_documents(changes: DataFrame, doc_root: str, checkpoint: str, **params):
    """ST4: apply a stream of changed documents to the document set, batch
    by batch (``sources.docstore.apply``, which takes ``params``): a batch
    writes the buckets its ids fall in, invalid changes go to the dead
    letters, and too many of them stop the stream.  Readers
    (``sinks.read_current``) see a batch whole or not at all."""

    def apply(batch: DataFrame, epoch_id: int) -> None:
        docstore.apply(batch, doc_root, f"{stream}-{epoch_id}", **params)

    # Batches are named by the stream's checkpoint, so a restarted stream repeats its own names only.
    stream = hashlib.sha1(checkpoint.encode()).hexdigest()[:8]
    return (changes.writeStream.foreachBatch(apply)
                   .option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start())
