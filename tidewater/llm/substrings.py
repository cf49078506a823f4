"""Substring deduplication by relative factoring against an index of
reference blocks.

A window is WINDOW consecutive words.  Its anchor is the GRAM-word run with
the smallest hash inside it (the leftmost of equals), so equal windows have
equal anchors at equal places.  The consecutive windows of a document that
share one anchor make a block; blocks are indexed by the hash of the anchor.
A document is factored against all blocks of earlier documents, and its own
earlier ones, that are indexed under its anchors: where a whole block
occurred earlier, all its windows did.  Only blocks that differ under one
anchor, which is where factors begin and end, are checked window by window.
Matches that go on at the next place of the same source make one factor.
The removed words are exact, but this is no greedy Lempel-Ziv parse: each
window points to its first occurrence, so a copy of a passage whose beginning
also stands in an earlier document gives several factors, not the longest.

An anchor, block or window that very many documents share is split: rows are
ranked within salted parts first, and only the first row of each part meets
the others.  Frequent anchors are found in a sample of documents; a frequent
anchor that the sample misses costs time, never a result.

Order: by doc_id (null last), then by hash of the text, then by place.  Rows
are told apart by their id and, where it is missing or repeated, by 64 bits of
their text's hash.
Cases: null or empty text has no words; texts shorter than a window lose
nothing; of rows with one id and text the first stays and the others are
later copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, seen_filter, written
from tidewater.llm.words import FACTOR, WordHash, covered, mixed, windows

WINDOW = 20
GRAM = 8
SALTS = 16
SAMPLE = 64          # one of so many documents is looked at to find frequent anchors
FREQUENT = 16        # of so many sampled rows on, an anchor is split
INVERSE = pow(FACTOR, -1, 1 << 64)

Span = "doc_id long, tk long, start int, n int, ref_doc long, ref_start int"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(FACTOR, 1 << 14), _powers(INVERSE, 1 << 14)


def blocks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, first window and number of windows of each block."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    grams = windows(hashes, GRAM)
    at = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    count = np.diff(np.append(first, n))
    size = len(hashes)
    up, down = (_UP, _DOWN) if size <= len(_UP) else (_powers(FACTOR, size), _powers(INVERSE, size))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:size])])
    content = mixed((sums[first + count + WINDOW - 1] - sums[first]) * down[first] + count.astype(np.uint64))
    return grams[at[first]].view(np.int64), content.view(np.int64), first, count


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, text): tk tells rows of one id apart and orders them.  It
    is the hash of the text where the id is missing or may be repeated, else
    0, so that it takes no room where ids are unique."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1")
    again = seen_filter(repeated.select(F.xxhash64("doc_id")), "repeated")
    tk = F.when(F.col("doc_id").isNull() | again(F.xxhash64("doc_id")), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", tk.alias("tk"), "text")


def _index(docs: DataFrame) -> DataFrame:
    """One row per block: doc_id, tk, h (anchor), c (content), start, n."""
    def make():
        words = WordHash()

        def run(rows: dict) -> dict:
            found = [blocks(words.of((t or "").encode().split())) for t in rows["text"]]
            each = [len(x[0]) for x in found]
            ids = np.array([x if x is not None else 0 for x in rows["doc_id"]], np.int64)
            gone = np.repeat([x is None for x in rows["doc_id"]], each) if each else np.empty(0, bool)
            cat = [np.concatenate([x[k] for x in found]) if found else np.empty(0, np.int64) for k in range(4)]
            return {"doc_id": pa.array(np.repeat(ids, each), mask=gone.astype(bool)), "tk": np.repeat(np.array(rows["tk"], np.int64), each),
                    "h": cat[0], "c": cat[1], "start": cat[2].astype(np.int32), "n": cat[3].astype(np.int32)}
        return run

    return map_batches(docs.select("doc_id", "tk", "text"), make, "doc_id long, tk long, h long, c long, start int, n int")


def _frequent(docs: DataFrame) -> DataFrame:
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(SAMPLE)), F.lit(SAMPLE)) == 0)
    return written(_index(some).groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= FREQUENT).select("h", F.lit(SALTS).alias("salts")), "anchors")


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_last(), F.col("tk"), F.col("start")]


def _ranked(rows: DataFrame, *key: str) -> DataFrame:
    """Rows with ``ref``: the first row of their key (struct doc_id, tk, start)."""
    w = Window.partitionBy(*key).orderBy(*_order())
    return rows.withColumn("ref", F.first(F.struct("doc_id", "tk", "start")).over(w))


def _is_ref() -> Column:
    return (F.col("ref.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("ref.tk") == F.col("tk")) & (F.col("ref.start") == F.col("start"))


def _as_spans(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "tk", "start", "n", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start"))


def _windows_of(lists: DataFrame) -> DataFrame:
    """The windows of the given blocks (``todo``: anchor, first, number) of each text."""
    def make():
        words = WordHash()

        def run(rows: dict) -> dict:
            out: dict = {k: [] for k in ("doc_id", "tk", "h", "w", "start", "n")}
            for doc, tk, text, todo in zip(rows["doc_id"], rows["tk"], rows["text"], rows["todo"]):
                keys = windows(words.of((text or "").encode().split()), WINDOW).view(np.int64)
                for x in todo:
                    a, n = x["start"], x["n"]
                    out["doc_id"] += [doc] * n
                    out["tk"] += [tk] * n
                    out["h"] += [x["h"]] * n
                    out["w"] += keys[a:a + n].tolist()
                    out["start"] += range(a, a + n)
                    out["n"] += [1] * n
            return out
        return run

    return map_batches(lists.select("doc_id", "tk", "text", "todo"), make, "doc_id long, tk long, h long, w long, start int, n int")


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """Of ``identified`` documents: windows whose words occur earlier, as runs of ``n`` windows from word
    ``start`` with the place they were found at (ref_doc, ref_start)."""
    frequent = _frequent(docs)
    index = (_index(docs).join(frequent, "h", "left")
             .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "tk"), F.col("salts")), F.lit(-1)).cast("int")).drop("salts"))
    # One sort per (anchor, part): by content, then by order.
    by = Window.partitionBy("h", "salt").orderBy("c", *_order())
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = (index.withColumn("k", F.count("*").over(whole)).withColumn("same", F.min("c").over(whole) == F.max("c").over(whole))
           .withColumn("new", ~F.coalesce(F.lag("c").over(by) == F.col("c"), F.lit(False)))
           .withColumn("ref", F.last(F.when(F.col("new"), F.struct("doc_id", "tk", "start")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
           .where("salt >= 0 OR k > 1"))
    met = written(met.withColumn("dup", ~_is_ref()).where("dup OR salt >= 0 OR NOT same"), "blocks")
    spans = _as_spans(met.where("dup"))
    # First rows of each part; for anchors that were not split these are the first of all.
    firsts = _ranked(met.where("NOT dup").drop("ref", "dup"), "h", "c").withColumn("dup", ~_is_ref())
    firsts = written(firsts, "firsts")
    spans = spans.unionByName(_as_spans(firsts.where("dup")))
    todo = (firsts.where("NOT dup").groupBy("doc_id", "tk").agg(F.collect_set(F.struct("h", "start", "n")).alias("todo"))
            .withColumnRenamed("doc_id", "id").withColumnRenamed("tk", "key"))
    texts = docs.select("doc_id", "tk", "text")
    edge = _windows_of(texts.join(todo, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("key"))))
    edge = edge.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(SALTS)).cast("int"))
    edge = written(_ranked(edge, "h", "w", "salt").withColumn("dup", ~_is_ref()), "edges")
    last = _ranked(edge.where("NOT dup").drop("ref"), "h", "w").where(~_is_ref())
    return spans.unionByName(_as_spans(edge.where("dup"))).unionByName(_as_spans(last))


def factors(spans: list[dict]) -> list[tuple[int, int, int | None, int]]:
    """Greedy factors (start, words, ref_doc, ref_start) from a document's
    spans: a span that goes on at the next place of the same source joins
    the factor before it."""
    out: list[list] = []
    for s in sorted(spans, key=lambda x: x["start"]):
        if out and out[-1][2] == s["ref_doc"] and s["start"] - out[-1][0] == s["ref_start"] - out[-1][3] and s["start"] <= out[-1][0] + out[-1][1] - WINDOW + 1:
            out[-1][1] = max(out[-1][1], s["start"] - out[-1][0] + s["n"] + WINDOW - 1)
        else:
            out.append([s["start"], s["n"] + WINDOW - 1, s["ref_doc"], s["ref_start"]])
    return [tuple(x) for x in out]


def deduplicated(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors (start, words,
    ref_doc, ref_start), and the kept words as ``text`` if asked for."""
    docs = identified(docs)
    marks = (duplicate_spans(docs).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start")).alias("spans"))
             .withColumnRenamed("doc_id", "id").withColumnRenamed("tk", "key"))
    marks = written(marks, "marks")
    rows = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tk") == F.col("key")), "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "tk").orderBy(F.lit(0))))

    def make():
        def run(batch: dict) -> dict:
            out: dict = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_sha256", "factors", "text")}
            for doc, text, spans, copy in zip(batch["doc_id"], batch["text"], batch["spans"], batch["copy"]):
                words = (text or "").encode().split()
                found = factors(spans or [])
                if copy > 1 and len(words) >= WINDOW:
                    found = [(0, len(words), doc, 0)]
                kept = words
                if found:
                    starts, sizes = np.array([x[0] for x in found]), np.array([x[1] for x in found])
                    gone = covered(starts, sizes, len(words))
                    kept = [words[i] for i in np.flatnonzero(~gone)]
                joined = b" ".join(kept)
                out["doc_id"].append(doc)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["factors"].append([dict(zip(("start", "words", "ref_doc", "ref_start"), (int(x[0]), int(x[1]), x[2], int(x[3])))) for x in found])
                out["text"].append(joined.decode() if with_text else None)
            return out if with_text else {k: v for k, v in out.items() if k != "text"}
        return run

    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<struct<start:int,words:int,ref_doc:long,ref_start:int>>"
    return map_batches(rows.select("doc_id", "text", "spans", "copy"), make, ddl + ", text string" * with_text)
