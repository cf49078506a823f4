"""Token ids as Parquet list columns, read back whole or in parts.

A token folder holds ``ids/`` (one row per document: doc_id, part, start,
n_tokens, ids) and ``parts/`` (one row per file: part, base, documents,
tokens, first and last doc_id).  Documents lie in ascending doc_id order
over the files and inside each.  ``start`` counts the ids before a document
in its file, ``base`` those before the file, so one pass writes the ids and
the global position is their sum.

Encoding: ids go by a dictionary of the row group's tokens (16 bits or less
an id); doc_id, start and n_tokens, which ascend or are small, go by
differences (DELTA_BINARY_PACKED).  Row groups end at ROW_GROUP_BYTES, pages
at PAGE_BYTES or PAGE_ROWS, and every column has a page index: a filter on
doc_id reads only the pages that may hold it, and a reader of the metadata
columns never touches the ids.

Cases: null or empty text is the end id alone; a null doc_id comes first;
rows with one doc_id lie side by side, ordered by a hash of the text
(equal rows are all written); no rows give no rows.  Texts that hold a
special token's string get its id, as the tokenizer library gives it.
Extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.llm.common import bounded, schema_of, shuffle_parts
from tidewater.session import checkpoint_dir

TOKENIZER = "word_bpe_49k.json"     # lower case, white space dropped
END_ID = 2
CACHE_CHUNKS, CACHE_PARTS = 300_000, 800_000
CACHE_BYTES = 64                    # longer chunks are encoded each time

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000

# Letters of one code point each in either case; without those that lower-casing changes otherwise.
LATIN = "À-ÖØ-öø-įı-ňŊ-ž"

BIG_ENDIAN = sys.byteorder == "big" or array("I").itemsize != 4

ROWS = "doc_id long, part int, start long, n_tokens long, ids array<int>"


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if BIG_ENDIAN else array("I", ids).tobytes()


class Parts(dict):
    """Packed ids of the pieces that the tokenizer cuts a chunk into, by the
    library's model; emptied when full."""

    def __init__(self, model):
        from tokenizers.pre_tokenizers import ByteLevel
        self.model = model
        self.shown = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_PARTS:
            self.clear()
        # The model takes bytes as characters; printable ASCII stands for itself.
        bytewise = part if part.isascii() else self.shown.pre_tokenize_str(part)[0][0]
        found = self[part] = packed([x.id for x in self.model.tokenize(bytewise)])
        return found


class Chunks(dict):
    """Packed ids of chunks between white space; emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.encode(chunk)
        if len(chunk) <= CACHE_BYTES:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = found
        return found


class Encoder:
    """Text to packed little-endian ids, equal to the tokenizer library's
    ``encode(text, add_special_tokens=False)``.

    This tokenizer drops white space, and no token crosses it, so the text's
    ids are those of its chunks; chunks met before are kept.  A new chunk of
    printable ASCII and LATIN letters, which normalisation leaves as they
    are, is lower-cased and cut by the tokenizer's own pattern, and each
    piece goes to the library's model; any other goes to the library whole.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.known = Chunks(self._encoded)
        self.parts = Parts(self.library.model)
        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in made["normalizer"]["normalizers"]]
        cut, shown = made["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or (cut["type"], shown["type"], shown["use_regex"]) != ("Split", "ByteLevel", False):
            raise ValueError(f"{tokenizer}: not a tokenizer of lower-case words")
        # Among these characters the classes of letters and digits are these.
        self.pieces = re.compile(cut["pattern"]["Regex"].replace(r"\p{L}", "a-z" + LATIN).replace(r"\p{N}", "0-9")).findall
        self.plain = re.compile(f"[!-~{LATIN}]*").fullmatch
        self.special = re.compile("|".join(re.escape(x["content"]) for x in made["added_tokens"])).search

    def _encoded(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not self.plain(text):
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        if text.isalpha():
            return self.parts[text.lower()]
        if self.special(text):
            return packed(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.parts.__getitem__, self.pieces(text.lower())))

    def __call__(self, text: bytes | None) -> bytes:
        return b"".join(map(self.known.__getitem__, text.split())) if text else b""       # at ASCII white space


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    return Encoder(tokenizer)


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) by ascending doc_id over and inside the partitions.
    Rows that share an id are told apart by their text, then by position, so
    that a frequent id is dealt over several partitions."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h").asc(), F.col("_at").asc()]
    return (rows.withColumns({"_h": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
            .repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
            .select("doc_id", "text"))


def tokenized(docs: DataFrame, *, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The rows of the files, one per document, in order."""
    schema = schema_of(ROWS)
    arrow = to_arrow_schema(schema)
    end = struct.pack("<I", end_id)

    def run(batches):
        encode, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in bounded(whole):
                ids = [encode(t) + end for t in batch.column("text").cast(pa.binary()).to_pylist()]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                edges = np.concatenate([[0], np.cumsum(n)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(at + edges[:-1]), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), values, type=arrow.field("ids").type)], schema=arrow)
                at += int(edges[-1])

    return in_order(docs).mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/llm/tokens-{uuid.uuid4().hex}"


def write(docs: DataFrame, folder: str, *, tokenizer: str = TOKENIZER, end_id: int = END_ID, codec: str = "zstd",
          row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> str:
    """Encode ``docs`` (doc_id, text) into a new token folder; returns it.
    Tasks that fail are run again; a file shows up when its task commits."""
    spark = docs.sparkSession
    (tokenized(docs, tokenizer=tokenizer, end_id=end_id).write
     .option("compression", codec)
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.block.size", row_group_bytes)
     .option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", page_rows)
     .option("parquet.enable.dictionary", "true")
     .options(**{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "start", "n_tokens")})
     .parquet(f"{folder}/ids"))
    # One row per file: a proven bound for the window and for the broadcasts below.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = spark.read.schema(ROWS).parquet(f"{folder}/ids").groupBy("part").agg(
        F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    (each.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), "documents", "tokens", "first_doc", "last_doc")
     .coalesce(1).write.parquet(f"{folder}/parts"))
    return folder


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, base long, documents long, tokens long, first_doc long, last_doc long").parquet(f"{folder}/parts")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids), start counted over the whole folder.
    Only the selected columns are read; filters on doc_id skip pages."""
    rows = spark.read.schema(ROWS).parquet(f"{folder}/ids")
    base = parts(spark, folder).select("part", "base")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """The ids first <= position < last of the whole folder: (doc_id, start,
    n_tokens, ids) of the documents they lie in, cut at both ends."""
    inside = (F.col("base") < last) & (F.col("base") + F.col("tokens") > first)
    # At most two rows reach the driver: the first and the last file of the span.
    ends = parts(spark, folder).where(inside).agg(F.min("part"), F.max("part")).first()
    rows = read(spark, folder).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    if ends[0] is not None:
        only = spark.read.schema(ROWS).parquet(f"{folder}/ids").where(F.col("part").between(ends[0], ends[1]))
        base = parts(spark, folder).where(inside).select("part", "base")
        rows = only.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("start")).where(
            (F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    upto = F.least(F.lit(last) - F.col("start"), F.col("n_tokens"))
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), (upto - skip).alias("n_tokens"),
                       F.slice("ids", (skip + 1).cast("int"), (upto - skip).cast("int")).alias("ids"))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as ``read`` returns them;
    the count and the checksum come from the ids themselves."""
    schema = schema_of("doc_id long, start long, n_tokens long, ids_crc32 long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            edges = np.asarray(ids.offsets).tolist()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
            sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(edges).astype(np.int64)),
                                              pa.array(sums, pa.int64())], schema=arrow)

    return rows.select("doc_id", "start", "ids").mapInArrow(run, schema)
