"""Quality rules: base counts per document, then cross-document line
frequency.

Lines are normalised (ASCII lower case, numbers to 0, single spaces) and
hashed.  For every host (``source``) the documents with a line are counted,
copies of one text once.  Lines in more than ``max_share`` of a host's
documents, and in ``min_docs`` at least, are removed; a document is rejected
when fewer than ``min_words`` words, or less than ``min_left`` of its words,
are left.

Only exact copies count once.  Near copies count each: a group of them above
both limits makes its shared lines frequent, and its members, left with too
few words, are all rejected before any near-duplicate stage could keep one.

Cases: null or empty text has no words and fails the base rules; a null
source is a host of its own; repeated rows each get a row and count once;
an empty table gives no rows.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import LOWER, UPPER, map_batches, written
from tidewater.llm.words import SPACE, WordHash, repeated_mask

SYMBOLS = b"#*$%&|<>"
NORMAL = bytes.maketrans((UPPER + "123456789").encode(), (LOWER + "0" * 9).encode())
NUMBER = re.compile(rb"0{2,}")
WINDOW = 5


def _hash(line: bytes) -> int:
    """Signed 64-bit hash of a line as normalised."""
    h = xxhash.xxh64_intdigest(NUMBER.sub(b"0", b" ".join(line.split())))
    return h - (1 << 64) if h >> 63 else h


def base_counts(text: str, words: WordHash) -> dict:
    raw = text.encode()
    own = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    freq: dict[int, int] = {}
    for x in raw.translate(NORMAL).split(b"\n"):
        if n := len(x.split()):
            h = _hash(x)
            freq[h] = freq.get(h, 0) + n
    return {"n_words": len(own),
            "word_chars": len(text) - (len(raw) - len(raw.translate(None, SPACE))),
            "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": int(repeated_mask(words.of(own), WINDOW).sum()),
            "lines": [{"h": h, "w": n} for h, n in freq.items()]}


def text_key() -> Column:
    return F.xxhash64("text")


def features(docs: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines")

    def make():
        words = WordHash()

        def run(rows: dict) -> dict:
            each = [base_counts(t or "", words) for t in rows["text"]]
            return {k: rows[k] for k in ("doc_id", "source", "key")} | {k: [x[k] for x in each] for k in names}
        return run

    counted = map_batches(docs.select("doc_id", "source", text_key().alias("key"), "text"), make,
                          "doc_id long, source string, key long, n_words long, word_chars long, n_symbols long, "
                          "n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:long>>")
    return written(counted.withColumn("uid", F.monotonically_increasing_id()), "quality")


def frequent_lines(feats: DataFrame, max_share: float, min_docs: int) -> DataFrame:
    """(source, h) of the lines above the limits."""
    # A text counts once per line and host: groups by the whole triple first, so a line that all documents share is counted in parts.
    lines = feats.select("source", "key", F.explode("lines.h").alias("h"))
    docs = lines.groupBy("source", "h").agg(F.countDistinct("key").alias("n"))
    hosts = feats.groupBy(F.col("source").alias("host")).agg(F.countDistinct("key").alias("of"))
    return written(docs.where(F.col("n") >= min_docs).join(hosts, F.col("source").eqNullSafe(F.col("host")))
                   .where(F.col("n") > F.col("of") * max_share).select("source", "h"), "lines")


def judge(docs: DataFrame, *, max_share: float = 0.05, min_docs: int = 20, min_words: int = 10, min_left: float = 0.3) -> DataFrame:
    """Counts and verdict per row, with the lines to remove (``cut``)."""
    feats = features(docs)
    hot = frequent_lines(feats, max_share, min_docs).select(F.col("source").alias("host"), F.col("h").alias("line"))
    own = feats.select("uid", "source", F.explode("lines").alias("l"))
    cuts = (own.join(hot, F.col("source").eqNullSafe(F.col("host")) & (F.col("l.h") == F.col("line")))
            .groupBy("uid").agg(F.sum("l.w").alias("n_cut_words"), F.collect_list("line").alias("cut")))
    left = F.col("n_words") - F.col("n_cut_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (feats.drop("lines").join(cuts, "uid", "left")
            .withColumn("n_cut_words", F.coalesce("n_cut_words", F.lit(0)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (left >= min_words) & (left >= F.col("n_words") * min_left)))


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents kept, without the lines above the limits; all columns."""
    seen = judge(docs, **limits).where("kept").select(
        F.col("doc_id").alias("_tw_id"), F.col("source").alias("_tw_source"), F.col("key").alias("_tw_key"), F.col("cut").alias("_tw_cut"))
    # Rows with one id, source and text have one verdict.
    seen = written(seen.dropDuplicates(["_tw_id", "_tw_source", "_tw_key"]), "verdicts")
    names = docs.columns
    joined = docs.join(seen, F.col("doc_id").eqNullSafe(F.col("_tw_id")) & F.col("source").eqNullSafe(F.col("_tw_source"))
                       & (text_key() == F.col("_tw_key"))).select(*names, "_tw_cut")

    def make():
        def run(rows: dict) -> dict:
            texts = []
            for text, cut in zip(rows["text"], rows["_tw_cut"]):
                if cut and text:
                    gone = set(cut)
                    text = b"\n".join(x for x in text.encode().split(b"\n") if not x.strip() or _hash(x.translate(NORMAL)) not in gone).decode()
                texts.append(text)
            return {n: rows[n] for n in names} | {"text": texts} | ({"n_chars": [t if t is None else len(t) for t in texts]} if "n_chars" in names else {})
        return run

    return map_batches(joined, make, docs.schema)
