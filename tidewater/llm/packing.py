"""Sum-of-squares packing of token sequences.

A document is its token ids followed by an end id.  Documents longer than a
sequence are cut into full pieces; the first piece holds the rest.  Pieces
are dealt evenly to shards; inside a shard they are placed one after the
other, longest first: of the open sequences that it fits, a piece goes to
the one for which the sum of squared counts of open sequences per residual
gap becomes smallest (ties: the smaller gap); if it fits none, it opens a
new one.  A shard's state is the open sequences of each gap.

Cases: null or empty text is the end id alone; repeated rows are packed
each; no rows give no rows.  Texts that hold a special token's string get
its id, as the tokenizer library gives it.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches

SEQUENCE = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"     # vocabulary and special tokens
RANKS = "byte_bpe_50k.tiktoken"     # the same vocabulary as ranks
SHARD_DOCS = 100_000
CACHE_CHUNKS = 300_000
LONG_TEXT = 1 << 20
SPACE = r"\t-\r \x85\xa0  -     　"
# The tokenizer's word pattern takes a run of white space but for its last character, and
# joins a last blank to the next word.  So a text can be cut before every blank but those
# with white space, or on their right the end, on both sides.
UNSAFE = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")
SAFE = re.compile(rf"(?<![{SPACE}]) | (?![{SPACE}]|\Z)")


class Encoder:
    """Text to packed little-endian ids, equal to the tokenizer library's
    ``encode(text, add_special_tokens=False)``; chunks met before are kept."""

    def __init__(self, tokenizer: str, ranks: str):
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.blank = np.zeros(max(table.values()) + 1, bool)        # ids of tokens that begin with a blank
        self.blank[[i for token, i in table.items() if token[:1] == b" "]] = True
        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            self.special = {x["content"]: struct.pack("<I", x["id"]) for x in json.load(f)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}       # packed ids of a blank and a chunk

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), "<u4")

    def _learn(self, chunks: set[str]) -> None:
        """Keep the ids of the chunks.  Those without white space are encoded
        together: in their ids, only the first of each begins with a blank."""
        plain = [c for c in chunks if c.split() == [c]]
        if plain:
            ids = self._ids(" " + " ".join(plain))
            first = np.flatnonzero(self.blank[ids]) * 4
            if len(first) == len(plain):
                packed = ids.tobytes()
                self.known.update(zip(plain, map(packed.__getitem__, map(slice, first.tolist(), [*first[1:].tolist(), len(packed)]))))
        for c in chunks:
            if c not in self.known:
                self.known[c] = self._ids(" " + c).tobytes()

    def _known(self, chunks: list[str]) -> bytes:
        own = set(chunks)
        new = own.difference(self.known)
        if len(self.known) + len(new) > CACHE_CHUNKS:
            self.known.clear()
            new = own
        if new:
            self._learn(new)
        return b"".join(map(self.known.__getitem__, chunks))

    def _plain(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > LONG_TEXT and (m := SAFE.search(text, at + LONG_TEXT)):
            out.append(self._part(text[at:m.start()], at > 0))
            at = m.start()
        return b"".join(out) + self._part(text[at:], at > 0)

    def _part(self, text: str, blank: bool) -> bytes:
        """Ids of a part of a text; ``blank``: it begins with a blank to cut before."""
        chunks = SAFE.split(text) if UNSAFE.search(text) else text.split(" ")
        first = b"" if blank else self._ids(chunks[0]).tobytes()
        return first + self._known(chunks[1:])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            return b"".join(self.special.get(x) or self._plain(x) for x in self.cut.split(text))
        return self._plain(text)


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str) -> Encoder:
    return Encoder(tokenizer, ranks)


def pieces(docs: DataFrame, *, tokenizer: str = TOKENIZER, ranks: str = RANKS, size: int = SEQUENCE,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents."""
    end = struct.pack("<I", end_id)

    def make():
        encode = encoder(tokenizer, ranks)

        def run(rows: dict) -> dict:
            out: dict = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(rows["doc_id"], rows["text"]):
                ids = memoryview(encode(text) + end)
                n = len(ids) // 4
                bounds = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(itertools.pairwise(bounds)):
                    part = ids[4 * a:4 * b]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["ids"].append(bytes(part) if with_ids else None)
            return out if with_ids else {k: v for k, v in out.items() if k != "ids"}
        return run

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make,
                       "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Shard:
    """Open sequences by residual gap."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.made = 0

    def place(self, n: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of n tokens."""
        size, count = self.size, self.count
        gap = size
        if n < size:
            before, after = count[n:size], count[:size - n]
            # The change of the sum of squares, less a constant that all choices share.
            # count[0] stays 0: a sequence without a gap is closed.
            change = 2 * (after - before)
            change[0] -= 1
            change[before == 0] = 2 * self.made + 1
            k = int(change.argmin())
            if before[k]:
                gap = n + k
        if gap == size:
            seq = self.made
            self.made += 1
        else:
            seq = self.open[gap].pop()
            count[gap] -= 1
        rest = gap - n
        if rest:
            count[rest] += 1
            self.open[rest].append(seq)
        return seq, size - gap


def pack(items: DataFrame, *, shards: int, size: int = SEQUENCE) -> DataFrame:
    """``items`` (any columns, with ``length`` <= size) with sequence_id and
    offset.  Each shard is one task of about SHARD_DOCS documents' pieces."""
    ddl = ", ".join(f"`{n}` {t}" for n, t in items.dtypes) + ", sequence_id long, offset long"
    names = items.columns
    order = [F.col("length").desc(), *[F.col(n).asc_nulls_first() for n in names if n in ("doc_id", "piece")]]

    def make():
        shard = Shard(size)
        first = TaskContext.get().partitionId() << 40

        def run(rows: dict) -> dict:
            placed = [shard.place(n) for n in rows["length"]]
            return {n: rows[n] for n in names} | {"sequence_id": [first + s for s, _ in placed], "offset": [o for _, o in placed]}
        return run

    return map_batches(items.repartition(shards).sortWithinPartitions(*order), make, ddl)


def pack_documents(docs: DataFrame, *, with_ids: bool = False, shard_docs: int = SHARD_DOCS, **params) -> DataFrame:
    """Cut, then pack, all documents."""
    shards = max(1, -(-docs.count() // shard_docs))
    return pack(pieces(docs, with_ids=with_ids, **params), shards=shards, size=params.get("size", SEQUENCE))
