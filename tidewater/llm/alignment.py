"""Alignment of two tokenizers over the same texts.

Every text is encoded by tokenizer A (byte-level BPE, of a blank and the
text) and by B (sentencepiece, which adds the blank itself).  Byte offsets
where a token of A and one of B both end cut the tokens into groups; tokens
whose bytes overlap are linked; a pair of ids counts the documents of the
corpus that hold it linked.

The cuts are found by divide and conquer (:func:`shared_cuts`): a common end
near the middle of an interval, located by bisection in B's ends, splits it,
and both halves go on; an interval without a common end is a leaf, a group.
All intervals of a level, over all texts of a batch, go on together.

The texts are encoded once.  A written table holds a row per batch: its
documents' figures, its distinct pairs and, packed, which document holds
which pair how often.  Only a batch's distinct pairs are counted, joined
with their totals and brought back to the batch.

Cases: null or empty texts, and texts that either tokenizer does not give
back byte for byte, have no tokens: zeros and an empty checksum.  Strings of
special tokens are plain text.  Null and repeated ids are documents each;
no rows give no rows; columns beyond doc_id and text are ignored.  A text's
own tokens are held by one task.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.llm.common import schema_of, written
from tidewater.llm.packing import SPACE

RANKS_A = "byte_bpe_50k.tiktoken"
MODEL_B = "piece_bpe_32k.model"
BATCH_TEXT = 2 << 20        # bytes of text aligned at once; one text at least
CACHE_CHUNKS = 300_000
CACHE_CHARS = 64            # longer chunks are encoded each time
B_BITS = 32                 # a pair of ids is a << B_BITS | b
NEAR = 8                    # ends tried one by one on either side of the middle

# A blank behind a character that is no white space begins a token of either tokenizer: A's word
# pattern joins it to what follows, and no piece of B holds a blank behind another character.
CUT = re.compile(rf"(?<![{SPACE}]) ")
UNSAFE = re.compile(rf"[{SPACE}] ")

BATCH = ("batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
         "pairs array<long>, documents array<long>, held binary")
SCORES = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """Ids of both tokenizers, by chunks between cuts; chunks met before are kept."""

    def __init__(self, ranks: str, model: str):
        import sentencepiece
        import tiktoken
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            self.bytes_a[i] = token
        self.library_b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        pieces = [self.library_b.id_to_piece(i) for i in range(self.library_b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{model}: a piece holds a blank behind another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.library_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.blank_b = self.library_b.piece_to_id("▁")
        self.size_a, self.size_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        self.starts_a = np.array([t[:1] == b" " for t in self.bytes_a])
        # Decimal ids with what follows them: the next id of the group, the other side, the next group.
        self.texts = [b"%d%c" % (i, c) for n, ends in ((len(self.bytes_a), b",|"), (len(self.bytes_b), b",;")) for c in ends for i in range(n)]
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes] = {}
        self.bad: set[str] = set()

    def _a(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """A's ids of a blank and each chunk.  Chunks without white space are
        encoded together: in their ids, only the first of each begins with a blank."""
        plain = [c for c in chunks if c.split() == [c]]
        if plain:
            ids = np.array(self.encode_a(" " + " ".join(plain)), "<u4")
            first = np.flatnonzero(self.starts_a[ids]) * 4
            if len(first) == len(plain):
                packed = ids.tobytes()
                yield from zip(plain, map(packed.__getitem__, map(slice, first.tolist(), [*first[1:].tolist(), len(packed)])))
            else:
                plain = []
        done = set(plain)
        for c in chunks:
            if c not in done:
                yield c, np.array(self.encode_a(" " + c), "<u4").tobytes()

    def _b(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        for c, ids in zip(chunks, self.library_b.encode(chunks, num_threads=1)):
            yield c, np.array(ids if c else [self.blank_b], "<u4").tobytes()

    def _lossy(self, chunks: list[str]) -> list[str]:
        """Those of the chunks that either side does not give back.  If all of
        them together have their bytes and each its length, none is lossy."""
        want = [(" " + c).encode() for c in chunks]
        whole, lengths = b"".join(want), np.array(list(map(len, want)), np.int64)
        lossy: set[str] = set()
        for known, table, size in ((self.known_a, self.bytes_a, self.size_a), (self.known_b, self.bytes_b, self.size_b)):
            packed = [known[c] for c in chunks]
            ids = np.frombuffer(b"".join(packed), "<u4")
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            to = np.cumsum([len(x) // 4 for x in packed])
            if self.joined(table, packed) != whole or (np.diff(ends[to], prepend=0) != lengths).any():
                lossy.update(c for c, x, w in zip(chunks, packed, want) if self.joined(table, [x]) != w)
        return list(lossy)

    def joined(self, table: list[bytes], packed: list[bytes]) -> bytes:
        return b"".join(map(table.__getitem__, np.frombuffer(b"".join(packed), "<u4").tolist()))

    def batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Packed ids (A, B) of each text; both empty for texts without tokens."""
        split = [(CUT.split(" " + t)[1:] if UNSAFE.search(" " + t) else t.split(" ")) if t else [] for t in texts]
        own = set().union(*split)
        new = [c for c in own if c not in self.known_a]
        if len(self.known_a) + len(new) > CACHE_CHUNKS:
            self.known_a.clear(), self.known_b.clear(), self.bad.clear()
            new = list(own)
        self.known_a.update(self._a(new))
        self.known_b.update(self._b(new))
        if new:
            self.bad.update(self._lossy(new))
        out = []
        for text, chunks in zip(texts, split):
            a, b = (b"".join(map(k.__getitem__, chunks)) for k in (self.known_a, self.known_b))
            if self.bad and not self.bad.isdisjoint(chunks) and not (" " + text).encode() == self.joined(self.bytes_a, [a]) == self.joined(self.bytes_b, [b]):
                a = b = b""
            out.append((a, b))
        for c in new:
            if len(c) > CACHE_CHARS:
                del self.known_a[c], self.known_b[c]
                self.bad.discard(c)
        return out


@functools.lru_cache(maxsize=1)
def tokenizers(ranks: str, model: str) -> Tokenizers:
    return Tokenizers(ranks, model)


def is_end(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which offsets are among the ascending ``ends``, by bisection."""
    return ends[np.minimum(np.searchsorted(ends, at), len(ends) - 1)] == at


def near_middle(a_end: np.ndarray, b_end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval low <= k < high of A's ends, the k next to its middle
    at which B ends too; -1 if there is none."""
    middle = (low + high) // 2
    at = np.full(len(low), -1, np.int64)
    left = np.arange(len(low))
    for step in sorted(range(1 - NEAR, NEAR), key=abs):
        k = middle[left] + step
        inside = np.flatnonzero((k >= low[left]) & (k < high[left]))
        inside = inside[is_end(b_end, a_end[k[inside]])]
        at[left[inside]] = k[inside]
        left = left[at[left] < 0]
    # Longer intervals without a common end there: all their ends at once.
    left = left[high[left] - low[left] > NEAR]
    if len(left):
        n = high[left] - low[left]
        of = np.repeat(np.arange(len(left)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[left][of]
        hit = np.flatnonzero(is_end(b_end, a_end[k]))
        hit = hit[np.lexsort((np.abs(k[hit] - middle[left][of[hit]]), of[hit]))]
        first = np.flatnonzero(np.diff(of[hit], prepend=-1))
        at[left[of[hit][first]]] = k[hit[first]]
    return at


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All k of the intervals low <= k < high at which A and B end together."""
    found = [np.empty(0, np.int64)]
    while len(low):
        at = near_middle(a_end, b_end, low, high)
        cut = at >= 0                       # the others are leaves
        at, low, high = at[cut], low[cut], high[cut]
        found.append(at)
        low, high = np.concatenate([low, at + 1]), np.concatenate([at, high])
        wide = low < high
        low, high = low[wide], high[wide]
    return np.sort(np.concatenate(found))


class Aligned:
    """Groups and links of the texts of a batch."""

    def __init__(self, encoded: list[tuple[bytes, bytes]], t: Tokenizers):
        self.n_a, self.n_b = (np.array([len(e[k]) // 4 for e in encoded], np.int64) for k in (0, 1))
        self.a, self.b = (np.frombuffer(b"".join(e[k] for e in encoded), "<u4").astype(np.int64) for k in (0, 1))
        self.to_a, self.to_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        # Both sides hold the same bytes text by text, so offsets may run on over the whole batch.
        a_end, b_end = np.cumsum(t.size_a[self.a]), np.cumsum(t.size_b[self.b])
        some = self.n_a > 0
        cuts = shared_cuts(a_end, b_end, (self.to_a - self.n_a)[some], self.to_a[some] - 1)
        self.group_to_a = np.union1d(cuts + 1, self.to_a[some])              # tokens of A up to each group's end
        self.group_to_b = np.searchsorted(b_end, a_end[self.group_to_a - 1]) + 1
        self.n_groups = np.diff(np.searchsorted(self.group_to_a, np.concatenate([[0], self.to_a]), side="right"))
        self.n_groups[~some] = 0
        # Links of a token of A: the tokens of B from the one that holds its first byte to the one that holds its last.
        first = np.searchsorted(b_end, a_end - t.size_a[self.a], side="right")
        links = np.searchsorted(b_end, a_end) - first + 1
        to = np.cumsum(links)
        self.link_b = np.arange(to[-1] if len(to) else 0) - np.repeat(to - links - first, links)
        self.link_a = np.repeat(np.arange(len(links)), links)
        self.n_links = np.diff(np.concatenate([[0], to])[np.concatenate([[0], self.to_a])])

    def checksums(self, t: Tokenizers) -> list[str]:
        """sha256 of each text's groups, ``a1,a2|b1;a3|b2,b3``."""
        va, vb = len(t.bytes_a), len(t.bytes_b)
        size_a, size_b = np.diff(self.group_to_a, prepend=0), np.diff(self.group_to_b, prepend=0)
        code_a, code_b = self.a.copy(), self.b + 2 * va
        code_a[self.group_to_a - 1] += va
        code_b[self.group_to_b - 1] += vb
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + np.repeat(self.group_to_b - size_b, size_a)] = code_a
        codes[np.arange(len(self.b)) + np.repeat(self.group_to_a, size_b)] = code_b
        to = (self.to_a + self.to_b).tolist()
        text = t.texts.__getitem__
        return [hashlib.sha256(b"".join(map(text, codes[x:y].tolist()))[:-1]).hexdigest() if y > x else "" for x, y in zip([0, *to], to)]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, documents) distinct in the batch; (text, pair's place, links) of each text's distinct pairs."""
        links, places = np.unique(self.a[self.link_a] << B_BITS | self.b[self.link_b], return_inverse=True)
        text = np.repeat(np.arange(len(self.n_links)), self.n_links)
        own, times = np.unique(text * max(1, len(links)) + places, return_counts=True)
        place = own % max(1, len(links))
        return links, np.bincount(place, minlength=len(links)), own // max(1, len(links)), place, times


def pack_ints(*columns: np.ndarray) -> bytes:
    """Columns of ints below 2^32, compressed byte plane by byte plane."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns), 1)


def unpack_ints(packed: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes]


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of about BATCH_TEXT bytes."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if size + len(text or "") > BATCH_TEXT and texts:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text or "") + 32
    if texts:
        yield ids, texts


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, *, ranks: str = RANKS_A, model: str = MODEL_B) -> DataFrame:
    """(doc_id, groups): each text's groups in order, with the ids of both sides."""
    schema = schema_of("doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
    arrow = to_arrow_schema(schema)
    rows = arrow.field("groups").type
    pair = rows.value_type

    def run(batches):
        t = tokenizers(ranks, model)
        for ids, texts in text_batches(batches):
            x = Aligned(t.batch(texts), t)
            sides = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], to]).astype(np.int32)), pa.array(side.astype(np.int32)), type=f.type)
                     for to, side, f in ((x.group_to_a, x.a, pair[0]), (x.group_to_b, x.b, pair[1]))]
            edges = pa.array(np.concatenate([[0], np.cumsum(x.n_groups)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(
                edges, pa.StructArray.from_arrays(sides, fields=list(pair)), type=rows)], schema=arrow)

    return _rows(docs).mapInArrow(run, schema)


def batched(docs: DataFrame, *, ranks: str = RANKS_A, model: str = MODEL_B) -> DataFrame:
    """The written table of batches."""
    schema = schema_of(BATCH)
    arrow = to_arrow_schema(schema)

    def run(batches):
        t, at = tokenizers(ranks, model), TaskContext.get().partitionId() << 32
        for ids, texts in text_batches(batches):
            x = Aligned(t.batch(texts), t)
            pairs, documents, text, place, times = x.held()
            # Texts and places ascend: differences are small.  A new text starts at its first place.
            place = np.where(np.diff(text, prepend=-1) > 0, place, np.diff(place, prepend=0))
            row = [at, ids, x.n_a, x.n_b, x.n_groups, x.n_links, x.checksums(t), pairs, documents, pack_ints(np.diff(text, prepend=0), place, times)]
            yield pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, (int, list, bytes)) else v.tolist()], f.type) for v, f in zip(row, arrow)], schema=arrow)
            at += 1

    return written(_rows(docs).mapInArrow(run, schema), "alignments")


def pair_totals(batches: DataFrame) -> DataFrame:
    """(pair, documents, best): every linked pair of ids with the number of
    documents that hold it; best: the highest of its id of A."""
    each = batches.select(F.explode(F.arrays_zip("pairs", "documents")).alias("x"))
    totals = written(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.documents").alias("documents")), "pairs")
    a = F.shiftright("pair", B_BITS)
    most = totals.groupBy(a.alias("a")).agg(F.max("documents").alias("most"))       # a row per id of A: bounded by its vocabulary
    return totals.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def pair_table(docs: DataFrame, **params) -> DataFrame:
    """(a, b, documents, best): the corpus's table of linked ids."""
    return pair_totals(batched(docs, **params)).select(
        F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "documents", "best")


def score(docs: DataFrame, **params) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are the
    best of their id of A, the sum of the links' counts, and a checksum."""
    batches = batched(docs, **params)
    own = batches.select(F.col("batch").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    judged = own.join(pair_totals(batches), "pair").select("of", "place", "documents", "best")
    schema = schema_of(SCORES)
    arrow = to_arrow_schema(schema)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        count, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
        at = found["place"].to_numpy()
        count[at], best[at] = found["documents"].to_numpy(), found["best"].to_numpy()
        row = rows.to_pylist()[0]
        text, place, times = unpack_ints(row["held"], 3)
        first = np.flatnonzero(np.diff(text := np.cumsum(text), prepend=-1))
        run_up = np.cumsum(place)
        place = run_up - np.repeat(run_up[first] - place[first], np.diff(first, append=len(place)))
        sums = {"n_best": best, "count_sum": count}
        for name, value in sums.items():
            sums[name] = np.zeros(len(row["doc_id"]), np.int64)
            if len(first):
                sums[name][text[first]] = np.add.reduceat(value[place] * times, first)
        return pa.table([pa.array(sums[f.name] if f.name in sums else row[f.name], f.type) for f in arrow], schema=arrow)

    kept = batches.drop("pairs", "documents")
    return kept.groupBy("batch").cogroup(judged.groupBy("of")).applyInArrow(run, schema)
