"""Runs (maximal periodic stretches of words) of each text, and texts
without their repetitions.

A run is a stretch of consecutive words with smallest period q, at least
``max(min_length, 2 q)`` long, that neither neighbouring word extends.  Its
first q words stay; the words after them are dropped.

Method.  In a run of length L, L - q >= min_length / 2 consecutive words
come again q later, so every word of it lies in a window of half the least
length that the text holds twice: stretches of such words are searched one
by one, the others hold no run.  In a stretch, the first phase of Baier's
suffix sorting (:func:`lyndon`) groups the suffixes by their Lyndon
prefixes, once under an order of the words and once under its reverse: the
lengths are the two Lyndon arrays.  By the runs theorem each run holds such
a prefix of length q as a root; every prefix is extended to both sides by
longest common extensions (exact names of all stretches of 2^k words) and
is a run where the extensions reach its length.

Cases: null or empty text, and text of white space, has no words and no
runs; rows with null or repeated ids are judged each for itself; no rows
give no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidewater.llm.common import bounded, schema_of
from tidewater.llm.words import WordHash, repeated_mask

MIN_LENGTH = 12
ROWS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon(symbols: list[int], count: int) -> list[int]:
    """Length of the longest Lyndon word at each position, by Baier's grouping.

    ``symbols``: each 0 .. count - 1.  Groups hold the suffixes that share a
    context (a known beginning of their Lyndon prefix) and are visited from
    the highest down.  The suffixes not yet visited form a list in text
    order; where one is followed there by l members of the visited group,
    its context grows by l times theirs.  The members of a group that grew
    alike become a new group just above it, those that grew more higher.
    """
    n = len(symbols)
    length = [1] * n
    group = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    members: list[list[int]] = [[] for _ in range(count)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    below, above = list(range(-1, count - 1)), list(range(1, count + 1))
    above[-1:] = [-1]
    g = count - 1
    while g >= 0:
        grown: dict[tuple[int, int], list[int]] = {}
        for i in members[g]:
            if group[i] != g or (before[i] >= 0 and group[before[i]] == g):
                continue                    # moved on, or not the first of its stretch
            parent, times, j = before[i], 1, after[i]
            while j < n and group[j] == g:
                times += 1
                j = after[j]
            if j < n:
                before[j] = parent
            if parent >= 0:
                after[parent] = j
                length[parent] += times * length[i]
                grown.setdefault((group[parent], times), []).append(parent)
        last = under = -1
        for key in sorted(grown):
            new = len(members)
            if key[0] != last:
                last = under = key[0]
            over = above[under]
            members.append(grown[key])
            below.append(under)
            above.append(over)
            above[under] = new
            if over >= 0:
                below[over] = new
            for i in grown[key]:
                group[i] = new
            under = new
        g = below[g]
    return length


class Extensions:
    """Longest common extensions by names: level k names the stretches of 2^k
    words, equal ones alike; levels end where all stretches differ."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = [symbols.astype(np.int64)]
        while True:
            width, top = 1 << (len(self.levels) - 1), self.levels[-1]
            if len(top) <= width:
                break
            kinds, names = np.unique(top[:-width] * (int(top.max()) + 1) + top[width:], return_inverse=True)
            if len(kinds) == len(names):
                break
            self.levels.append(names.astype(np.int64))

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j > i on."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(j + done + (1 << k) <= self.n)
            a, b, names = i[fits] + done[fits], j[fits] + done[fits], self.levels[k]
            done[fits[names[a] == names[b]]] += 1 << k
        return done

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before i and before j > i."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(i - done >= 1 << k)
            a, b, names = i[fits] - done[fits] - (1 << k), j[fits] - done[fits] - (1 << k), self.levels[k]
            done[fits[names[a] == names[b]]] += 1 << k
        return done


def runs_of(words: list, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, length, period) of all runs of a stretch, in no order."""
    ids: dict = {}
    symbols = [ids.setdefault(w, len(ids)) for w in words]
    equal = Extensions(np.array(symbols))
    n, top = len(symbols), len(ids) - 1
    found = []
    for order in (symbols, [top - s for s in symbols]):
        period = np.array(lyndon(order, top + 1), np.int64)
        i = np.arange(n)
        far, near = equal.right(i, i + period), equal.left(i, i + period)
        length = near + period + far
        whole = np.flatnonzero((length >= 2 * period) & (length >= min_length))
        found.append(np.stack([i[whole] - near[whole], length[whole], period[whole]], 1))
    return np.unique(np.concatenate(found), axis=0)


def search(words: list[bytes], hashed: WordHash, min_length: int = MIN_LENGTH) -> np.ndarray:
    """All runs of a text's words, by start, then period."""
    if len(words) < min_length:
        return np.empty((0, 3), np.int64)
    twice = repeated_mask(hashed.of(words), (min_length + 1) // 2)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8))).reshape(-1, 2)
    found = [runs_of(words[a:b], min_length) + [a, 0, 0] for a, b in edges.tolist() if b - a >= min_length]
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find(docs: DataFrame, *, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every text: its runs by start,
    then period, and its words without the repetitions, joined by a space."""
    schema = schema_of(ROWS)
    arrow = to_arrow_schema(schema)
    runs_type = arrow.field("runs").type

    def task(batches):
        hashed = WordHash()
        for whole in batches:
            for batch in bounded(whole):
                found, counts, kept = [], [], []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    words = (text or b"").split()       # at ASCII white space
                    runs = search(words, hashed, min_length)
                    found.append(runs)
                    counts.append(len(words))
                    kept.append(b" ".join(kept_words(words, runs)))
                table = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                edges = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in range(3)], fields=list(runs_type.value_type))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(edges), values, type=runs_type),
                    pa.array(kept, pa.binary()).cast(pa.string())], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and
    checksums of what ``find`` returns."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("_top"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("_top.s")).alias("start"), F.col("_top.length").alias("length"), (-F.col("_top.q")).alias("period"),
        F.expr("(1000 * _top.length) div (-_top.q)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
