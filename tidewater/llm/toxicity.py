"""Toxicity scores by non-negative positive-unlabelled learning.

A text is the set of its words (lower case, ASCII punctuation as blanks) and
of their beginnings.  A linear model over these is trained on confirmed toxic
documents and on unlabelled ones by the non-negative risk: prior * R_p(+) +
max(0, R_u(-) - prior * R_p(-)); when the bracket falls below zero, a step
goes up it instead.  The prior is the share of toxic ones among all labelled
training rows.  Only features that confirmed documents hold significantly
more often than unlabelled ones get a weight, which is never negative;
near copies among the documents trained on count once, unless nothing tells
the remaining ones apart (all confirmed ones resemble each other): then all
count.

At most POSITIVES confirmed and UNLABELLED other documents are used, those
with the smallest hashes of their ids; none is held out.  The unlabelled
ones are taken without looking at their labels, but for confirmed ones.

Cases: null or empty text gets the score of an empty set; without confirmed
documents every score is the prior (0 without labels); rows with a null id
are not learned from; repeated rows each get a row.
"""

from __future__ import annotations

import string
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches
from tidewater.llm.langid import fold
from tidewater.llm.words import mixed

POSITIVES, UNLABELLED = 2000, 4000
LEAST_DOCS = 3
TELLING = 20.0              # log-likelihood ratio (G squared) from which on a feature is used
STEMS = (4, 5, 6)           # lengths of word beginnings that are features, too
EPOCHS, BATCH, RATE = 30, 512, 0.05
CACHE_WORDS = 200_000
BLANKS = {ord(c): " " for c in string.punctuation}


def words(text: str | None) -> set[str]:
    return set((text or "").lower().translate(BLANKS).split())


def _own_features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings (marked, so that they are no words)."""
    return tuple(xxhash.xxh64_intdigest(f) for f in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)))


class _Hits(dict):
    """Features of a word, of ``only`` these if given; emptied when full."""

    def __init__(self, only=None):
        super().__init__()
        self.only = only

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        hit = self[word] = tuple(f for f in _own_features(word) if self.only is None or f in self.only)
        return hit


def features(own: set[str], hits: _Hits | None = None) -> np.ndarray:
    """Sorted distinct feature hashes of a set of words."""
    found = {f for x in map((_Hits() if hits is None else hits).__getitem__, own) for f in x}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


@dataclass
class Linear:
    weight: dict[int, float] = field(default_factory=dict)
    shift: float = -30.0

    def scorer(self):
        hits = _Hits(self.weight).__getitem__

        def score(text: str | None) -> float:
            found = {f for own in filter(None, map(hits, words(text))) for f in own}
            z = self.shift + sum(self.weight[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return score

    def score(self, text: str | None) -> float:
        return self.scorer()(text)


def without_copies(docs: list[np.ndarray], most: float = 0.8, bands: int = 8, rows: int = 4) -> list[np.ndarray]:
    """The feature sets without those that share more than ``most`` with one
    kept before: copies would make every word of theirs look telling.
    Candidates are sets with equal smallest hashes in all rows of a band."""
    seeds = np.random.default_rng(1).integers(0, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
    kept, meet = [], defaultdict(list)
    for own in docs:
        if not len(own):
            continue
        low = np.array([mixed((own ^ s) * s).min() for s in seeds]).reshape(bands, rows)
        keys = [(i, x.tobytes()) for i, x in enumerate(low)]
        near = {k for b in keys for k in meet.get(b, ())}
        for k in near:
            common = len(np.intersect1d(own, kept[k], assume_unique=True))
            if common > most * (len(own) + len(kept[k]) - common):
                break
        else:
            for b in keys:
                meet[b].append(len(kept))
            kept.append(own)
    return kept


def _telling(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """G squared of a out of n against b out of m, 0 where a's share is not larger."""
    def part(x, expected):
        return x * np.log(np.maximum(x, 1e-12) / np.maximum(expected, 1e-12))
    p = (a + b) / (n + m)
    g = 2 * (part(a, n * p) + part(b, m * p) + part(n - a, n * (1 - p)) + part(m - b, m * (1 - p)))
    return np.where(a / n > b / m, g, 0.0)


def telling_features(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that get a weight, with the numbers of confirmed and of
    unlabelled documents that hold them."""
    names, a = np.unique(np.concatenate(positive), return_counts=True)
    names, a = names[a >= LEAST_DOCS], a[a >= LEAST_DOCS].astype(float)
    at = [np.searchsorted(names, d[np.isin(d, names, assume_unique=True)]) for d in unlabelled]
    b = np.bincount(np.concatenate(at), minlength=len(names)).astype(float)
    use = np.flatnonzero(_telling(a, len(positive), b, len(unlabelled)) >= TELLING)
    return names[use], a[use], b[use]


def _risk_slopes(z: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """d risk / d z of a batch under the sigmoid loss l(z) = 1 / (1 + e^z)."""
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    slope = s * (1 - s)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    bracket = (s[~positive].sum() / n_u) - prior * (s[positive].sum() / n_p)
    up = np.where(positive, -prior * slope / n_p, slope / n_u)       # of the bracket
    if bracket < 0:
        return -up
    return up + np.where(positive, -prior * slope / n_p, 0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 11) -> Linear:
    """A model from the feature sets of confirmed and unlabelled documents."""
    every = positive, unlabelled
    positive, unlabelled = without_copies(positive), without_copies(unlabelled)
    if not positive or not unlabelled:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Linear({}, float(np.log(p / (1 - p))))
    names, a, b = telling_features(positive, unlabelled)
    if not len(names):          # the confirmed ones are all alike: what tells them apart are their copies
        positive, unlabelled = ([d for d in docs if len(d)] for docs in every)
        names, a, b = telling_features(positive, unlabelled)
    rng = np.random.default_rng(seed)
    docs = [np.searchsorted(names, d[np.isin(d, names, assume_unique=True)]) for d in positive + unlabelled]
    y = np.arange(len(docs)) < len(positive)
    # Start at the log ratio of document shares, the confirmed ones' part taken out of the unlabelled.
    p, u = a / len(positive), b / len(unlabelled)
    # The remainder less its standard deviation: a share that sampling explains is none.
    theta = np.log((p + 1 / len(docs)) / (np.maximum(u - np.sqrt(u / len(unlabelled)) - prior * p, 0) / (1 - prior) + 1 / len(docs)))
    shift = float(np.log(prior / (1 - prior))) - 2.0
    m, v = np.zeros(len(theta) + 1), np.zeros(len(theta) + 1)
    step = 0
    share = int(max(1, BATCH * len(positive) / len(docs)))
    for _ in range(EPOCHS):
        for own, rest in zip(np.array_split(rng.permutation(np.flatnonzero(y)), max(1, len(positive) // share)),
                             np.array_split(rng.permutation(np.flatnonzero(~y)), max(1, len(positive) // share))):
            batch = np.concatenate([own, rest])
            sizes = np.array([len(docs[i]) for i in batch])
            at = np.concatenate([docs[i] for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            z = shift + np.bincount(row, theta[at], len(batch))
            g = _risk_slopes(z, y[batch], prior)
            grad = np.append(np.bincount(at, g[row], len(theta)), g.sum())
            step += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
            theta = np.maximum(theta - move[:-1], 0)
            shift -= float(move[-1])
    return Linear({int(w): float(x) for w, x in zip(names, theta) if x}, shift)


def _collected(docs: DataFrame, ids: DataFrame, bound: int) -> list[np.ndarray]:
    """Feature sets of the documents with the given ids (at most ``bound``)."""
    def make():
        hits = _Hits()

        def run(rows: dict) -> dict:
            return {"doc_id": rows["doc_id"], "w": [features(words(t), hits).tobytes() for t in rows["text"]]}
        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"))
    found = map_batches(rows.select("doc_id", "text"), make, "doc_id long, w binary")
    return [np.frombuffer(bytes(r["w"]), np.uint64) for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("w")).limit(bound).toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
             .where((fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()))
    n, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not n or not toxic:
        return Linear()
    prior = min(0.9, toxic / n)
    confirmed = known.where("toxic = 1").select("doc_id").distinct()
    rest = (docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(fold(F.col("doc_id")) != 0).distinct()
            .join(confirmed, "doc_id", "left_anti"))
    first = lambda x, k: x.orderBy(F.xxhash64("doc_id"), "doc_id").limit(k)
    return fit(_collected(docs, first(confirmed, positives), positives), _collected(docs, first(rest, unlabelled), unlabelled), prior)


def score(docs: DataFrame, labels: DataFrame | None = None, model: Linear | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = model or train(docs, labels)

    def make():
        score = model.scorer()

        def run(rows: dict) -> dict:
            s = [score(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": s, "predicted": [int(x >= 0.5) for x in s]}
        return run

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text"), make,
                       "doc_id long, held_out boolean, score double, predicted int")
