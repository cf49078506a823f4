"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (lower case, everything but
letters as one blank), weighted by 1 + log count and inverse document
frequency, of length 1.  Each language has several centroids, clustered by
cosine; a text gets the language of the centroid nearest to it.  A text
farther from it than almost all training texts of that language is marked
``rejected`` and its score halved; its language stays the nearest one.

The classifier is fitted on at most PER_LANGUAGE documents of each language,
those with the smallest hashes of their ids, and never sees held-out ones.

Cases: null text, or a text without a letter, is ``und`` with score 0, as is
every text when nothing could be learned; documents with a null id, and null
languages, are not learned from; repeated rows each get a row.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches

BITS = 13
DIM = 1 << BITS
GRAMS = (1, 2, 3)
PER_LANGUAGE = 300          # documents to learn a language from, at most
CLUSTERS = 3
REJECT = 0.999              # share of a language's training texts within its distance, which is then widened by SLACK
SLACK = 1.15
SHARPNESS = 30.0            # of the score as a function of cosines


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of a text; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = _letters()[code]
    if not alpha.any():
        return None
    code = np.where(alpha, code, 32).astype(np.uint64)
    # One blank between words and at both ends.
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    code = np.concatenate([[np.uint64(32)], code[int(code[0] == 32):len(code) - int(code[-1] == 32)], [np.uint64(32)]])
    out = []
    for n in GRAMS:
        key = code[:len(code) - n + 1].copy()
        for k in range(1, n):
            key = key * np.uint64(0x110011) + code[k:len(code) - n + 1 + k]
        out.append(((key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.intp)


def counts(found: np.ndarray) -> np.ndarray:
    return np.bincount(found, minlength=DIM).astype(np.float32)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as unit vectors."""
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    idf: np.ndarray
    centers: np.ndarray         # rows: centroids
    langs: list[str]            # of each centroid
    limit: np.ndarray           # largest usual distance of each


def _clustered(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Spherical k-means, from far-apart rows."""
    centers = [x[int(rng.integers(len(x)))]]
    while len(centers) < min(k, len(x)):
        centers.append(x[int((x @ np.stack(centers).T).max(axis=1).argmin())])
    c = np.stack(centers)
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def fit(by_lang: dict[str, np.ndarray], clusters: int = CLUSTERS, seed: int = 3) -> Centroids | None:
    """Centroids from each language's rows of n-gram counts."""
    if not by_lang:
        return None
    rng = np.random.default_rng(seed)
    n = sum(len(x) for x in by_lang.values())
    df = sum((x > 0).sum(axis=0) for x in by_lang.values())
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    centers, langs, limit = [], [], []
    for lang in sorted(by_lang):
        x = weighted(by_lang[lang], idf)
        c = _clustered(x, clusters, rng)
        best = (x @ c.T)
        for i in range(len(c)):
            own = best[best.argmax(axis=1) == i, i]
            limit.append(SLACK * float(np.quantile(1 - own, REJECT)) if len(own) else 1.0)
        centers.append(c)
        langs += [lang] * len(c)
    return Centroids(idf, np.concatenate(centers), langs, np.array(limit))


def classify(texts: list[str | None], model: Centroids | None) -> list[tuple[str, float, bool]]:
    """(language, score, rejected) of each text."""
    out: list = [("und", 0.0, False)] * len(texts)
    found = [(i, g) for i, g in enumerate(map(grams, texts)) if g is not None]
    if model is None or not found:
        return out
    names = sorted(set(model.langs))
    member = np.array([[x == n for x in model.langs] for n in names])
    for at in range(0, len(found), 128):
        part = found[at:at + 128]
        cos = weighted(np.stack([counts(g) for _, g in part]), model.idf) @ model.centers.T
        best = np.stack([np.where(m, cos, -2).max(axis=1) for m in member], axis=1)
        soft = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
        soft /= soft.sum(axis=1, keepdims=True)
        for (i, _), c, p in zip(part, cos, soft):
            near = int(c.argmax())
            away = bool(1 - c[near] > model.limit[near])
            out[i] = (model.langs[near], float(p[names.index(model.langs[near])]) * (0.5 if away else 1.0), away)
    return out


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` learnable documents of each language."""
    ids = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
           .where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # Bounded by the parameter for each language.
    ids = ids.withColumn("k", first).where(F.col("k") <= per_language).select(F.col("doc_id").alias("id"), F.col("lang").alias("l")).distinct()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
            .join(ids, (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("l"))).select("doc_id", "lang", "text"))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Centroids | None:
    def make():
        def run(rows: dict) -> dict:
            out: dict = {"doc_id": [], "lang": [], "at": [], "n": []}
            for doc, lang, text in zip(rows["doc_id"], rows["lang"], rows["text"]):
                g = grams(text)
                if g is not None:
                    at, n = np.unique(g, return_counts=True)
                    out["doc_id"].append(doc)
                    out["lang"].append(lang)
                    out["at"].append(at.astype(np.int32))
                    out["n"].append(n.astype(np.int32))
            return out
        return run

    rows = map_batches(sampled(docs, per_language), make, "doc_id long, lang string, at array<int>, n array<int>")
    # Ids that repeat could bring more rows than asked for.
    one = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("at", "n")))
    by: dict[str, list] = {}
    for r in rows.withColumn("k", one).where(F.col("k") <= per_language).drop("k").orderBy("lang", "doc_id", F.xxhash64("at", "n")).toLocalIterator():
        by.setdefault(r["lang"], []).append((np.array(r["at"], np.int32), np.array(r["n"], np.float32)))
    def dense(found):
        x = np.zeros((len(found), DIM), np.float32)
        for i, (at, n) in enumerate(found):
            x[i, at] = n
        return x
    return fit({k: dense(v) for k, v in by.items()})


def identify(docs: DataFrame, model: Centroids | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    model = model or train(docs)

    def make():
        def run(rows: dict) -> dict:
            found = classify(rows["text"], model)
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": [x[0] for x in found],
                    "score": [x[1] for x in found], "rejected": [x[2] for x in found]}
        return run

    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text"), make,
                       "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
