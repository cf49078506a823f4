"""Approximate nearest neighbours by cross-polytope hashing.

Candidates are cut into bands by norm, each up to ``RATIO`` times shorter
than the one before.  In a band, largest inner product becomes smallest angle
by one more component (sqrt(M^2 - |x|^2), 0 for queries; M is the band's
largest norm), so that a few long vectors do not push all others to one
vertex.  A band has its own tables.  A table turns a
vector, padded to a power of two, by three rounds of random signs and fast
Hadamard transforms, and hashes it to the nearest of the signed axes.  For
many rows a table joins further, possibly smaller, cross-polytopes to the
first, so that a bucket holds about ``bucket_rows`` rows.  Queries look into
the buckets of their ``probes`` best vertices in each table (more for larger
tables, and for bands longer than the median, whose vectors are near at wider
angles); candidates are scored exactly on the original vectors.

Bands of at most LEAST_BAND rows (``bucket_rows``, if that is given) are not
hashed: every query is scored against them.  Queries that found fewer than k
are scored against all rows.

A bucket is cut into blocks of candidates and of queries; each pair of blocks
is a group of rows of its own, so no task holds more than one query block.
Identical vectors are one point with its smallest k + 1 ids: ties go to
smaller ids, so no other id of theirs can be among k neighbours.

Cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components, and rows with a null id, take no part; rows
with one id count once (the nearest); fewer candidates than k give all; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written

TABLES = 16
PROBES = 12              # for tables of one cross-polytope; times (further vertices) ** GROWTH
GROWTH = 0.8             # measured: holds the recall above 0.9 on spread vectors, where 0.6 lost up to a fifth
BUCKET_ROWS = 4096
LEAST_BAND = 16          # rows of a band that cost no more to score than to hash
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 1024
RATIO = 1.25
ROUNDS = 3
CODES = 1 << 21          # sums of one slice of rows in ``vertices``, at most


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of x transformed; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@functools.lru_cache(maxsize=256)
def _signs(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (ROUNDS, n))


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    for s in _signs(seed, x.shape[1]):
        x = hadamard(x * s)
    return x


def shape(dim: int, rows: int, bucket_rows: int) -> tuple[int, list[int]]:
    """Padded length, and the axes used of each cross-polytope of a table."""
    full = 1 << dim.bit_length()        # at least one component more
    axes, need = [full], rows / bucket_rows / (2 * full)
    while need > 1:
        d = min(full, 1 << max(0, int(np.ceil(np.log2(need))) - 1))
        axes.append(d)
        need /= 2 * d
    return full, axes


def vertices(x: np.ndarray, table: int, axes: list[int], probes: int) -> np.ndarray:
    """Codes of the ``probes`` best vertices of each row, best first."""
    code, score = None, None
    for k, d in enumerate(axes):
        r = rotated(x, 1000 * k + table)[:, :d]
        own = np.concatenate([r, -r], axis=1)
        if code is None:
            total, codes = own, np.broadcast_to(np.arange(2 * d), own.shape)
        else:
            total = (score[:, :, None] + own[:, None, :]).reshape(len(x), -1)
            codes = (code[:, :, None] * (2 * d) + np.arange(2 * d)).reshape(len(x), -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        code, score = np.take_along_axis(codes, best, 1), np.take_along_axis(total, best, 1)
    return code


def _padded(vectors: np.ndarray, full: int, largest: np.ndarray | float, query: bool) -> np.ndarray:
    """``largest``: the largest norm of each row's band."""
    x = vectors.astype(np.float64)
    rest = np.zeros((len(x), full - x.shape[1]), np.float64)
    if not query and len(x):
        rest[:, 0] = np.sqrt(np.maximum(largest ** 2 - (x ** 2).sum(axis=1), 0))
    y = np.concatenate([x, rest], axis=1)
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    return (y / np.where(norm > 0, norm, 1)).astype(np.float32)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    good = F.expr("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    kind = "array<float>" if dict(rows.dtypes)[vec_col] == "array<float>" else "array<double>"
    return (rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v"))
            .where(F.col("id").isNotNull() & v.isNotNull()).where(good))


@dataclass
class Band:
    largest: float
    full: int
    axes: list[int]
    probes: int


def bands_of(found: list, dim: int, probes: int, bucket_rows: int, least: int) -> dict[int, Band]:
    """The bands to hash, from (g, rows, largest norm) of each band: those of
    more than ``least`` rows."""
    found = sorted(found, reverse=True)        # the shortest first
    half, seen = sum(n for _, n, _ in found) / 2, 0
    for _, n, usual in found:
        seen += n
        if seen >= half:
            break
    out = {}
    for g, n, largest in found:
        if g >= 0 and n > least:
            full, axes = shape(dim, n, bucket_rows)
            wide = probes * np.prod([2.0 * d for d in axes[1:]]) ** GROWTH * max(1.0, largest / usual)
            out[g] = Band(largest, full, axes, max(1, int(np.ceil(min(wide, np.prod([2.0 * d for d in axes]))))))
    return out


def _codes(rows: DataFrame, bands: dict[int, Band], query: bool) -> DataFrame:
    """One row per table and probed bucket: id, v, t, b.  A candidate (with
    its band g) goes to the tables of its band, a query to those of all."""
    forms = {}        # bands of one form share the rotations
    for g, band in bands.items():
        forms.setdefault(tuple(band.axes), []).append(g)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            n = len(batch)
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            band = None if query else batch.column("g").to_numpy(zero_copy_only=False)
            for axes, own in forms.items():
                wide = max(bands[g].probes for g in own) if query else 1
                which = np.arange(n) if query else np.flatnonzero(np.isin(band, own))
                step = max(1, CODES // (wide * max(2 * d for d in axes)))
                for i in range(0, len(which), step):
                    at = which[i:i + step]
                    largest = 0.0 if query else np.array([bands[g].largest for g in band[at]])
                    x = _padded(flat[at], bands[own[0]].full, largest, query)
                    for t in range(TABLES):
                        code = vertices(x, t, list(axes), wide)
                        if not query:
                            yield _coded(batch, at, band[at] * TABLES + t, code)
                            continue
                        for g in own:
                            yield _coded(batch, at, np.full(len(at), g * TABLES + t), code[:, :bands[g].probes])

    return rows.mapInArrow(run, f"id long, v {dict(rows.dtypes)['v']}, t int, b long")


def _coded(batch: pa.RecordBatch, at: np.ndarray, tables: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    take = pa.array(np.repeat(at, code.shape[1]))
    return pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take),
                                       pa.array(np.repeat(tables, code.shape[1]).astype(np.int32)), pa.array(code.ravel().astype(np.int64))],
                                      names=["id", "v", "t", "b"])


class _Best:
    """The k nearest of each query of one block, ties to smaller ids."""

    def __init__(self, ids: list, vectors: list, k: int):
        self.q, self.x, self.k = np.array(ids, np.int64), np.array(vectors, np.float64), k
        self.ids = [np.empty(0, np.int64) for _ in ids]
        self.scores = [np.empty(0) for _ in ids]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        s = self.x @ vectors.T
        for i in range(len(self.q)):
            row = s[i]
            if len(self.ids[i]) >= self.k:
                take = np.flatnonzero((row >= self.scores[i][-1]) & (ids != self.q[i]))
            else:
                take = np.flatnonzero(ids != self.q[i])
            if len(take):
                a, b = np.concatenate([self.ids[i], ids[take]]), np.concatenate([self.scores[i], row[take]])
                order = np.lexsort((a, -b))
                order = order[np.sort(np.unique(a[order], return_index=True)[1])[:self.k]]     # an id once
                self.ids[i], self.scores[i] = a[order], b[order]


def nearest(queries: DataFrame, rows: DataFrame, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            probes: int = PROBES, bucket_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query."""
    spark = rows.sparkSession
    points = usable(rows, id_col, vec_col)
    # The usual length; vectors of another length cannot be compared.
    size = points.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = size["d"]
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    points = points.where(F.size("v") == dim).withColumn("r", F.dense_rank().over(same)).withColumn("before", F.lag("id").over(same))
    points = points.where((F.col("r") <= k + 1) & ~F.col("id").eqNullSafe(F.col("before")))
    norm = F.expr("sqrt(aggregate(v, 0d, (a, x) -> a + double(x) * double(x)))")
    points = written(points.select("id", "v", norm.alias("norm")), "annpoints")
    # Norms beyond the range of doubles have no band.
    fits = (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    largest = points.where(fits).agg(F.max("norm")).first()[0] or 1.0
    band = F.floor((F.log(F.lit(largest)) - F.log("norm")) / float(np.log(RATIO)))
    points = points.select("id", "v", "norm", F.when(fits, F.greatest(band, F.lit(0))).otherwise(F.lit(-1)).cast("int").alias("g"))
    # At most some thousand bands: the range of doubles.
    found = [tuple(r) for r in points.groupBy("g").agg(F.count("*"), F.max("norm")).collect()]
    bands = bands_of(found, dim, probes, bucket_rows or BUCKET_ROWS, LEAST_BAND if bucket_rows is None else bucket_rows)
    asked = usable(queries, id_col, vec_col).where(F.size("v") == dim).dropDuplicates(["id"])
    few = sum(n for g, n, _ in found if g not in bands)
    groups = [_all_pairs(asked, points.where(~F.col("g").isin(list(bands))), few)] if few else []
    if bands:
        groups.append(_bucket_pairs(asked, points, bands))
    best = _ranked(groups, k)
    if not bands:
        return best
    best = written(best, "annbest")
    enough = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(asked.join(enough, "id", "left_anti"), "annshort")
    rest = _ranked([_all_pairs(short, points, sum(n for _, n, _ in found))], k)
    return best.join(enough.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(rest)


def _own(n) -> Column:
    return F.pmod(F.xxhash64("id"), n)


def _block(n, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias(name)


def _bucket_pairs(asked: DataFrame, points: DataFrame, bands: dict[int, Band]) -> DataFrame:
    """Blocks of queries and candidates of the same buckets."""
    cands = written(_codes(points.where(F.col("g").isin(list(bands))).select("id", "v", "g"), bands, False), "anncands")
    asks = written(_codes(asked, bands, True), "annasks")
    sizes = (cands.groupBy("t", "b").agg(F.expr(f"(count(*) + {CANDIDATE_BLOCK - 1}) div {CANDIDATE_BLOCK}").alias("cb"))
             .join(asks.groupBy("t", "b").agg(F.expr(f"(count(*) + {QUERY_BLOCK - 1}) div {QUERY_BLOCK}").alias("qb")), ["t", "b"]))
    sizes = written(sizes, "annsizes")
    left = asks.join(sizes, ["t", "b"]).select("t", "b", "id", "v", _own(F.col("qb")).alias("q"), F.lit(0).alias("kind"), _block(F.col("cb"), "c"))
    right = cands.join(sizes, ["t", "b"]).select("t", "b", "id", "v", _block(F.col("qb"), "q"), F.lit(1).alias("kind"), _own(F.col("cb")).alias("c"))
    return left.unionByName(right)


def _all_pairs(asked: DataFrame, points: DataFrame, n_points: int) -> DataFrame:
    """Blocks of all queries and all candidates."""
    n_asked = asked.count()
    qb, cb = (F.lit(max(1, -(-n // size))).cast("long") for n, size in ((n_asked, QUERY_BLOCK), (n_points, CANDIDATE_BLOCK)))
    t, b = F.lit(-1).alias("t"), F.lit(0).cast("long").alias("b")
    left = asked.select(t, b, "id", "v", _own(qb).alias("q"), F.lit(0).alias("kind"), _block(cb, "c"))
    right = points.where(F.lit(n_asked > 0)).select(t, b, "id", "v", _block(qb, "q"), F.lit(1).alias("kind"), _own(cb).alias("c"))
    return left.unionByName(right)


def _ranked(groups: list[DataFrame], k: int) -> DataFrame:
    both = functools.reduce(DataFrame.unionByName, groups).repartition("t", "b", "q", "c").sortWithinPartitions("t", "b", "q", "c", "kind")
    # The found are few per query and block; rows of a group arrive together, so a block's best are given when the next begins.
    found = both.mapInArrow(_scored(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scored(k: int):
    def give(best: _Best) -> pa.RecordBatch:
        each = [len(x) for x in best.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.q, each)), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))],
                                          names=["query_id", "vec_id", "score"])

    def run(batches):
        key, waiting, best = None, ([], []), None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "b", "q", "c", "kind", "id")]
            vectors = batch.column("v")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            edges = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols[:5]], axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, len(batch)]):
                now = tuple(int(x[a]) for x in cols[:4])
                if now != key:
                    if best is not None:
                        yield give(best)
                    key, waiting, best = now, ([], []), None
                if cols[4][a] == 0:
                    waiting[0].append(cols[5][a:b])
                    waiting[1].append(flat[a:b])
                elif waiting[0]:
                    if best is None:
                        best = _Best(np.concatenate(waiting[0]), np.concatenate(waiting[1]), k)
                    best.add(cols[5][a:b], flat[a:b].astype(np.float64))
        if best is not None:
            yield give(best)
    return run
