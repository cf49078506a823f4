"""Near-duplicate groups by fast similarity sketching, banding and exact
verification.

A document's set is its distinct word shingles.  The sketch has T
coordinates, filled in rounds: in a round every shingle is hashed to one
coordinate with a value above all values of earlier rounds, and each
coordinate keeps its smallest; after T such rounds, T more send all shingles
to one coordinate each, so that every coordinate is filled.  Two sets agree
in a coordinate with the probability of their similarity, and the number of
agreements is concentrated about its mean.  ROWS coordinates of 16 bits make
a band; sets that share a band meet.

Copies of one set are one class, so pairs are between class
representatives.  Sets that meet are linked without listing all pairs: every
member is compared with its bucket's smallest member; components of the
confirmed links follow; a second round takes another pivot for buckets that
still hold several components; only then are the remaining pairs between
different components looked at, in blocks, each in the first band it shares,
and listed where finer sketches of FINE coordinates agree in MIN_FINE.
Every link is confirmed on the full sets.

A pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^32 =
5e-8, agrees in less than MIN_AGREE coordinates with about 1e-8 and in less
than MIN_FINE with 3e-7 (five standard deviations).

Cases: null or empty text has an empty set and is its own component;
repeated rows fall in one class; of null ids the smallest other id counts,
or null if there is none; no rows give no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, seen_filter, written
from tidewater.llm.components import components
from tidewater.llm.words import WordHash, mixed, windows

T = 128
ROWS = 4
BANDS = T // ROWS
MIN_AGREE = 76
FINE = 1024
MIN_FINE = 755
PER_TASK = 64       # members compared with one copy of a pivot
BLOCK = 512         # members of a bucket that are compared in one block pair
VALUE_BITS = 52


@functools.lru_cache(maxsize=4)
def _seeds(t: int) -> np.ndarray:
    return np.random.default_rng(20260 + t).integers(0, 1 << 63, 2 * t, np.uint64) | np.uint64(1)


def sketch(items: np.ndarray, t: int = T) -> np.ndarray:
    """t (a power of two) coordinates of 16 bits of a non-empty set of 64-bit hashes."""
    none = np.iinfo(np.uint64).max
    best = np.full(t, none, np.uint64)
    low, bits = np.uint64((1 << VALUE_BITS) - 1), np.uint64(64 - (t.bit_length() - 1))
    for i, seed in enumerate(_seeds(t)):
        h = mixed(items ^ seed) * seed
        value = (np.uint64(i) << np.uint64(VALUE_BITS)) | ((h >> np.uint64(2)) & low)
        if i < t:
            np.minimum.at(best, (h >> bits).astype(np.intp), value)
        else:
            best[i - t] = min(best[i - t], value.min())
        if not (best == none).any():
            break
    return mixed(best * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint16)


def bands(items: np.ndarray) -> np.ndarray:
    return sketch(items).view(np.int64)


def shingles(text: str | None, words: WordHash, size: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; a shorter text is one shingle."""
    own = words.of((text or "").encode().lower().split())
    if not len(own):
        return own
    return np.unique(windows(own, min(size, len(own))))


def features(docs: DataFrame, size: int) -> DataFrame:
    def make():
        words = WordHash()

        def run(rows: dict) -> dict:
            sets = [shingles(t, words, size) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "tkey": rows["tkey"], "n": [len(s) for s in sets],
                    "fp1": [int(mixed(s).sum().view(np.int64)) if len(s) else 0 for s in sets],
                    "fp2": [int(mixed(mixed(s) + np.uint64(7)).sum().view(np.int64)) if len(s) else 0 for s in sets],
                    "bands": [bands(s) if len(s) else None for s in sets]}
        return run

    out = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text"), make,
                      "doc_id long, tkey long, n long, fp1 long, fp2 long, bands array<long>")
    return written(out.withColumn("uid", F.monotonically_increasing_id()), "sets")


def _agreement() -> F.Column:
    """Equal 16-bit coordinates of the arrays ``x`` and ``y``."""
    lanes = " + ".join(f"CAST((z & {0xFFFF << s}L) = 0L AS INT)" for s in (0, 16, 32))
    return F.expr(f"aggregate(zip_with(x, y, (p, q) -> p ^ q), 0, (n, z) -> n + {lanes} + CAST(shiftrightunsigned(z, 48) = 0L AS INT))")


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches agree in MIN_AGREE coordinates."""
    x = classes.select(F.col("node").alias("a"), F.col("bands").alias("x"))
    y = classes.select(F.col("node").alias("b"), F.col("bands").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(_agreement() >= MIN_AGREE).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 |A and B| >= percent |A or B|, on full sets.

    The members b of a pivot a are split into groups of about PER_TASK; each
    group gets a copy of the pivot's text, and a task holds one pivot's set
    at a time.
    """
    pairs = written(pairs, "pairs")
    pivots = written(pairs.groupBy("a").agg(F.expr(f"(count(*) + {PER_TASK - 1}) div {PER_TASK}").alias("parts")), "pivots")
    members = pairs.join(pivots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("node"), F.lit(1).alias("kind"))
    heads = pivots.select("a", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("a").alias("node"), F.lit(0).alias("kind"))
    rows = (heads.unionByName(members).join(texts, "node")
            .repartition("a", "part").sortWithinPartitions("a", "part", "kind"))

    def make():
        words = WordHash()
        state: dict = {"pivot": None}

        def run(batch: dict) -> dict:
            out: dict = {"a": [], "b": []}
            for a, part, node, kind, text in zip(batch["a"], batch["part"], batch["node"], batch["kind"], batch["text"]):
                own = shingles(text, words, size)
                if kind == 0:
                    state["pivot"], state["set"] = (a, part), own
                    continue
                assert state["pivot"] == (a, part)
                other = state["set"]
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    out["a"].append(a)
                    out["b"].append(node)
            return out
        return run

    return written(map_batches(rows.select("a", "part", "node", "kind", "text"), make, "a long, b long"), "links")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several roots: (k, node, root, n, pivot)."""
    m = members.join(roots, "node", "left").select("k", "node", "band", F.coalesce("root", "node").alias("root"))
    m = written(m, "labelled")
    mixed_ = written(m.groupBy("k").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n"),
                                        F.min_by("node", F.xxhash64("node")).alias("pivot")).where("r0 <> r1"), "mixed")
    return m.join(mixed_.select("k", "n", "pivot"), "k")


def _finer(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, fine): sketches of FINE coordinates of 8 bits of some nodes."""
    def make():
        words = WordHash()

        def run(batch: dict) -> dict:
            return {"node": batch["node"], "fine": [sketch(shingles(t, words, size), FINE).astype(np.uint8).tobytes() for t in batch["text"]]}
        return run

    return written(map_batches(texts.join(nodes.distinct(), "node", "left_semi").select("node", "text"), make, "node long, fine binary"), "fine")


def _block_pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Promising pairs of one pair of blocks (rows: own, i, j, band, node, root, bands, fine)."""
    own, i, j, band = (np.array([r[c] for r in rows]) for c in range(4))
    node, root = (np.array([r[c] for r in rows], np.int64) for c in (4, 5))
    keys = np.array([r[6] for r in rows], np.int64)
    fine = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), FINE)
    a, b = [], []
    for x in np.flatnonzero(own == i):
        later = np.arange(len(rows)) > x if i[x] == j[x] else own == j
        with_x = np.flatnonzero(later & (root != root[x]))
        if len(with_x):         # in the first band they share, and alike enough
            with_x = with_x[(keys[with_x] == keys[x]).argmax(axis=1) == band[x]]
            with_x = with_x[(fine[with_x] == fine[x]).sum(axis=1) >= MIN_FINE]
            a.append(np.minimum(node[x], node[with_x]))
            b.append(np.maximum(node[x], node[with_x]))
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _remaining(labelled: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """All pairs (a < b) of one bucket and different components that are
    promising.  A bucket of many members is cut into blocks of about BLOCK;
    each pair of blocks is its own group of rows."""
    fine = _finer(texts, labelled.select("node"), size)
    rows = labelled.withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = (rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
            .join(classes.select("node", "bands"), "node").join(fine, "node")
            .select("k", "own", "i", "j", "band", "node", "root", "bands", "fine")
            .repartition("k", "i", "j").sortWithinPartitions("k", "i", "j"))

    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(9))):
                if (row[0], row[2], row[3]) != key:
                    if len(held) > 1:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, _block_pairs(held))], names=["a", "b"])
                    key, held = (row[0], row[2], row[3]), []
                held.append(row[1:])
        if len(held) > 1:
            yield pa.RecordBatch.from_arrays([*map(pa.array, _block_pairs(held))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tkey (hash of the text), n_shingles, component_id, kept,
    n_class (rows with the same set) and group for every row."""
    feats = features(docs, shingle)
    key = ["n", "fp1", "fp2"]
    classes = (feats.where("n > 0").groupBy(*key)
               .agg(F.min("uid").alias("node"), F.min("doc_id").alias("min_id"), F.count("*").alias("n_class"),
                    F.min_by(F.struct("doc_id", "tkey"), F.col("uid")).alias("rep"), F.first("bands").alias("bands")))
    classes = written(classes, "classes")
    rows = classes.select("node", F.posexplode("bands").alias("band", "v")).select("node", "band", F.xxhash64("band", "v").alias("k"))
    shared = written(rows.groupBy("k").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("k", "lead"), "buckets")
    members = written(rows.join(shared, "k"), "members")
    reps = members.select("node").distinct().join(classes.select("node", "rep.doc_id", "rep.tkey"), "node")
    reps = written(reps.select("node", F.col("doc_id").alias("id"), "tkey"), "reps")
    # Rows with one id and one hash of the text: any of them has the text.  Few of the others' texts are moved.
    chosen = seen_filter(reps.select("tkey"), "chosen")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key")).where(chosen(F.col("key")))
             .join(reps, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("tkey"))).select("node", "text"))
    texts = written(texts.dropDuplicates(["node"]), "texts")
    links = confirmed(promising(members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), classes),
                      texts, shingle, percent)
    # Between the rounds it is enough to know a part of the components: each node's smallest confirmed pivot.
    near = written(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "near")
    second = _labelled(members, near)
    pivot_root = F.max(F.when(F.col("node") == F.col("pivot"), F.col("root"))).alias("pr")
    pivots = written(second.groupBy("k").agg(pivot_root), "pivotroots")
    pairs = second.join(pivots, "k").where("root <> pr").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = written(links.unionByName(confirmed(promising(pairs, classes), texts, shingle, percent)), "links")
    roots = written(components(links), "roots")
    last = confirmed(_remaining(_labelled(members, roots), classes, texts, shingle), texts, shingle, percent)
    if not last.isEmpty():
        roots = written(components(links.unionByName(last)), "roots")
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = written(named.groupBy("root").agg(F.min("min_id").alias("component_id")), "names")
    named = written(named.select(*key, "n_class", "root").join(ids, "root").select(*key, "n_class", "root", "component_id"), "named")
    out = feats.select("uid", "doc_id", "tkey", *key).join(named, key, "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "tkey", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.col("doc_id").eqNullSafe(comp).alias("kept"), F.coalesce("n_class", F.lit(1)).alias("n_class"),
                      F.coalesce("root", "uid").alias("group"))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The documents without all but one of each near-duplicate group: the
    row with the smallest id (null last) and hash of the text stays."""
    names = docs.columns
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("tkey").alias("key"))).alias("one")
    stay = near_duplicates(docs, **params).groupBy("group").agg(first)
    # Rows with one id and text are alike; as many of them stay as there are groups that chose them (several if without words).
    stay = written(stay.groupBy(F.col("one.id").alias("_tw_id"), F.col("one.key").alias("_tw_key")).agg(F.count("*").alias("_tw_many")), "stay")
    joined = docs.withColumn("_tw_text", F.xxhash64("text")).join(
        stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_tw_id")) & (F.col("_tw_text") == F.col("_tw_key")))
    nth = F.row_number().over(Window.partitionBy("_tw_id", "_tw_key").orderBy(F.lit(0)))
    return joined.withColumn("_tw_nth", nth).where("_tw_nth <= _tw_many").select(*names)
