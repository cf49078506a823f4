"""Near-duplicates, substrings and neighbours against brute force."""
import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import ann, neardup, substrings
from tidewater.llm.common import table, tune
from tidewater.llm.components import components
from tidewater.llm.words import WordHash, repeated_mask, windows

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain_sets(texts, n):
    out = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def plain_components(sets, percent=80):
    root = list(range(len(sets)))
    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            a, b = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * a >= percent * b:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def varied(rng, base, share):
    w = base.split()
    for i in np.flatnonzero(rng.random(len(w)) < share):
        w[i] = f"x{rng.integers(10 ** 6)}"
    return " ".join(w)


def prose(rng, n):
    return " ".join(f"w{k}" for k in rng.zipf(1.3, n) % 3000)


def grouped_texts():
    """Exact, near and borderline copies, chains, and one large group."""
    rng = np.random.default_rng(4)
    texts = [prose(rng, int(rng.integers(1, 120))) for _ in range(150)]
    for share in (0.01, 0.03, 0.05):
        base = prose(rng, 80)
        texts += [varied(rng, base, share) for _ in range(60)]
    chain = prose(rng, 100)
    for _ in range(12):
        chain = varied(rng, chain, 0.02)
        texts.append(chain)
    texts += texts[:20] + ["", None, " \n", "One two", "one TWO", "É x y z", "é x y z", "a b c d", "A B C D"]
    return texts


def test_components(spark):
    tune(spark)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(800))
    for _ in range(800):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {i: root[i] for e in edges if e[0] != e[1] for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        assert len(neardup.sketch(a)) == neardup.T and (neardup.sketch(a) == neardup.sketch(a[::-1].copy())).all()
    agree = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 300, np.uint64)
        agree.append((neardup.sketch(x[:250]) == neardup.sketch(x[50:])).mean())
    assert abs(np.mean(agree) - 200 / 300) < 0.02 and min(agree) > 0.5


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    tune(spark)
    texts = grouped_texts()
    ids = [1000 + int(i) for i in np.random.default_rng(8).permutation(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), DOCS)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, shingle=size).collect()}
    sets = plain_sets(texts, size)
    own = plain_components(sets)
    smallest = defaultdict(lambda: 10 ** 9)
    for i, r in enumerate(own):
        smallest[r] = min(smallest[r], ids[i])
    for i, doc in enumerate(ids):
        want = smallest[own[i]] if sets[i] else doc
        assert (got[doc]["n_shingles"], got[doc]["component_id"], got[doc]["kept"]) == (len(sets[i]), want, want == doc)
    stay = sorted(r["doc_id"] for r in neardup.one_of_each(docs, shingle=size).collect())
    assert stay == sorted(d for d in ids if got[d]["kept"])


def test_blocks_of_large_buckets(spark, monkeypatch):
    """Small blocks and task sizes give the same groups."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PER_TASK", 3)
    test_near_duplicates(spark, 4)


def plain_dedup(rows):
    """rows: (doc_id, text) -> list of (doc_id, n_words, n_removed, sha)."""
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        w = WORD.findall(rows[i][1] or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a:a + 20])
            if key in seen:
                gone[a:a + 20] = [True] * 20
            seen.add(key)
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (rows[i][0], len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return [out[i] for i in range(len(rows))]


def passage_texts():
    rng = np.random.default_rng(9)
    shared = [prose(rng, n) for n in (19, 20, 21, 33, 60, 200)]
    texts = []
    for _ in range(150):
        parts = [prose(rng, int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            parts += [shared[int(rng.integers(6))], prose(rng, int(rng.integers(0, 30)))]
        texts.append("\n".join(parts))
    texts += ["same " * 90, "same " * 45, "a b " * 40, "a b c " * 30, None, "", "short one"] + texts[:15]
    return texts


@pytest.mark.parametrize("salted", [False, True])
def test_substrings(spark, monkeypatch, salted):
    tune(spark)
    if salted:      # all anchors are split
        monkeypatch.setattr(substrings, "SAMPLE", 1)
        monkeypatch.setattr(substrings, "FREQUENT", 1)
    texts = passage_texts()
    rows = [((37 * i) % 1000 if i != 5 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    got = substrings.deduplicated(docs, with_text=True).collect()
    assert sorted(map(str, [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got])) == sorted(map(str, plain_dedup(rows)))
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    for r in got:       # every factor is a copy of what it refers to
        assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]
        for f in r["factors"]:
            n = f["words"]
            assert n >= 20 and words[r["doc_id"]][f["start"]:f["start"] + n] == words[f["ref_doc"]][f["ref_start"]:f["ref_start"] + n]


def test_substrings_of_the_table(spark):
    docs = table(spark, SF, "documents")
    got = substrings.deduplicated(docs).drop("factors").collect()
    assert sorted(map(tuple, got)) == sorted(plain_dedup([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_repeated_rows(spark):
    """Of two rows with one id and text the second is a copy."""
    tune(spark)
    long, short = " ".join(f"q{i}" for i in range(30)), "few words"
    docs = spark.createDataFrame([(1, long), (1, long), (2, short), (2, short), (3, long)], DOCS)
    got = sorted((r["doc_id"], r["n_removed"]) for r in substrings.deduplicated(docs).collect())
    assert got == [(1, 0), (1, 30), (2, 0), (2, 0), (3, 30)]


def test_words():
    h = WordHash()
    w = [b"a", b"b", b"c", b"a", b"b", b"c", b"d"]
    keys = windows(h.of(w), 3)
    assert keys[0] == keys[3] and len(set(keys.tolist())) == 4 and len(windows(h.of(w), 8)) == 0
    assert repeated_mask(h.of(w), 3).tolist() == [True] * 6 + [False]
    for size in (1, 2, 5, 7, 20):
        x = h.of([f"{i}".encode() for i in range(60)] * 2)
        k = windows(x, size)
        assert len(k) == 121 - size and (k[:60 - size + 1] == k[60:]).all()


def plain_nearest(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ ok[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def as_lists(found):
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(by[r["query_id"]]) + 1
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    return by


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_nearest_recall(spark, monkeypatch, bucket_rows):
    rows = table(spark, "/root/testdata/sf0.01", "embeddings")
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 16)
    got = as_lists(ann.nearest(rows.where("vec_id % 20 = 0"), rows, bucket_rows=bucket_rows).collect())
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in rows.collect()], 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    recall = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want])
    assert recall >= (0.93 if bucket_rows > 2 else 0.75)
    truth = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    assert all(abs(s - truth[q] @ truth[v]) < 1e-12 for q in got for v, s in got[q])


def test_nearest_hashes_given_tables(spark, monkeypatch):
    """With the query's own parameters all rows of the given tables go
    through the hash tables, and the recall holds."""
    from tidewater.llm.queries import QUERIES
    seen = []
    real = ann._codes
    monkeypatch.setattr(ann, "_codes", lambda rows, bands, query: seen.append((query, rows.count())) or real(rows, bands, query))
    for sf in ("sf0.01", "sf0.1"):
        rows = table(spark, f"/root/testdata/{sf}", "embeddings")
        got = as_lists(QUERIES["op4_nearest"](spark, f"/root/testdata/{sf}").collect())
        want = plain_nearest([(r["vec_id"], r["embedding"]) for r in rows.collect()], 20)
        assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
        assert recall_of(got, want) >= 0.9
        n = rows.count()
        assert seen[-2:] == [(False, n), (True, len(want))]


def test_nearest_odd_rows(spark):
    tune(spark)
    rng = np.random.default_rng(1)
    some = [(i, rng.normal(0, 1 + i % 7, 8).tolist()) for i in range(60)]
    same = [(100 + i, [1.0] * 8) for i in range(60)]       # one vector many times: ties go to small ids
    odd = [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (241, [None] * 8), (260, [1.0] * 5), (None, [1.0] * 8), (261, []), (20, some[20][1])]
    rows = spark.createDataFrame(some + same + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("t", F.lit(1))
    got = as_lists(ann.nearest(rows.where("vec_id % 20 = 0"), rows, k=20, probes=600).collect())
    want = plain_nearest(some + same, 20)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    few = spark.createDataFrame(some[:5] + [(20, some[20][1])], "vec_id long, embedding array<double>")
    assert {q: len(x) for q, x in as_lists(ann.nearest(few.where("vec_id % 20 = 0"), few).collect()).items()} == {0: 5, 20: 5}
    assert ann.nearest(few.limit(0), few.limit(0)).count() == 0 and ann.nearest(few.limit(0), few).count() == 0


def with_norms(spark, kind):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    rng = np.random.default_rng(2)
    norms = {"lognormal": np.exp(rng.normal(0, 0.5, len(rows))), "wide": np.exp(rng.normal(0, 1, len(rows))),
             "one long": np.where(np.arange(len(rows)) == 7, 20.0, 1.0), "two": np.where(np.arange(len(rows)) % 10 == 0, 3.0, 1.0)}[kind]
    return [(i, (v * f).tolist()) for (i, v), f in zip(rows, norms)]


def recall_of(got, want, k=20):
    return np.mean([len({a for a, _ in got.get(q, [])} & {a for a, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("kind", ["lognormal", "wide", "one long", "two"])
def test_nearest_unequal_norms(spark, kind):
    """Production probes; bands of more than 16 rows are hashed."""
    rows = with_norms(spark, kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = as_lists(ann.nearest(df.where("vec_id % 20 = 0"), df, bucket_rows=16).collect())
    want = plain_nearest(rows, 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert recall_of(got, want) >= 0.9


@pytest.mark.parametrize("n, bucket_rows", [(25, 4096), (40, 4096), (25, 1), (300, 4096)])
def test_nearest_small_tables(spark, n, bucket_rows):
    """All neighbours, by rows scored one by one; of 25 rows hashed, as many as there are."""
    rows = [(i * 10, v) for i, (_, v) in enumerate(with_norms(spark, "one long")[:n])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = as_lists(ann.nearest(df.where("vec_id % 20 = 0"), df, k=24, bucket_rows=bucket_rows).collect())
    want = plain_nearest(rows, 24)
    assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_nearest_repeated_rows(spark):
    """Rows with one id and vector take one of the k places; other ids of that vector keep theirs."""
    rows = [(i, [1.0, float(i)]) for i in range(30)] + [(29, [1.0, 29.0])] * 40 + [(100 + i, [1.0, 29.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = as_lists(ann.nearest(df.where("vec_id = 20"), df, k=10).collect())
    assert [v for v, _ in got[20]] == [29, 100, 101, 102, 103, 104, 28, 27, 26, 25]


@pytest.mark.parametrize("bucket_rows, axes", [(4, [128, 1]), (2, [128, 2]), (0.2, [128, 32]), (0.06, [128, 128])])
def test_nearest_joined_polytopes(spark, bucket_rows, axes):
    """Production probes of the form that large tables take."""
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    assert ann.shape(64, rows.count(), bucket_rows)[1] == axes
    got = as_lists(ann.nearest(rows.where("vec_id % 20 = 0"), rows, bucket_rows=bucket_rows).collect())
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in rows.collect()], 20)
    assert all(len(x) == 20 for x in got.values()) and recall_of(got, want) >= 0.9


def test_null_ids_with_alike_hashes(spark):
    """Rows without an id whose texts share half of their hash stay apart."""
    import xxhash
    tune(spark)
    seen: dict = {}
    for i in range(400_000):
        text = " ".join(f"w{i}x{k}" for k in range(24))
        other = seen.setdefault(xxhash.xxh64_intdigest(text.encode(), seed=42) >> 32, text)
        if other != text:
            break
    assert other != text
    rows = spark.createDataFrame([(None, other), (None, text), (None, text), (1, "short")], "doc_id long, text string")
    got = sorted((r["n_words"], r["n_removed"]) for r in substrings.deduplicated(rows).collect())
    assert got == [(1, 0), (24, 0), (24, 0), (24, 24)]
