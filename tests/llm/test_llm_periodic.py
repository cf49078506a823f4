"""Runs and collapsed texts against brute force."""
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import periodic
from tidewater.llm.common import table, tune
from tidewater.llm.queries import QUERIES
from tidewater.llm.words import WordHash

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=12):
    """Every period by itself: stretches of words that equal those q before."""
    ids: dict = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words])
    best: dict = {}
    for q in range(1, len(x) // 2 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(np.int8)
        for a, b in np.flatnonzero(np.diff(same)).reshape(-1, 2).tolist():
            if b - a + q >= max(least, 2 * q):
                best.setdefault((a, b + q), q)          # the smallest period comes first
    return sorted((a, b - a, q) for (a, b), q in best.items())


def brute_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def brute_lyndon(x):
    n = len(x)
    return [next((j for j in range(i + 1, n + 1) if x[j:] < x[i:]), n) - i for i in range(n)]


def sequences():
    rng = np.random.default_rng(11)
    yield []
    yield [0]
    yield [0] * 40
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 140:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]
    yield [bin(i).count("1") % 2 for i in range(200)]       # Thue-Morse
    for kinds in (1, 2, 2, 2, 3, 5, 40):
        for n in (1, 2, 11, 12, 13, 30, 90, 250):
            yield rng.integers(0, kinds, n).tolist()
    for _ in range(60):
        root = rng.integers(0, 6, rng.integers(1, 25)).tolist()
        part = (root * 9)[:int(rng.integers(12, 120))]
        yield rng.integers(0, 6, 20).tolist() + part + rng.integers(0, 6, 20).tolist() + part + root


def test_lyndon_arrays():
    for x in sequences():
        count = max(x, default=-1) + 1
        for y in (x, [count - 1 - v for v in x]):
            assert periodic.lyndon(y, count) == brute_lyndon(y), x


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_equal_brute_force(least):
    hashed = WordHash()
    for x in sequences():
        words = [b"w%d" % v for v in x]
        want = brute_runs(words, least)
        got = periodic.search(words, hashed, least)
        assert list(map(tuple, got.tolist())) == want, x
        assert periodic.kept_words(words, got) == brute_kept(words, want)


def expected(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(brute_kept(words, runs))))


def test_query_equals_brute_force(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
                          ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = sorted(expected(r["doc_id"], r["text"]) for r in rows)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sum(w[1] > 0 for w in want) > 10


def test_odd_rows(spark, tmp):
    tune(spark)
    loop = "é x \x1c y\x85z " * 5
    planted = next(i for i in range(10, 1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    big, plain = [i for i in range(10, 1000) if zlib.crc32(str(i).encode()) % 10][:2]
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, loop), (None, None), (4, loop), (4, loop), (5, "one"), (planted, "a b c d e f g h i j k l m n o p"), (planted, ""), (planted, None),
            (big, "w " * 30000 + "v " * 3), (plain, " ".join(f"u{i}" for i in range(30000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("runs", "n", "h", "w", "start", "collapsed")])
    df.write.parquet(f"{tmp}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, tmp).collect()
    want = [expected(*r) if (r[1] or "").count("w ") < 9 and len(r[1] or "") < 9999 else None for r in rows]
    assert sorted(map(str, (tuple(r) for r in got if r["doc_id"] not in (big, plain)))) == sorted(map(str, (w for w in want if w)))
    by = {r["doc_id"]: tuple(r)[1:6] for r in got}
    assert by[big] == (1, 0, 30000, 1, 30000000) and by[plain] == (0, None, None, None, None)
    assert periodic.digests(periodic.find(df.limit(0))).collect() == []
