"""Alignment of two tokenizers against the libraries and brute force."""
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import alignment
from tidewater.llm.common import table, tune
from tidewater.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # The byte-level alphabet: printable characters stand for themselves, the other bytes for 256 and on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    return a, b, byte_of


def tokens(libraries, text):
    """[(id, bytes)] of A and of B; both empty if a side does not give the text back."""
    a, b, byte_of = libraries
    if not text:
        return [], []
    side_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    side_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    want = (" " + text).encode()
    return (side_a, side_b) if all(b"".join(t for _, t in s) == want for s in (side_a, side_b)) else ([], [])


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(libraries, rows):
    found = []
    for doc, text in rows:
        a, b = map(spans, tokens(libraries, text))
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [([i for i, _, e in a if x < e <= y], [i for i, _, e in b if x < e <= y]) for x, y in zip([0, *cuts], cuts)] if len(a) < 400 else None
        links, k = [], 0
        for i, s, e in a:
            while k and b[k - 1][2] > s:
                k -= 1
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    links.append((i, b[k][0]))
                k += 1
        found.append((doc, a, b, cuts, groups, links))
    count = Counter(p for f in found for p in set(f[5]))
    most: dict = {}
    for (i, _), n in count.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for doc, a, b, cuts, groups, links in found:
        if groups is None:          # long texts: the same, walking once
            groups, x, y = [], iter(a), iter(b)
            for c in cuts:
                groups.append(([], []))
                for side, it in enumerate((x, y)):
                    for i, _, e in it:
                        groups[-1][side].append(i)
                        if e == c:
                            break
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((doc, len(a), len(b), len(cuts), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, count, most


def test_query_equals_brute_force(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op12_alignment"](spark, SF)
    assert got.dtypes == [(c, "string" if c == "groups_sha256" else "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")]
    want = brute(libraries, rows)[0]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and sum(w[1] > 0 for w in want) > 100


def odd_texts():
    rng = np.random.default_rng(5)
    yield from ["", " ", "  ", "a", " a", "a ", "a  b", "  a  ", "a\n b", "a \nb", "\n", "\t x", "x<|endoftext|> y <s> </s> <0x41>", "½ ² ٣ 中文 字 　 z", "é ́x ́", "▁a b", "a ▁ b", "a▁", "\x00 a\x00",
                "\x1c\x85 ​", "don't we'll", "A" * 300, "\U0001f600!! \U0001f600", "ﬁ① ẞ", "﻿x", "word, word. 12. x_, ,", "𝕏 ａ"]
    for _ in range(800):
        yield "".join(rng.choice(list("abé中1,. \n\t　'́▁<"), 12, p=[.16, .1, .04, .04, .05, .05, .05, .3, .07, .03, .03, .02, .03, .01, .02]))


def test_odd_texts(spark, libraries, monkeypatch):
    t = alignment.Tokenizers(alignment.RANKS_A, alignment.MODEL_B)
    texts = list(odd_texts())
    want = [tuple(np.array([i for i, _ in side], "<u4").tobytes() for side in tokens(libraries, x)) for x in texts]
    assert t.batch(texts) == want and sum(w[0] != b"" for w in want) > 500
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(alignment, "CACHE_CHARS", 4)
    assert [t.batch([x])[0] for x in texts] == want


def test_cuts_by_halves():
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 40, 300):
        for share in (0.0, 0.05, 0.5, 1.0):
            ends = np.arange(1, 4 * n + 1)
            both = ends[:-1][rng.random(4 * n - 1) < share]
            a, b = (np.unique(np.concatenate([both, ends[rng.random(4 * n) < 0.3], [4 * n]])) for _ in range(2))
            got = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
            assert a[got].tolist() == sorted(set(a.tolist()) & set(b.tolist()) - {4 * n})


def test_odd_rows(spark, libraries, monkeypatch, tmp):
    tune(spark)
    rows = [(1, None), (2, ""), (None, "no id here"), (None, None), (4, "same text"), (4, "same text"), (4, "other"), (5, "long " * 3000 + "中"), (6, "▁ lost"), *((100 + i, x) for i, x in enumerate(odd_texts()) if i < 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("batch", "pairs", "pair", "place", "n_a", "held", "best")])
    want, count, most = brute(libraries, rows)
    assert sorted(map(str, (tuple(r) for r in alignment.score(df).collect()))) == sorted(map(str, want))
    pairs = {(r["a"], r["b"]): (r["documents"], r["best"]) for r in alignment.pair_table(df).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in count.items()}
    listed = [r["groups"] for r in alignment.groups(df).collect() if r["groups"]]
    texts = sorted(";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in x) for x in listed)
    assert sorted(hashlib.sha256(x.encode()).hexdigest() for x in texts) == sorted(w[-1] for w in want if w[-1])
    assert alignment.score(df.limit(0)).collect() == [] and alignment.score(df.limit(0)).columns == alignment.score(df).columns


def test_many_batches(spark, libraries):
    """Counts run over all batches of the corpus, however texts are dealt."""
    rows = [(i, f"shared words and number {i % 7} of {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert sorted(tuple(r) for r in alignment.score(df).collect()) == sorted(brute(libraries, rows)[0])
