"""Language and toxicity on held-out documents, and plain cases of each."""
import zlib

import numpy as np
import pytest

from tidewater.llm import langid, toxicity
from tidewater.llm.common import table, tune

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def auc(score, y):
    score, y = np.array(score), np.array(y)
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    for s in np.unique(score):
        rank[score == s] = 0
    sorted_ = score[order]
    rank = np.searchsorted(sorted_, score, "left") + (np.searchsorted(sorted_, score, "right") - np.searchsorted(sorted_, score, "left") + 1) / 2
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_language(spark, docs):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(got) == set(truth)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [d for d in truth if got[d]["held_out"]]
    assert np.mean([got[d]["lang_pred"] == truth[d] for d in held]) >= 0.95
    assert np.mean([got[d]["rejected"] for d in held]) < 0.05


def test_language_cases(spark):
    tune(spark)
    en, de = "the cat and the dog went to the town", "der hund und die katze sind in der stadt"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "123 !?", "de"), (103, "中文字", None), (None, de, "de"), (3, en + " 3", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[d]["lang_pred"] == "und" and by[d]["score"] == 0 for d in (100, 101, 102))
    assert by[103]["lang_pred"] in ("en", "de") and by[103]["rejected"]
    assert by[None]["lang_pred"] == "de" and by[None]["held_out"] is False
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(40))
    none = langid.identify(docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and langid.identify(docs.limit(0)).count() == 0


def test_grams_by_hand():
    a = langid.grams("Ab--c\n")
    # blank a b blank c blank: 6 single, 5 pairs, 4 triples
    assert len(a) == 6 + 5 + 4 and (langid.grams("  aB c!") == a).all() and langid.grams("12 €") is None


def test_toxicity(spark, docs):
    labels = table(spark, SF, "labels")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels).collect()}
    known = [(r["doc_id"], r["toxic"]) for r in labels.collect() if r["doc_id"] in got]
    held = [(got[d]["score"], t) for d, t in known if got[d]["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    # Nine toxic held-out documents here; 0.99 and more on larger tables.
    assert auc(*zip(*held)) >= 0.8
    assert np.mean([(s >= 0.5) == bool(t) for s, t in held]) >= 0.9


def test_toxicity_learns_from_unlabelled():
    rng = np.random.default_rng(0)
    doc = lambda bad: {f"w{k}" for k in rng.zipf(1.3, 60) % 500} | ({f"{k}bad" for k in rng.integers(0, 8, 3)} if bad else set())
    model = toxicity.fit([toxicity.features(doc(True)) for _ in range(300)], [toxicity.features(doc(rng.random() < 0.1)) for _ in range(900)], 0.1)
    assert np.mean([model.score(" ".join(doc(True))) >= 0.5 for _ in range(200)]) > 0.95
    assert np.mean([model.score(" ".join(doc(False))) < 0.5 for _ in range(200)]) > 0.97
    # A step of the risk: the bracket counts only while it is not negative.
    z, p = np.array([2.0, -1.0, 0.5]), np.array([True, False, False])
    s = 1 / (1 + np.exp(-z))
    risk = lambda z: 0.3 * (1 / (1 + np.exp(z[0]))) + max(0, (1 / (1 + np.exp(-z[1:]))).mean() - 0.3 / (1 + np.exp(-z[0])))
    num = [(risk(z + e) - risk(z - e)) / 2e-5 for e in 1e-5 * np.eye(3)]
    assert np.allclose(toxicity._risk_slopes(z, p, 0.3), num, atol=1e-6) and s.shape == (3,)


def test_toxicity_cases(spark):
    tune(spark)
    rows = [(i, ("you awful %s thing" if i % 3 == 0 else "a kind %s thing") % "xyz"[i % 2]) for i in range(60)] + [(100, None), (101, ""), (None, "awful"), (6, "you awful x thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == int(i % 3 == 0) for i in range(60)) and by[100]["score"] == by[101]["score"] < 0.5
    assert {r["predicted"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_of_alike_texts():
    """Confirmed texts that are near copies of each other still teach."""
    alike = [f"you utter fool go away and never come back here number{i}" for i in range(20)]
    plain = [f"the garden number{i} has {i % 7} trees and a path to the water" for i in range(80)]
    model = toxicity.fit([toxicity.features(toxicity.words(t)) for t in alike], [toxicity.features(toxicity.words(t)) for t in plain + alike[:2]], 0.1)
    assert model.weight and all(model.score(t) >= 0.5 for t in alike) and all(model.score(t) < 0.5 for t in plain)
