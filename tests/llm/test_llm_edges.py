"""Nulls in any column, empty and repeated rows, empty tables and extra
columns with names that the operators use themselves."""
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidewater.llm import langid, mixing, neardup, packing, quality, secrets, substrings, toxicity, urlfilter
from tidewater.llm.common import tune

CLASH = ["size", "key", "uid", "n", "label", "h", "root", "node", "piece", "length", "kept", "id", "w", "copy", "target", "place", "tk", "start", "pid", "kind"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 4000}x{i}" for i in range(60000)) + " token=abcdefgh12345678"


@pytest.fixture(scope="module")
def odd(spark):
    tune(spark)
    prose = "the quick brown fox jumps over the lazy dog and runs away from it"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (None, prose, "en", None, 9), (None, prose + " again", None, "a", None),
            (None, None, None, None, None), (4, prose, "en", "a", 1), (4, prose, "en", "a", 1), (4, "other words of the same id", "en", "b", 1), (5, LONG, "de", "a", 1),
            (6, "x", "en", "é", 1), (7, "É x \x1c y\x85z", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


def labels(spark):
    return spark.createDataFrame([(4, 1, 1), (5, 0, None), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "secrets": lambda s, d: secrets.scan(d),
    "substrings": lambda s, d: substrings.deduplicated(d),
    "langid": lambda s, d: langid.identify(d),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
    "packing": lambda s, d: packing.pack_documents(d),
    "quality": lambda s, d: quality.judge(d),
    "mixing": lambda s, d: mixing.mixed_sizes(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, name):
    got = OPERATORS[name](spark, odd).collect()
    whole = [r for r in got if name != "packing" or r["piece"] == 0]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in whole) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.select("doc_id").collect())
    empty = OPERATORS[name](spark, odd.limit(0))
    assert empty.collect() == [] and empty.columns == OPERATORS[name](spark, odd).columns


def test_repeated_and_null_ids(spark, odd):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()]
    # Both rows of 4 with the prose, and its copy without an id, are one group; the smallest id names it.
    assert got.count((4, 10, 4, True)) == 2 and (None, 10, 4, False) in got and (1, 0, 1, True) in got and (None, 0, None, True) in got
    stay = [(r["doc_id"], r["text"]) for r in neardup.one_of_each(odd).collect()]
    assert sum(t is not None and t.endswith("from it") for _, t in stay) == 1 and (4, "other words of the same id") in stay
    assert sum(t is None for _, t in stay) == 2 and len(stay) == len(odd.collect()) - 3


@pytest.mark.parametrize("stage", [n for n, _ in P.STAGES])
def test_stages(spark, odd, stage):
    fn = dict(P.STAGES)[stage]
    out = fn(spark, odd, "/nowhere")
    rows = out.collect()
    if stage != "packing":
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        for r in rows:
            assert all(r[c] == f"own {c}" for c in CLASH)
            if stage in ("quality", "secrets", "mixing"):
                assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    if stage == "secrets":
        assert len(rows) == len(odd.collect()) and any(r["text"] and r["text"].endswith(" " + secrets.MARK) for r in rows)
    assert fn(spark, odd.limit(0), "/nowhere").collect() == []


def test_pages(spark):
    tune(spark)
    pages = spark.createDataFrame([(1, None), (None, "http://a.net/"), (1, "http://a.net/"), (2, "")], "page_id long, url string")
    pages = pages.select("*", *[F.lit("own").alias(c) for c in ("host", "path", "rule", "verdict", "uid", "labels", "top")])
    rules = spark.createDataFrame([("net", "/", "block"), ("net", "/", "allow"), (None, "/", "block"), ("a.net", None, "allow")], "host string, path string, verdict string")
    got = sorted(map(str, [tuple(r) for r in urlfilter.judge(pages, rules).collect()]))
    assert got == sorted(map(str, [(1, "", "", None, "allow"), (None, "a.net", "/", "a.net", "allow"), (1, "a.net", "/", "a.net", "allow"), (2, "", "", None, "allow")]))


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path
    root = Path(P.__file__).parent
    for f in (root / "tidewater").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"tidewater\.llm|corpus_pipeline", f.read_text()), f
