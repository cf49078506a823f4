"""Token files against the tokenizer library, and the files themselves."""
import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import tokenfile
from tidewater.llm.common import table, tune
from tidewater.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokenfile.TOKENIZER))


def expected(library, rows):
    """(doc_id, start, n_tokens, crc) of rows already in file order."""
    at, out = 0, []
    for doc, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [tokenfile.END_ID], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_equals_the_library(spark, library):
    rows = sorted((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    got = QUERIES["op13_token_output"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == expected(library, rows)


def test_chunks_equal_whole_texts(library, monkeypatch):
    own = tokenfile.Encoder(tokenfile.TOKENIZER)
    odd = ["", " ", "a  b\n\n  c\t", "don't we'll I'M", "x<|endoftext|> y <|startoftext|>z", "½ ² ٣ 中文 字  　 z", "é ́x ́", "\x1c\x85 ​\x0b\x0c a",
           "ΑΣ Σ ΌΣΟΣ İ ẞ", "'s't're 123abc_4", "a" * 300, "\U0001f600!!", "b" * 80 + " " + "b" * 80]
    rng = np.random.default_rng(3)
    odd += ["ÀÉÎÕÜ ÇŠŽa ßẞ İx ŉa ſb ×÷ æŒ'S Ÿ2 ªº µ²½", "É's Ül. ñ|>", "".join(map(chr, range(0xA1, 0x250))), " ".join(map(chr, range(0xA1, 0x250)))]
    odd += ["".join(rng.choice([*"aZ1.' ", *map(chr, range(0xC0, 0x180))], 10)) for _ in range(1500)]
    odd += ["".join(rng.choice(list("abZ1,. \n\t　'́é"), 14)) for _ in range(1500)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert [own(t.encode()) for t in odd] == want
    monkeypatch.setattr(tokenfile, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(tokenfile, "CACHE_PARTS", 5)
    assert [own(t.encode()) for t in odd] == want and own(None) == b""


def test_odd_rows(spark, library, tmp):
    tune(spark)
    long = " ".join(f"word{i % 4000}x{i}" for i in range(40000))
    docs = [(3, "two words"), (3, "two words"), (3, None), (3, "other"), (None, "no id"), (None, None), (-5, ""), (10**12, long), (7, "x")] + [(9, f"hot {i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in ("part", "start", "ids", "_h", "base", "n_tokens")])
    folder = tokenfile.write(df, f"{tmp}/tokens")
    got = [tuple(r) for r in tokenfile.digests(tokenfile.read(spark, folder)).orderBy("start").collect()]
    # Ascending ids, null first; the order among equal ids is that of a hash of the text.
    assert [g[0] for g in got] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d))
    assert [g[1] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(e[0]), e[2], e[3]) for e in expected(library, docs))
    hot = [r[0] for r in tokenfile.parts(spark, folder).where("first_doc <= 9 and last_doc >= 9").select("documents").collect()]
    assert len(hot) > 3                                     # a frequent id fills several files
    none = tokenfile.write(df.limit(0), f"{tmp}/none")
    assert tokenfile.digests(tokenfile.read(spark, none)).collect() == [] and tokenfile.read_span(spark, none, 0, 5).collect() == []


def test_files_and_selective_reads(spark, tmp):
    docs = table(spark, SF, "documents")
    folder = tokenfile.write(docs.repartition(3), f"{tmp}/tokens", row_group_bytes=256 << 10, page_bytes=8 << 10, page_rows=10)
    groups = 0
    for f in glob.glob(f"{folder}/ids/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(v for k, v in columns.items() if k.startswith("ids"))
            assert any("DICTIONARY" in e for e in ids.encodings) and ids.has_offset_index
            for name in ("doc_id", "start", "n_tokens"):
                assert columns[name].encodings == ("DELTA_BINARY_PACKED",) and columns[name].has_column_index and columns[name].has_offset_index
    assert groups >= 3
    rows = tokenfile.read(spark, folder)
    plan = rows.select("doc_id", "n_tokens").where("doc_id = 17")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1] and "EqualTo(doc_id,17)" in plan
    stream = [i for r in rows.orderBy("start").collect() for i in r["ids"]]
    for first, last in [(0, 1), (0, len(stream)), (5, 5), (1000, 30000), (len(stream) - 3, len(stream) + 9), (len(stream), len(stream) + 5)]:
        span = tokenfile.read_span(spark, folder, first, last).orderBy("start").collect()
        assert [i for r in span for i in r["ids"]] == stream[first:last]
        assert all(r["n_tokens"] == len(r["ids"]) for r in span) and (not span or span[0]["start"] == first)
