"""The pipeline's chained run against a plain chain over planted documents."""
import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline as P
from tidewater.llm import packing, secrets
from tidewater.llm.common import tune


def test_run(spark, tmp):
    """One source, so the mix takes every kept document once."""
    from tokenizers import Tokenizer
    tune(spark)
    body = [" ".join(f"{chr(97 + k % 26)}{chr(97 + i)}{chr(97 + k // 26)}" for k in range(60)) for i in range(26)]
    want = dict(enumerate(body))
    texts = {i: f"Subscribe NOW to page {i}\n{b}" for i, b in want.items()}    # the line is on most documents: cut
    texts[24], want[24] = body[24] + " token=abcdefgh12345678", f"{body[24]} {secrets.MARK}"
    texts[25], want[25] = body[25] + " é", body[25] + " é"
    texts[30] = body[0]                                                        # a copy once the line is cut
    texts[31] = body[1].rsplit(" ", 1)[0] + " another"                         # a near copy
    texts |= {32: "too few words", 33: None, 34: "again and " * 30}            # rejected
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    got = P.run(spark, tmp).collect()
    lib = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {i: lib.encode(t, add_special_tokens=False).ids + [0] for i, t in want.items()}
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        own = ids[r["doc_id"]]
        assert (r["start"], r["length"], r["ids_crc32"]) == (0, len(own), zlib.crc32(np.array(own, "<u4").tobytes())), r
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, at, n), (s2, at2, _) in zip(places, places[1:]):
        assert at2 == (at + n if s2 == s else 0)
    assert all(at + n <= 2048 for _, at, n in places)
