import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vellum.llm import packing
from vellum.llm.queries import tokenizer_path

TEXTS = [None, "", "hello world", "It's 12345 éÜ ß STRASSE naïve— (x) a.b,c!! ###", "a\tb\r\nc d e\x0bf\x0cg\x1ch", "<|endoftext|> x<|startoftext|>y", "word " * 9000, "x" * 3000, "e ́ ̀ 日本語 😀 don't we'll", "''' \"quoted\" -- ...", "İstanbul ΑΒΓς K Å"]


def test_round_trip(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (2, "hello world")]
    got = packing.pack(docs_of(rows), tokenizer_path(), with_ids=True).collect()
    t = Tokenizer.from_file(tokenizer_path())
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    by = {}
    for r in got:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["length"] == 1 << r["bucket"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by[i], key=lambda r: r["start"])
        if i == 2:
            own = own[::2]
        assert [x for r in own for x in r["ids"]] == want and all(r["doc_tokens"] == len(want) for r in own)
        assert [r["start"] for r in own] == np.concatenate([[0], np.cumsum([r["length"] for r in own])])[:-1].tolist()


def test_supplied_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((r["doc_id"], len(t.encode(r["text"], add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = packing.pack(docs, tokenizer_path()).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, got)) == want


def test_empty(spark, docs_of):
    assert packing.pack(docs_of([(1, "x")]).limit(0), tokenizer_path()).count() == 0
    assert packing.pieces(0) == [] and packing.pieces(4097) == [(0, 2048), (2048, 2048), (4096, 1)]


@pytest.mark.parametrize("at_once", [1, 2, 9000, 500_000])
def test_texts_gathered_together(monkeypatch, at_once):
    """Wherever the words gathered together are cut, every text keeps its own ids."""
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", at_once)
    texts = [None, "", *TEXTS, "", "a b", None, " ", "c"]
    t = Tokenizer.from_file(tokenizer_path())
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    encoder = packing.WordTokens(tokenizer_path())
    sliced = pa.array(["x y", *texts]).slice(1)
    assert list(encoder.encode_all(sliced)) == want and list(encoder.encode_all(pa.array([None, ""]))) == [b"", b""]
    assert list(encoder.encode_all(pa.array([], pa.string()))) == []
