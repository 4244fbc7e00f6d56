import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from manylabel.llm import bpe_words as b

from .helpers import SCHEMA, documents, texts, write


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(b.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def want(tok, rows):
    out = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), tuple(ids), tok.decode(ids, skip_special_tokens=False)))
    return Counter(out)


def got(d):
    return Counter((r["id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in d.collect())


@pytest.mark.parametrize("rows", [10_000, 3])
def test_odd_texts(spark, tok, monkeypatch, rows):
    monkeypatch.setattr(b, "BLOCK_ROWS", rows)
    assert got(b.encode_decode(documents(spark))) == want(tok, texts())


@pytest.mark.parametrize("rows", [10_000, 3])
def test_words_that_hold_nul(spark, tok, monkeypatch, rows):
    monkeypatch.setattr(b, "BLOCK_ROWS", rows)
    given = [(100, "a\0b"), (101, "\0"), (102, "!\0? x \0\0"), (103, "w" * 70_000), *texts()]
    d = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
    assert got(b.encode_decode(d)) == want(tok, given)


def test_whole_table(spark, sf, tok):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = {i: (n, digest(" ".join(map(str, ids))), digest(text)) for i, n, ids, text in want(tok, rows)}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in b.op9_bpe_words(spark, sf).collect()} == expected


def test_decode_join(spark):
    d = b.encode_decode(documents(spark))
    again = b.decode(d.select("id", "ids", "decoded").withColumnRenamed("decoded", "first"))
    assert all(r["first"] == r["decoded"] for r in again.collect())


def test_empty(spark, tmp_path):
    assert b.encode_decode(spark.createDataFrame([], SCHEMA)).count() == 0
    assert b.op9_bpe_words(spark, write(spark.createDataFrame([], SCHEMA), tmp_path)).count() == 0
