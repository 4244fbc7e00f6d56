"""The stages one by one against brute-force versions of their decisions."""

from collections import Counter

import duckdb

import corpus_pipeline as c
from manylabel.llm import bpe_words, registry
from manylabel.llm.common import table

from . import test_bpe_words, test_jaccard_join, test_line_dedup
from .helpers import SCHEMA


def by_sql(name, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}'")
    return con.execute(registry.SQL[name]).df()


def test_stages(spark, sf, tmp_path):
    docs, names = table(spark, sf, "documents"), [f.name for f in table(spark, sf, "documents").schema]
    out = {}
    for name, stage in c.STAGES:
        d = stage(spark, docs, sf)
        if name != c.STAGES[-1][0]:
            assert d.columns == names
        d.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = docs.collect()
    quality, lines, near, mixed, tokens = (out[n] for n, _ in c.STAGES)
    assert 0 < len(near) < len(quality) == len(lines)
    verdicts = by_sql("op7_quality_rules", f"{sf}/documents.parquet")
    assert {r["doc_id"] for r in quality} == set(verdicts[verdicts["kept"]]["doc_id"])
    dropped = test_line_dedup.brute([(r["doc_id"], r["text"]) for r in quality])
    assert Counter((r["doc_id"], r["text"]) for r in lines) == Counter((i, t) for i, _, _, t in dropped)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    classes = test_jaccard_join.brute([(r["doc_id"], r["text"]) for r in lines], 5, 4, 5)
    assert {r["doc_id"] for r in near} == {i for i, _, least in classes if i == least}
    copies = by_sql("op8_poisson_mixing", f"{tmp_path / 'n-gram Jaccard join'}/*.parquet")
    assert Counter(r["doc_id"] for r in mixed) == Counter(copies["doc_id"])
    texts_ = {r["doc_id"]: r["text"] for r in near}
    assert all(r["text"] == texts_[r["doc_id"]] for r in mixed)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe_words.default_vocabulary())
    tok.no_truncation()
    want = test_bpe_words.want(tok, [(r["doc_id"], r["text"]) for r in mixed])
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"]) for r in tokens) == want
    whole = c.run(spark, sf).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in whole) == Counter((r["doc_id"], tuple(r["ids"])) for r in tokens)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0
