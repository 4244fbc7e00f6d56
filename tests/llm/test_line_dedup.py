import hashlib
import time
from collections import Counter, defaultdict

import pytest

from manylabel.llm import line_dedup as m

from ..compare import check
from .helpers import FOLD, SCHEMA, documents, texts


def test_equals_sql(spark, sf):
    check(spark, sf, m.op4_line_dedup, m.SQL["op4_line_dedup"])


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for n, (i, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add((i is not None, n if i is None else i))  # a row without id is a document
    top = {k: max(v)[1] if max(v)[0] else None for k, v in holders.items() if len(v) >= 3}
    top = {k: i for k, i in top.items() if i is not None}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("bits, broadcast", [(1 << 20, 1_000_000), (1 << 19, 0)])
def test_odd_texts(spark, monkeypatch, bits, broadcast):
    monkeypatch.setattr(m, "MAX_BROADCAST_IDS", broadcast)
    umlauts = "ÄÖÜäöü ß"  # eight code points, and more than twenty bytes in three of them
    more = [(30 + k, f"{umlauts}{umlauts}\n{umlauts}{umlauts}{umlauts}\n\x0b {umlauts}{umlauts}{umlauts}A") for k in range(4)]
    rows = texts() + more
    d = documents(spark).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    d = m.dedup_lines(d.withColumnRenamed("n_chars", "n_lines"), n_bits=bits)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in d.collect()) == brute(rows)
    assert set(d.columns) == {"doc_id", "text", "lang", "source", "n_lines", "n_dropped"}


def test_filters_lose_no_repeat(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    found = m.twice_seen(d, n_bits=1 << 20)
    docs = defaultdict(set)
    for r in d.collect():
        for k in m.keys_of(r["text"].encode()):
            docs[k].add(r["doc_id"])
    twice = [k for k, v in docs.items() if len(v) > 1]
    once = [k for k, v in docs.items() if len(v) == 1]
    assert m._has(found, m._bits(m._hashes(twice), 1 << 20)).all()
    assert m._has(found, m._bits(m._hashes(once), 1 << 20)).mean() < 0.01


def test_long_texts_take_linear_time(spark):
    """100,000 repeated lines in each of three documents, in seconds."""
    lines = [f"this is the repeated line number {i}" for i in range(100_000)]
    d = spark.createDataFrame([(k, "\n".join(lines)) for k in range(3)] + [(9, "a line that stays where it is")], "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in m.dedup_lines(d, n_bits=1 << 22).collect()}
    assert got == {0: (100_000, 100_000), 1: (100_000, 100_000), 2: (100_000, 0), 9: (1, 0)}
    assert time.time() - began < 60


def test_filters_merge_one_after_the_other():
    """A bit is twice seen if one task says so or two tasks have it once."""
    import pyarrow as pa

    rows = [(0, [1], [0]), (0, [2], [0]), (0, [3], [4]), (1, [8], [0])]
    batches = [pa.RecordBatch.from_pydict({"block": [b], "once": [bytes(o)], "twice": [bytes(t)]}) for b, o, t in rows]
    assert [(r["block"], r["twice"][0]) for b in m._merge(iter(batches)) for r in b.to_pylist()] == [(0, 7), (1, 0)]


def test_empty_table(spark):
    assert m.dedup_lines(spark.createDataFrame([], SCHEMA), n_bits=1 << 20).count() == 0


def test_digest_is_of_the_kept_text(spark, sf):
    r = m.op4_line_dedup(spark, sf).orderBy("doc_id").first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256().hexdigest())


LONG = "A line of more than twenty letters"


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_rows_without_id_are_documents(spark, monkeypatch, broadcast):
    monkeypatch.setattr(m, "MAX_BROADCAST_IDS", broadcast)
    other = "Another line of more than twenty letters"
    rows = [(None, LONG), (None, f"{LONG}\n{other}"), (4, LONG), (None, other), (None, f"{other}\nx"), (5, "nothing of the kind")]
    d = m.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), n_bits=1 << 16)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in d.collect())
    assert got == brute(rows) and got[(4, 1, 0, LONG)] == 1 and got[(None, 1, 1, "")] == 1 and got[(None, 1, 0, other)] == 1


def test_texts_that_lose_nothing_stay_beyond_the_bound(spark, monkeypatch):
    """With no ids broadcast, the bitmap lets hardly any other text into the join."""
    from pyspark.sql import functions as F

    from manylabel.llm.common import flagged

    ids = spark.range(0, 40_000, 20)
    d = flagged(spark.range(40_000), F.col("id"), ids, 2000, "may")
    may = {r["id"] for r in d.where("may").collect()}
    assert may >= set(range(0, 40_000, 20)) and len(may) < 2000 + 400 and d.count() == 40_000
