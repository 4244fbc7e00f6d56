import hashlib
from collections import Counter

import numpy as np
import pytest

from manylabel.llm import repeated_bytes as m

from .helpers import SCHEMA, texts


def brute(rows, length=100):
    """A place is (id, start): a string is repeated if a lesser place has it."""
    least, out = {}, []
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            least[w] = min(least.get(w, (i, s)), (i, s))
    for i, b in raw:
        drop = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if least[b[s : s + length]] < (i, s):
                drop[s : s + length] = b"\1" * length
        spans = sum(drop[k] and (k == 0 or not drop[k - 1]) for k in range(len(b)))
        out.append((i, len(b), sum(drop), spans, hashlib.sha256(bytes(x for x, d in zip(b, drop) if not d)).hexdigest()))
    return Counter(out)


def got(d):
    return Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in d.collect())


def small(monkeypatch, many=1 << 15, block=20_000, group=300, crowded=500):
    """Sizes at which every bound is met within a small fixture."""
    for name, value in (("MANY", many), ("BLOCK_BYTES", block), ("WINDOW_BYTES", 1000), ("GROUP_ROWS", group), ("CROWDED_ROWS", crowded)):
        monkeypatch.setattr(m, name, value)


@pytest.mark.parametrize("many, block, group", [(1 << 15, 8 << 20, 50_000), (1 << 15, 20_000, 300), (1, 20_000, 300), (3, 5_000, 20)])
def test_equals_brute_force(spark, sf, monkeypatch, many, block, group):
    small(monkeypatch, many, block, group)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    assert got(m.remove_repeats(d.repartition(3))) == brute(rows)


@pytest.mark.parametrize("many", [1 << 15, 1])
def test_odd_texts(spark, monkeypatch, many):
    small(monkeypatch, many)
    rows = [(i, t) for i, t in texts() if i is not None]
    cut = "0123456789" * 9
    rows += [(90, f"{cut}A{cut}B"), (91, f"x{cut}A{cut[:8]}"), (92, "ab" * 80), (93, "y" + "ab" * 49), (94, "z" + "ab" * 50), (95, "é" * 60), (96, "é" * 50), (97, "\0" * 150), (98, "x" + "\0" * 103), (-5, cut * 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "key")
    assert got(m.remove_repeats(d, id_column="key")) == brute(rows)


@pytest.mark.parametrize("many", [1 << 15, 1])
def test_repeated_ids(spark, monkeypatch, many):
    """Rows of one id with different texts, equal texts, and strings at equal and other starts."""
    small(monkeypatch, many, block=600)
    rng = np.random.default_rng(4)
    pieces = ["".join(rng.choice(list("abcdefgh"), 70)) for _ in range(6)]
    rows = [(int(rng.integers(3, 7)), "".join(pieces[k] for k in rng.integers(0, 6, rng.integers(1, 6)))) for _ in range(40)]
    d = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").repartition(3)
    assert got(m.remove_repeats(d)) == brute(rows + rows[:5])


@pytest.mark.parametrize("many", [1 << 15, 50])
def test_passage_in_every_document(spark, monkeypatch, many):
    """Edges differ in each document, so its triggers have as many phrases as there are documents."""
    small(monkeypatch, many, block=8_000)
    rng = np.random.default_rng(9)
    noise = lambda n: "".join(rng.choice(list("abcdefghijklmnop "), n))
    passage = noise(400)
    rows = [(k, noise(90) + passage + noise(90)) for k in range(400)]
    rows += [(1000, noise(3000) + passage[150:] + noise(2000) + passage)]
    assert got(m.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_no_route_gathers_a_passage(monkeypatch):
    """Crowded strings leave a task once, whatever the number of its blocks."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 110, 130, dtype=np.uint8))
    keys = {int(k) >> 16 for k in m._phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 100)[4]}
    marks = m._pack(np.array(sorted(keys), np.uint64), np.ones(len(keys)))
    block = lambda k: pa.RecordBatch.from_pydict({"block": [k], "ids": [[k]], "uids": [[k]], "sizes": [[len(text)]], "payload": [m.zstandard.ZstdCompressor().compress(text)], "shared": [[marks]]})
    out = pa.Table.from_batches(list(m._pieces(100)(iter([block(k) for k in range(50)]))))
    sent = [r for r in out.to_pylist() if r["count"]]
    assert len(sent) == len(text) - 99 and {r["uid"] for r in sent} == {0}
    assert sum(r["lead"] for r in out.to_pylist() if not r["count"]) == 49 * (len(text) - 99)


def test_empty_and_null_ids(spark):
    assert m.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    d = spark.createDataFrame([(None, "q" * 50), (None, None), (None, "p" * 10)], "doc_id long, text string")
    assert sorted((r["id"], r["n_bytes"]) for r in m.remove_repeats(d).collect()) == [(None, 0), (None, 10), (None, 50)]
    clash = d.selectExpr("doc_id", "text", "1 AS uid", "2 AS id", "3 AS block", "4 AS runs", "5 AS row")
    assert m.remove_repeats(clash).count() == 3
    with pytest.raises(ValueError):
        m.remove_repeats(d, length=50)
