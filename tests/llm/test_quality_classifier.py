import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from manylabel.llm import quality_classifier as q

from .helpers import SCHEMA, WORD, documents, texts, write

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    t = text or ""
    w, lines = WORD.findall(t), t.split("\n")
    n, c, s = len(w), len(t), lambda k, m: math.sqrt(k / (m + 20))
    count = lambda p, x=t: len(re.findall(p, x))
    capital = sum(x.isupper() for x in t)
    return [
        math.log1p(n), math.log1p(max(c - n, 0) / (n + 1)), s(count(r"[#*$%&<>]"), c), s(t.count("|"), n), s(t.count("!"), n), s(capital, c), s(sum(a == b for a, b in zip(w, w[1:])), n),
        math.log1p(len(set(w))) - math.log1p(n), s(count("[0-9]"), c), s(count("[.,;:?]"), n), math.log1p(n / len(lines)), s(len(lines) - len(set(lines)), len(lines)),
        s(sum(len(x) > 1 and x[:2].isupper() and x[:2].isalpha() and not any(y.islower() for y in x) for x in w), n),
    ]


def test_statistics(spark):
    d = q.statistics(documents(spark).withColumn("x", F.lit("gone")).withColumnRenamed("lang", "w")).collect()
    got, want = sorted((r["doc_id"] or -1, *r["x"]) for r in d), sorted((i or -1, *brute(t)) for i, t in texts())
    assert np.allclose(np.array(got), np.array(want), atol=1e-9)
    assert all(r["w"] in ("en", None) for r in d)


def test_moments_and_factors(spark):
    rng = np.random.default_rng(3)
    k = len(q.STATISTICS)
    x0, x1 = rng.normal(size=(80, k)) @ rng.normal(size=(k, k)), 1 + rng.normal(size=(120, k))
    x0[:, 2] = 0  # never varies in one class
    d = spark.createDataFrame([(c, v.tolist()) for c, x in ((0, x0), (1, x1)) for v in x] + [(7, [1.0] * k), (None, [1.0] * k)], "label int, x array<double>")
    model, share = q.fit(d)
    assert share == 121 / 202
    n = np.array([80, 120])
    covs = [np.cov(x.T, bias=True) for x in (x0, x1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / 200
    unit = np.sqrt(np.diag(pooled))
    want = []
    for x, c, m in ((x0, covs[0], 80), (x1, covs[1], 120)):
        s = (0.9 * c + 0.1 * pooled) / np.outer(unit, unit)
        s = 0.95 * s + 0.05 * np.trace(s) / k * np.eye(k)
        z = (np.concatenate([x0, x1]) - x.mean(0)) / unit
        want.append(math.log(m / 200) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (z @ np.linalg.inv(s) * z).sum(1))
    got = d.where("label IN (0, 1)").select("label", model.log_odds(F.col("x")).alias("odds")).orderBy("label", "x").collect()
    rows = sorted((c, v.tolist(), o) for c, v, o in zip([0] * 80 + [1] * 120, np.concatenate([x0, x1]), want[1] - want[0]))
    assert [r["odds"] for r in got] == pytest.approx([o for *_, o in rows], rel=1e-6, abs=1e-6)


def test_held_out_rows_and_labels_are_no_inputs(spark):
    docs = documents(spark)
    ids = [i for i, _ in texts() if i is not None]
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}
    labels = [(i, i % 2, 0) for i in sorted(set(ids))]
    scored = lambda rows: {(r["doc_id"], r["n_chars"], r["held_out"], r["score"], r["predicted"]) for r in q.classify(docs, spark.createDataFrame(rows, LABELS)).collect()}
    first = scored(labels)
    assert {i for i, _, h, *_ in first if h} == held
    assert scored([(i, 1 - y if i in held else y, 1) for i, y, _ in labels]) == first
    assert scored(labels + labels[:3] + [(None, 1, 1), (999, 0, 0)]) == first
    assert scored(labels + [(6, 1, 0), (7, 0, 0)]) != first  # ids with both labels have none
    assert all(0 <= s <= 1 and p == (s >= 0.3) for *_, s, p in first)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (3, 1, 0)], [(1, None, 0), (3, 5, 0)]])
def test_without_examples_of_both_classes(spark, labels):
    d = q.classify(documents(spark), spark.createDataFrame(labels, LABELS)).collect()
    n = sum(y == 1 and zlib.crc32(str(i).encode()) % 5 > 0 for i, y, _ in labels)
    assert len(d) == len(texts()) and {r["score"] for r in d} == {(n + 1) / (n + 2)}


def test_extra_columns_and_no_rows(spark):
    d = documents(spark).limit(0).withColumns({"score": F.lit("old"), "held_out": F.lit(1), "label": F.lit(0)})
    out = q.classify(d, spark.createDataFrame([], LABELS))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_chars", "label", "held_out", "score", "predicted"]


def auc(rows):
    ranked = sorted(rows)
    ones = sum(y for _, y in ranked)
    below = [i for i, (_, y) in enumerate(ranked) if y]
    return (sum(below) - ones * (ones - 1) / 2) / (ones * (len(ranked) - ones))


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d = q.op12_quality_classifier(spark, sf)
    assert d.columns == ["doc_id", "held_out", "score", "predicted"] and d.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    known = d.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert auc([(r["score"], r["quality"]) for r in known]) > 0.98
    assert sum(r["predicted"] == r["quality"] for r in known) >= 0.97 * len(known)


def test_query_of_odd_tables(spark, tmp_path):
    path = write(documents(spark), tmp_path)
    write(spark.createDataFrame([(1, 0, 0), (5, 1, 0), (9, 0, 1), (12, 1, 1)], LABELS), tmp_path, "labels")
    d = q.op12_quality_classifier(spark, path).collect()
    assert len(d) == len(texts()) and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in d)


def test_empty_schema(spark, tmp_path):
    write(spark.createDataFrame([], SCHEMA), tmp_path)
    write(spark.createDataFrame([], LABELS), tmp_path, "labels")
    assert q.op12_quality_classifier(spark, str(tmp_path)).count() == 0
