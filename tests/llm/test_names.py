"""Helper columns never clash with columns of the input, and no input column is lost."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from manylabel.llm import jaccard_join, license_scans, line_dedup, poisson_mixing, quality_classifier, quality_rules, url_filters
from manylabel.llm.common import unused

from .helpers import documents

#: Every name that an operator makes for itself.
HELPERS = "id url sid key dir granting given n source rate draws cdf words lines packed suspects n_lines ellipsis letter_words near drop loses parts x path ends block bits m".split()


def crowded(d):
    return d.withColumns({f"__{name}": F.lit(f"kept {name}") for name in HELPERS}).withColumn("___id", F.lit("kept too"))


def test_unused_names():
    assert unused(["a", "__ID", "___id"], "id", "n", "n") == ["____id", "__n", "___n"]


OPERATORS = {
    "op1": lambda spark, d: url_filters.judge(d.withColumn("url", F.concat(F.lit("http://example.net/en/"), "doc_id"))),
    "op4": lambda spark, d: line_dedup.dedup_lines(d, n_bits=1 << 16),
    "op5": lambda spark, d: license_scans.inherit(d.withColumn("path", F.concat(F.lit("/a/"), "doc_id"))),
    "op7": lambda spark, d: quality_rules.apply_rules(d),
    "op8": lambda spark, d: poisson_mixing.mix(d, epochs=6.0),
    "op12": lambda spark, d: quality_classifier.classify(d, spark.createDataFrame([(1, 0), (12, 1)], "doc_id long, quality int")),
    "one_of_each": lambda spark, d: jaccard_join.one_of_each(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_keeps_clashing_columns(spark, name):
    d = crowded(documents(spark))
    out = OPERATORS[name](spark, d.withColumn("html", F.lit("")) if name == "op1" else d)
    assert {f"__{x}" for x in HELPERS} | {"___id"} <= set(out.columns)
    rows = out.collect()
    assert rows and all(r[f"__{x}"] == f"kept {x}" for r in rows for x in HELPERS) and all(r["___id"] == "kept too" for r in rows)


@pytest.mark.parametrize("at", [0, 1, 2, 3])
def test_stage_keeps_clashing_columns(spark, at):
    d = crowded(documents(spark))
    out = corpus_pipeline.STAGES[at][1](spark, d, "")
    assert out.columns == d.columns and all(r["__id"] == "kept id" for r in out.collect())
