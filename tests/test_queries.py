import pytest

import __spark_entry__ as entry
from manylabel.plans import catalogue

from .compare import check


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, catalogue.QUERIES[name], catalogue.SQL[name])


def test_no_query_reads_a_part_of_its_table():
    assert not any("l_orderkey <" in sql for sql in catalogue.SQL.values())


def test_entry(spark):
    d = entry.entry(spark)
    assert d.columns == ["k", "value"] and d.count() == 5


def test_every_query_of_the_blueprint_is_registered():
    names = {n.split("_")[0] for n in catalogue.QUERIES}
    assert {f"Q{i:02d}" for i in range(1, 41)} <= names


def test_graph_search_finds_nearly_all(spark, sf):
    exact = {(r["query_id"], r["row_id"]) for r in catalogue.QUERIES["Q23_knn_cosine"](spark, sf).collect()}
    found = {(r["query_id"], r["row_id"]) for r in catalogue.QUERIES["Q28_graph_search"](spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_embedding_learner_separates_languages(spark, sf):
    (r,) = catalogue.QUERIES["Q20_embedding_fit"](spark, sf).collect()
    assert r["precision"] > 0.7
