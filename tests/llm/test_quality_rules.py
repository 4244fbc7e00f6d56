from collections import Counter

from manylabel.llm import quality_rules as q

from ..compare import check
from .helpers import SCHEMA, WORD, documents, texts


def test_equals_sql(spark, sf):
    check(spark, sf, q.op7_quality_rules, q.SQL["op7_quality_rules"])


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_measures_of_odd_texts(spark):
    d = q.apply_rules(documents(spark).withColumnRenamed("n_chars", "kept")).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in d)
    assert got == Counter((i, *brute(t)) for i, t in texts())
    assert all(not r["kept"] for r in d if r["n_words"] < 50)


def test_filter_on_the_verdict(spark):
    d = q.apply_rules(documents(spark))
    kept = [r["doc_id"] for r in d.where("kept").collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in d.collect() if r["kept"])


def test_no_rules_and_no_rows(spark):
    assert q.apply_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert all(r["failed_rules"] == [] for r in q.apply_rules(documents(spark), rules=()).collect())
