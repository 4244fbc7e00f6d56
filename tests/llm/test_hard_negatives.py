import math
import random

import pytest
from pyspark.sql import functions as F

from manylabel.llm import hard_negatives as h

from ..compare import check

SCHEMA = "vec_id long, embedding array<float>, label int, id string, g long, windows string, q int"


def brute(rows, positives=5, negatives=5):
    """Rows (id, label, q); every id is an anchor."""
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = set()
    for a in rows:
        others = sorted((-score(a, b), b[0], b[1]) for b in rows if b[0] != a[0])
        for ps, p, _ in [x for x in others if x[2] == a[1]][:positives]:
            fit = [(n, s) for s, n, label in others if label != a[1] and 80 * -ps <= 100 * -s <= 100 * -ps][:negatives]
            out |= {(a[0], p, r, n, -ps, -s) for r, (n, s) in enumerate(fit, 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2) for i, label, v in rows], SCHEMA)


def mined(d, **how):
    q = h.quantized(d, "vec_id", "embedding", F.col("label"))
    return {tuple(r) for r in h.mine(q, q, **how).collect()}


@pytest.mark.parametrize("how", [{}, {"chunk": 3, "anchor_rows": 4, "member_rows": 5}, {"chunk": 1}])
def test_equals_brute_force(spark, how):
    rng = random.Random(5)
    rows = [(i, rng.choice((0, 0, 0, 1, 2)), [rng.uniform(-0.02, 0.05) for _ in range(rng.choice((7, 7, 7, 2, 0)))]) for i in range(60)]
    rows += [(100 + i, 0, rows[3][2]) for i in range(5)]  # ties
    got = mined(table(spark, rows), **how)
    as_float = [[r["embedding"], r["vec_id"], r["label"]] for r in table(spark, rows).collect()]
    assert got == brute([(i, label, [math.floor(256 * x) for x in v]) for v, i, label in as_float]) and got


def test_rows_that_take_no_part(spark):
    good = [(1, 0, [1.0, 0.0]), (2, 0, [1.0, 0.0]), (3, 1, [0.9, 0.0])]
    bad = [(4, None, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (5, 1, None), (6, 1, [1.0, None]), (7, 1, [math.inf, 0.0]), (8, 1, [math.nan, 1.0])]
    want = brute([(i, label, [256, 0] if label == 0 else [230, 0]) for i, label, _ in good])
    assert mined(table(spark, good + bad)) == want != set()
    assert mined(table(spark, good + good + bad)) == want  # an id is one row
    assert mined(table(spark, [])) == set()


def test_large_components_are_exact_or_refused(spark):
    rows = [(1, 0, [float(2**16)] * 3), (2, 0, [float(2**16)] * 3), (3, 1, [float(2**16), float(2**16), float(2**15)])]
    assert mined(table(spark, rows)) == brute([(i, label, [int(256 * x) for x in v]) for i, label, v in rows]) != set()
    with pytest.raises(Exception, match="beyond"):
        mined(table(spark, rows + [(9, 1, [1e30])]))


def test_a_hot_label_is_cut_in_blocks(spark):
    q = spark.range(400).select("id", F.lit(0).cast("long").alias("label"), F.array(F.col("id") % 5, F.lit(1).cast("long")).alias("q"))
    part = h.tiles(q.withColumn("windows", F.array().cast("array<long>")).withColumn("g", F.col("label")), q.withColumn("g", F.col("label")), ("g",), anchor_rows=50, member_rows=100)
    sizes = [(len(r["anchors"]), len(r["members"])) for r in part.collect() if r["anchors"]]
    assert len(sizes) == 32 and max(a for a, _ in sizes) < 100 and max(m for _, m in sizes) < 200


def test_equals_sql(spark, sf):
    check(spark, sf, h.op11_hard_negatives, h.SQL["op11_hard_negatives"])
