"""Ranking metrics of predictions ``(row_id, rank, label)`` against true ``(row_id, label)``.

``rows`` lists every row that counts, also those without predictions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 5


def rerank(predictions: DataFrame, ordered: bool = False) -> DataFrame:
    """Ranks by descending score and ascending label, unless the given order is to hold."""
    from .labelgraph import top

    return predictions if ordered else top(predictions.drop("rank"), ("row_id",), F.col("score"), "label", 1 << 30)


def _depths(d: DataFrame) -> DataFrame:
    return F.broadcast(d.sparkSession.range(1, DEPTH + 1).select(F.col("id").cast("int").alias("k")))


def _hits(predictions: DataFrame, true: DataFrame) -> DataFrame:
    t = true.select("row_id", "label").distinct().withColumn("hit", F.lit(1))
    return predictions.where(F.col("rank") <= DEPTH).join(t, ["row_id", "label"], "left").select("row_id", "label", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))


def precision_at_k(predictions: DataFrame, true: DataFrame, rows: DataFrame) -> DataFrame:
    """``(k, value)``: hits among the first k, over k times the number of rows."""
    n = rows.select("row_id").distinct().agg(F.count("*").alias("n"))
    h = _hits(predictions, true).groupBy("rank").agg(F.sum("hit").alias("h"))
    d = _depths(true).join(n).join(h, F.col("rank") <= F.col("k"), "left")
    return d.groupBy("k", "n").agg(F.coalesce(F.sum("h"), F.lit(0)).alias("h")).select("k", (F.col("h") / (F.col("k") * F.col("n"))).alias("value"))


def _gain(rank):
    return 1 / F.log2(rank + 1)


def _ideal(true: DataFrame) -> DataFrame:
    """``(row_id, k, ideal)``: the discounted gain of min(k, number of true labels) hits."""
    n = true.groupBy("row_id").agg(F.count("*").cast("int").alias("size"))
    first = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, r: s + _gain(r))
    return n.join(_depths(true)).select("row_id", "k", first(F.least("k", "size")).alias("ideal"))


def ndcg_at_k(predictions: DataFrame, true: DataFrame, rows: DataFrame) -> DataFrame:
    """``(k, value)``: the mean over all rows of discounted hits relative to the ideal."""
    n = rows.select("row_id").distinct().agg(F.count("*").alias("n"))
    h = _hits(predictions, true).where("hit = 1").select("row_id", _gain(F.col("rank")).alias("g"), "rank")
    d = _ideal(true).join(h, "row_id").where(F.col("rank") <= F.col("k")).groupBy("row_id", "k", "ideal").agg(F.sum("g").alias("g"))
    s = d.groupBy("k").agg(F.sum(F.col("g") / F.col("ideal")).alias("s"))
    return _depths(true).join(n).join(s, "k", "left").select("k", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("value"))


def propensities(train_labels: DataFrame, n_rows: int, a: float = 0.55, b: float = 1.5) -> tuple[DataFrame, float]:
    """``(label, weight)`` of inverse propensities, and the weight of labels that do not occur."""
    c = (math.log(n_rows) - 1) * (b + 1) ** a
    f = train_labels.groupBy("label").agg(F.count("*").alias("n"))
    return f.select("label", (1 + c * F.pow(F.col("n") + b, F.lit(-a))).alias("weight")), 1 + c * b**-a


def _weighted(d: DataFrame, weights: DataFrame, unseen: float) -> DataFrame:
    return d.join(weights, "label", "left").withColumn("weight", F.coalesce("weight", F.lit(unseen)))


def _best(true: DataFrame, weights: DataFrame, unseen: float) -> DataFrame:
    """The true labels of the largest weights, ranked."""
    from pyspark.sql import Window

    w = Window.partitionBy("row_id").orderBy(F.col("weight").desc(), "label")
    return _weighted(true, weights, unseen).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= DEPTH)


def psp_at_k(predictions: DataFrame, true: DataFrame, weights: DataFrame, unseen: float) -> DataFrame:
    """``(k, value)``: weighted hits over the weights that the best order would collect; rows without predictions count on neither side."""
    some = predictions.select("row_id").distinct()
    own = true.join(some, "row_id", "left_semi")
    got = _weighted(_hits(predictions, own).where("hit = 1"), weights, unseen).select("rank", "weight", F.lit(1).alias("won"))
    best = _best(own, weights, unseen).select("rank", "weight", F.lit(0).alias("won"))
    d = got.union(best).groupBy("rank", "won").agg(F.sum("weight").alias("s"))
    d = _depths(true).join(d, F.col("rank") <= F.col("k")).groupBy("k").agg(F.sum(F.when(F.col("won") == 1, F.col("s"))).alias("g"), F.sum(F.when(F.col("won") == 0, F.col("s"))).alias("b"))
    return d.select("k", (F.coalesce("g", F.lit(0.0)) / F.col("b")).alias("value"))


def psndcg_at_k(predictions: DataFrame, true: DataFrame, weights: DataFrame, unseen: float) -> DataFrame:
    """``(k, value)``: as :func:`psp_at_k` with discounts, each row's sums relative to its binary ideal."""
    some = predictions.select("row_id").distinct()
    own = true.join(some, "row_id", "left_semi")
    got = _weighted(_hits(predictions, own).where("hit = 1"), weights, unseen).select("row_id", "rank", "weight", F.lit(1).alias("won"))
    best = _best(own, weights, unseen).select("row_id", "rank", "weight", F.lit(0).alias("won"))
    d = got.union(best).join(_ideal(own), "row_id").where(F.col("rank") <= F.col("k")).withColumn("s", F.col("weight") * _gain(F.col("rank")) / F.col("ideal"))
    d = d.groupBy("k").agg(F.sum(F.when(F.col("won") == 1, F.col("s"))).alias("g"), F.sum(F.when(F.col("won") == 0, F.col("s"))).alias("b"))
    return d.select("k", (F.coalesce("g", F.lit(0.0)) / F.col("b")).alias("value"))
