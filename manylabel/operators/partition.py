"""Partitioning rows into clusters: inference, spherical k-means, and the pairwise hyperplane learner.

Weights are a table ``(learner, k, fid, w)``; a learner is a column, so all learners train in
the same jobs. Tables of rows are joined by sorting: their few bytes in Parquet or a shuffle would let Spark
broadcast millions of them through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import sigmoid, slot
from ..session import bucketed, checkpointed, emptied
from . import labelgraph

EPS = 2.220446049250313e-16


def hash_weights(weights: DataFrame, columns: int, bits: int) -> DataFrame:
    """Weights whose places collide share their sum."""
    place = slot(F.col("k"), F.col("fid"), columns, bits)
    shared = weights.groupBy("learner", place.alias("__slot")).agg(F.sum("w").alias("w"))
    return weights.withColumn("__slot", place).drop("w").join(shared, ["learner", "__slot"]).drop("__slot")


def scores(features: DataFrame, weights: DataFrame) -> DataFrame:
    """``(learner, row_id, k, score)``; features without a weight add nothing."""
    return features.join(weights, "fid").groupBy("learner", "row_id", "k").agg(F.sum(F.col("val") * F.col("w")).alias("score"))


#: Weights that are sent to every task at once; more are sent in blocks of clusters.
MAX_SENT_WEIGHTS = 500_000
#: Features whose rows one task scores, and those of a bucket of rows.
TASK_FEATURES, BUCKET_FEATURES = 200_000, 1_000_000


def weight_blocks(weights: DataFrame, k: int, most: int) -> tuple[list[DataFrame], bool]:
    """The weights in as few blocks of whole clusters as keep each at ``most`` rows, and whether that holds (a single cluster may have more)."""
    n = 1
    while True:
        at = F.pmod(F.col("k"), F.lit(n))
        largest = weights.groupBy(at).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= most or n >= k:
            return [weights.where(at == b) for b in range(n)], largest <= most
        n = min(k, max(2 * n, -(-largest * n // most)))


def nearest_cluster(features: DataFrame, weights: DataFrame, k: int, learners: DataFrame | None = None, most: int = MAX_SENT_WEIGHTS) -> DataFrame:
    """``(learner, row_id, cluster, score)``: the first cluster of the highest score; clusters that share no feature score 0.

    Features are brought together by row once. Weights go to them, block by block of clusters, each of a checked size, so a
    row's scores are summed where the row is and only its best of each block is kept: nothing that grows with
    rows times clusters is shuffled. A block that is too large to be sent is joined by feature instead.
    """
    every = features.select("row_id").distinct()
    learners = weights.select("learner").distinct() if learners is None else learners
    every = every.join(F.broadcast(learners))  # learners are few
    # so many partitions that a task sums few rows, however many there are; Spark does not put together partitions of a given number
    parts = max(features.sparkSession.sparkContext.defaultParallelism, -(-features.count() // TASK_FEATURES))
    x = features.repartition(parts, "row_id")
    best = F.max(F.struct("score", (-F.col("k")).alias("m")))
    found = None
    blocks, fit = weight_blocks(weights, k, most)
    for block in blocks:
        small = fit or block.limit(most + 1).count() <= most
        d = x.join(F.broadcast(block), "fid") if small else features.join(block, "fid")
        d = d.groupBy("learner", "row_id", "k").agg(F.sum(F.col("val") * F.col("w")).alias("score")).groupBy("learner", "row_id").agg(best.alias("b"), F.count("*").alias("n"))
        if len(blocks) > 1:  # a plan for each block
            d = checkpointed(d)
        found = d if found is None else found.union(d)
    known = found.groupBy("learner", "row_id").agg(F.max("b").alias("b"), F.sum("n").alias("n"))
    return _best_known(every, known, k, lambda doubt: features.join(doubt.hint("merge"), "row_id").join(weights, ["learner", "fid"]))


def nearest_by_scores(rows: DataFrame, known: DataFrame, k: int, learners: DataFrame) -> DataFrame:
    """As :func:`nearest_cluster` for ``rows(row_id)``, from the table of all their :func:`row_scores`."""
    own = known.join(rows.hint("merge"), "row_id", "left_semi")
    best = own.groupBy("learner", "row_id").agg(F.max(F.struct("score", (-F.col("k")).alias("m"))).alias("b"), F.count("*").alias("n"))
    return _best_known(rows.join(F.broadcast(learners)), best, k, lambda doubt: own.join(doubt.hint("merge"), ["learner", "row_id"]))


def row_scores(features: DataFrame, weights: DataFrame, k: int, most: int = MAX_SENT_WEIGHTS) -> DataFrame:
    """As :func:`scores`, stored, for features in buckets by row: weights go to them in blocks of clusters, so no feature and no part of a sum is shuffled.

    Only weights of which a single cluster is too large to be sent are joined by feature.
    """
    blocks, fit = weight_blocks(weights, k, most)
    if not fit:
        return checkpointed(scores(features, weights))
    parts = [features.join(F.broadcast(b), "fid").groupBy("learner", "row_id", "k").agg(F.sum(F.col("val") * F.col("w")).alias("score")) for b in blocks]
    return reduce(DataFrame.union, [checkpointed(d) for d in parts])  # a plan for each block


def _best_known(every: DataFrame, known: DataFrame, k: int, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first best cluster of ``every(learner, row_id)`` by ``known(learner, row_id, b, n)``, the best of its ``n`` known scores; ``held`` gives ``(learner, row_id, k)`` of all known scores of some rows."""
    score, cluster = F.col("b.score"), -F.col("b.m")
    d = every.join(known.hint("merge"), ["learner", "row_id"], "left")
    # a cluster of no known score can only win where no score is above 0; the others of such a row are looked up
    doubt = known.where((F.col("b.score") <= 0) & (F.col("n") < k)).select("learner", "row_id")
    seen = held(doubt).groupBy("learner", "row_id").agg(F.collect_set("k").alias("ks"))
    d = d.join(seen.hint("merge"), ["learner", "row_id"], "left")
    unknown = F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), F.coalesce("ks", F.array().cast("array<int>"))))
    other = F.when(score.isNull() | ((score <= 0) & (F.col("n") < k)), unknown)
    silent = other.isNotNull() & (score.isNull() | (score < 0) | ((score == 0) & (other < cluster)))
    return d.select("learner", "row_id", F.when(silent, other).otherwise(cluster).cast("int").alias("cluster"), F.when(silent, F.lit(0.0)).otherwise(score).alias("score"))


def centers(features: DataFrame, assigned: DataFrame) -> DataFrame:
    """Unit-length sums of each cluster's rows as weights; empty clusters have none."""
    s = features.join(assigned.select("learner", "row_id", F.col("cluster").alias("k")), "row_id").groupBy("learner", "k", "fid").agg(F.sum("val").alias("s"))
    n = s.groupBy("learner", "k").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("n"))
    return s.join(n, ["learner", "k"]).where("n > 0 AND s <> 0").select("learner", "k", "fid", (F.col("s") / F.col("n")).alias("w"))


def objective(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("learner").agg(F.avg("score").alias("objective"))


def initial_rows(features: DataFrame, k: int, learners: int, seed: int) -> DataFrame:
    """``k`` rows of each learner as weights: those of the least keyed hashes, numbered in their order.

    Nothing passes the driver: rows whose hash is small enough to be among the first ``k`` (with
    eight standard deviations to spare; all rows if that should ever fail) are numbered by a range partition.
    """
    rows = features.select("row_id").distinct()
    n = rows.count()
    share = min(1.0, (k + 8 * math.sqrt(k) + 32) / max(n, 1))
    drawn = rows.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(learners - 1))).alias("learner"))
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(seed), "learner", "row_id"))
    low = checkpointed(drawn.where(F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)))
    short = low.groupBy("learner").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n))
    if short.count() < learners:
        low = drawn
    numbered = checkpointed(dense_numbers(low, ("learner", "h", "row_id")))
    first = numbered.groupBy("learner").agg(F.min("number").alias("__first"))  # one row for each learner
    picks = numbered.join(first, "learner").select("learner", (F.col("number") - F.col("__first")).cast("int").alias("k"), "row_id").where(F.col("k") < k)
    return features.join(picks, "row_id").groupBy("learner", "k", "fid").agg(F.sum("val").alias("w"))


def fit_kmeans(features: DataFrame, k: int, learners: int = 1, max_iter: int = 10, seed: int = 0, start: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Weights after rounds of assigning and recentring, and the mean objective of each round; it stops when the gain vanishes."""
    w = checkpointed(initial_rows(features, k, learners, seed) if start is None else start)
    history: list[float] = []
    for _ in range(max_iter):
        assigned = checkpointed(nearest_cluster(features, w, k))
        history.append(objective(assigned).agg(F.avg("objective")).first()[0])
        w = checkpointed(centers(features, assigned))
        if len(history) > 1 and history[-1] - history[-2] < 1.1920929e-07:
            break
    return w, history


def ftrl_step(state: DataFrame, gradients: DataFrame, eta: float, lam: float) -> DataFrame:
    """State ``(learner, k, fid, w, n, z)`` after summed ascent gradients ``(learner, k, fid, g)``; new places start at n = 1, z = 0."""
    keys = ["learner", "k", "fid"]
    d = state.join(gradients, keys, "full_outer").select(
        *keys, F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("n", F.lit(1.0)).alias("n"), F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("g", F.lit(0.0)).alias("g")
    )
    n2 = F.col("n") + F.col("g") * F.col("g")
    sigma = (F.sqrt(n2) - F.sqrt("n")) / eta
    d = d.select(*keys, n2.alias("n"), (F.col("z") + F.col("g") + sigma * F.col("w")).alias("z"))
    w = F.when(F.abs("z") <= lam, F.lit(0.0)).otherwise(eta * (F.col("z") - F.signum("z") * lam) / F.sqrt("n"))
    return d.select(*keys, w.alias("w"), "n", "z")


def ftrl_state(weights: DataFrame, eta: float, lam: float) -> DataFrame:
    """State that reproduces given weights: n = 1 and z solved from w."""
    return weights.select("learner", "k", "fid", "w", F.lit(1.0).alias("n"), (F.col("w") / eta + F.signum("w") * lam).alias("z"))


def pair_gradients(features: DataFrame, bases: DataFrame, positives: DataFrame, negatives: DataFrame | Column, weights: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """Summed gradients of one batch: the base's cluster should accept its positives and refuse its negatives.

    Instead of ``weights``, the table of all rows' scores by them will do.

    ``bases`` is (learner, row_id, cluster); ``positives`` and ``negatives`` are (row_id, other), or
    (row_id, others) with a list for each row. Negatives may be a column of ``row_id`` instead, a list of numbers of the rows in
    ``numbered(row_id, number)``: they are drawn where the base is and dealt once, by number. A base without positives has no negatives here either.
    What a row adds in a cluster depends only on how often it is a positive and a negative there, so pairs are counted once by (learner, cluster, other).
    """
    refused = bases.hint("merge").join(positives.select("row_id").distinct().hint("merge"), "row_id", "left_semi")
    one = lambda own, others, up, down: _others(own, others).select("learner", F.col("cluster").alias("k"), F.col("other").alias("row_id"), F.lit(up).alias("up"), F.lit(down).alias("down"))
    if isinstance(negatives, Column):
        drawn = refused.select("learner", F.col("cluster").alias("k"), F.explode(negatives).alias("number")).repartition("number")
        drawn = drawn.groupBy("learner", "k", "number").agg(F.lit(0).alias("up"), F.count("*").alias("down"))  # a number's draws are together
        down = drawn.hint("merge").join(numbered.select("number", "row_id"), "number").select("learner", "k", "row_id", "up", "down")
    else:
        down = one(refused, negatives, 0, 1)
    pairs = one(bases, positives, 1, 0).union(down)
    pairs = pairs.groupBy("learner", "k", "row_id").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    s = (weights if "score" in weights.columns else scores(features, weights)).hint("merge")
    accepted = sigmoid(F.coalesce("score", F.lit(0.0)))
    pairs = pairs.join(s, ["learner", "k", "row_id"], "left").withColumn("e", F.col("up") * (1 - accepted) - F.col("down") * accepted)
    return pairs.hint("merge").join(features, "row_id").groupBy("learner", "k", "fid").agg(F.sum(F.col("e") * F.col("val")).alias("g"))


def _others(own: DataFrame, others: DataFrame) -> DataFrame:
    """``own`` with ``other`` by row; lists are taken apart after the join."""
    d = own.hint("merge").join(others, "row_id")
    return d.withColumn("other", F.explode("others")).drop("others") if "others" in others.columns else d


def dense_numbers(rows: DataFrame, order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """The columns of ``order`` (distinct rows) and ``number``, 0 to n - 1 in their order, by a range partition and the partitions' offsets."""
    # stored, as the offsets and the numbers must meet the same partitions
    d = checkpointed(rows.select(*order).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy("__part").agg(F.count("*").alias("__n"))  # one row for each partition
    offsets = offsets.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return d.withColumn("__at", at).join(F.broadcast(offsets), "__part").select(*order, (F.col("__before") + F.col("__at")).alias("number"))


def pair_accuracy(assigned: DataFrame, positives: DataFrame) -> DataFrame:
    """``(learner, n_pairs, n_correct, accuracy)``: the share of positive pairs ``(row_id, other)`` or lists ``(row_id, others)`` whose rows are of one cluster."""
    a = assigned.select("learner", "row_id", "cluster")
    b = assigned.select("learner", F.col("row_id").alias("other"), F.col("cluster").alias("__other"))
    d = _others(a, positives).select("learner", "cluster", "other").join(b.hint("merge"), ["learner", "other"])
    d = d.groupBy("learner").agg(F.count("*").alias("n_pairs"), F.count(F.when(F.col("cluster") == F.col("__other"), 1)).alias("n_correct"))
    return d.withColumn("accuracy", F.col("n_correct") / F.col("n_pairs"))


def drawn_negatives(own: DataFrame, numbered: DataFrame, n: int, num_nn: int, seed: int, epoch: int) -> DataFrame:
    """``(row_id, other)``: ``num_nn`` uniform draws of each row from the ``n`` rows ``(row_id, number)``."""
    drawn = own.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(num_nn - 1))).alias("slot"))
    drawn = drawn.select("row_id", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "row_id", "slot"), F.lit(n)).alias("number"))
    return drawn.join(numbered.select("number", F.col("row_id").alias("other")).hint("merge"), "number").select("row_id", "other")


def fit_pairwise(features: DataFrame, labels: DataFrame, k: int, learners: int = 1, epochs: int = 10, num_nn: int = 10, eta: float = 0.1, lam: float = 4.0, seed: int = 0, batches: int = 4, normalize: bool = True, history: list[float] | None = None) -> DataFrame:
    """Weights that keep label neighbours together, by mini-batches of FTRL steps.

    Neighbours do not depend on the learner and are found once, by all labels however frequent. Each epoch deals rows to
    ``batches`` by a keyed hash; gradients are means over a row's pairs, so that a feature that
    many pairs share does not overshoot. Features stay in buckets by row and the state in buckets of its places; a batch
    scores each row once, for its cluster and its pairs. ``history``, if given, gets the mean pair accuracy after each epoch.
    """
    features = features.select("row_id", "fid", "val")
    features = bucketed(features, ["row_id"], -(-features.count() // BUCKET_FEATURES))[0]  # read many times in each batch
    labels = checkpointed(labels.select("row_id", "label"))
    rows = features.select("row_id").distinct()
    n = rows.count()
    near = labelgraph.label_lists(labels, num_nn, normalize)
    positives = checkpointed(near.select("row_id", labelgraph.repeated("near", num_nn).alias("others")))
    numbered = checkpointed(dense_numbers(rows).select("row_id", "number", F.xxhash64(F.lit(seed), "row_id").alias("h")))
    places = ["learner", "k", "fid"]
    state, at = bucketed(ftrl_state(initial_rows(features, k, learners, seed), eta, lam), places)
    known = checkpointed(state.select("learner").distinct())
    for epoch in range(epochs):
        for b in range(batches):
            own = numbered.where(F.pmod(F.xxhash64("h", F.lit(epoch)), F.lit(batches)) == b).select("row_id")
            scored = row_scores(features, state.where(F.abs("w") > EPS).select(*places, "w"), k)
            base = checkpointed(nearest_by_scores(own, scored, k, known))
            neg = drawn_negatives(own, numbered, n, num_nn, seed, epoch)
            g = pair_gradients(features, base, positives, neg, scored)  # joined with the batch's bases
            new, new_at = bucketed(ftrl_step(state, g.withColumn("g", F.col("g") / num_nn), eta, lam), places)
            emptied(state, at)
            state, at = new, new_at
        if history is not None:
            now = nearest_cluster(features, state.where(F.abs("w") > EPS).select(*places, "w"), k, known)
            history.append(pair_accuracy(checkpointed(now), positives).agg(F.avg("accuracy")).first()[0])
    return state.where(F.abs("w") > EPS).select(*places, "w")
