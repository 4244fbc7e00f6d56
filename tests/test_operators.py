import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from manylabel.functions.vectors import l2_normalize, sigmoid
from manylabel.operators import embed, labelgraph, neighbors, partition, vote
from manylabel.params import Params
from manylabel.session import checkpointed

L = {0: [1, 2], 1: [1, 2, 3], 2: [2], 3: [1], 4: [9]}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, x) for i, ls in L.items() for x in ls], "row_id long, label int")


def test_label_knn_and_amplification(labels):
    d = labelgraph.amplify(labelgraph.label_knn(labels, 3), 3).orderBy("row_id", "slot").collect()
    got = {}
    for r in d:
        got.setdefault(r["row_id"], []).append((r["neighbor"], round(r["score"], 4)))
    assert got == {
        0: [(2, 1.0), (3, 1.0), (1, 0.6667)],
        1: [(0, 1.0), (2, 1.0), (3, 1.0)],
        2: [(0, 0.5), (1, 0.3333), (0, 0.5)],
        3: [(0, 0.5), (1, 0.3333), (0, 0.5)],
    }


def brute_label_knn(rows, m, normalize, cluster=lambda i: 0):
    held = {}
    for i, x in rows:
        held.setdefault(i, Counter())[x] += 1
    out = set()
    for i, own in held.items():
        near = []
        for j, theirs in held.items():
            common = sum(own[x] * theirs[x] for x in own)
            if i != j and common and cluster(i) == cluster(j):
                near.append((-(common / sum(theirs.values()) if normalize else common), j))
        out |= {(i, r, j, round(-s, 9)) for r, (s, j) in enumerate(sorted(near)[:m], 1)}
    return out


@pytest.mark.parametrize("hot, normalize", [(1, True), (40, True), (8, False)])
def test_hot_labels_change_nothing(spark, hot, normalize):
    """One label in half of all rows, two in many, rare ones, repeats: the same lists whatever counts as hot."""
    rng = np.random.default_rng(11)
    rows = [(i, int(x)) for i in range(160) for x in [0] * (i % 2) + [1] * (i % 3 == 0) + [2] * (2 * (i % 7 == 0)) + list(3 + rng.integers(0, 60, i % 4))]
    d = spark.createDataFrame([(i, x, i % 2) for i, x in rows], "row_id long, label long, cluster int")
    got = lambda x: {(r["row_id"], r["rank"], r["neighbor"], round(r["score"], 9)) for r in x.collect()}
    if hot == 40:
        assert got(labelgraph.label_knn(d.drop("cluster"), 5, normalize, hot=hot)) == brute_label_knn(rows, 5, normalize)
    assert got(labelgraph.label_knn(d, 5, normalize, within=("cluster",), hot=hot)) == brute_label_knn(rows, 5, normalize, lambda i: i % 2)


def test_a_label_of_half_the_rows_makes_no_quadratic_join(spark):
    """20,000 rows, half of them of one label: no stage of the plan makes more than a few rows for each row of the input."""
    n, m = 20_000, 5
    d = spark.range(n).select(F.col("id").alias("row_id"), F.explode(F.array(F.col("id") % 2, 10 + (F.col("id") / 4).cast("long"))).alias("label")).where("label <> 1")
    out = labelgraph.label_knn(d, m, hot=1000)
    got = Counter(r["row_id"] for r in out.collect())
    assert all(got[i] == m for i in range(0, n, 2)) and all(got[i] == 3 for i in range(1, n, 2))
    # even rows: the three of their own group of four share a rare label; one of them the hot one too
    four = {r["neighbor"]: r["score"] for r in out.where("row_id = 4000").collect()}
    assert four[4002] == 1.0 and four[4001] == four[4003] == 1.0 and sorted(four)[:2] == [0, 2]


def shuffled_rows(spark, run):
    """What a function returns, and the rows that its stages wrote to shuffles."""
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    written = lambda: {x.stageId(): x.shuffleWriteRecords() for x in (s.apply(i) for s in [stages()] for i in range(s.size()))}
    before = written()
    out = run()
    return out, sum(n for i, n in written().items() if i not in before)


@pytest.mark.parametrize("hot", [4096, 1000])
def test_label_neighbours_shuffle_no_pairs(spark, hot):
    """80 labels of 100 rows make 792,000 pairs, and a hot one of half the rows more; what is shuffled follows the entries."""
    rows = [(i, x) for i in range(4000) for x in (i % 40, 40 + i // 100, *[99] * (hot == 1000 and i % 2 == 0))]
    d = spark.createDataFrame(rows, "row_id long, label int")
    got, moved = shuffled_rows(spark, lambda: labelgraph.label_knn(d, 5, hot=hot).collect())
    assert moved < 15 * len(rows)
    held = {}
    for i, x in rows:
        held.setdefault(i, set()).add(x)
    for i in (0, 77, 3999):
        near = sorted((-len(held[i] & own) / len(own), j) for j, own in held.items() if j != i and held[i] & own)[:5]
        assert [(r["score"], r["neighbor"]) for r in sorted(got, key=lambda r: r["rank"]) if r["row_id"] == i] == [(-s, j) for s, j in near]


def test_lists_are_amplified_where_they_are(spark, labels):
    """Repeating a row's list needs no window over its lines, and so no shuffle after the lists."""
    lists = labelgraph.label_lists(labels, 3)
    out = labelgraph.amplified(lists, 5)
    same = labelgraph.amplify(labelgraph.label_knn(labels, 3), 5).select("row_id", "slot", "neighbor")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(out) and plan(out).count("Exchange") == plan(lists).count("Exchange")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, same.collect())) and out.dtypes == same.dtypes


def test_an_orders_labels_are_shuffled_once(spark, sf):
    from manylabel.plans import fixtures

    plan = fixtures.orders(spark, sf)[1].groupBy("row_id").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_label_neighbours_of_names(spark):
    d = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "y"), ("c", "x"), ("c", "y"), (None, "x"), ("d", None)], "row_id string, label string")
    got = {(r["row_id"], r["rank"], r["neighbor"], r["score"]) for r in labelgraph.label_knn(d, 2).collect()}
    assert got == {("a", 1, "b", 1.0), ("a", 2, "c", 1.0), ("b", 1, "a", 0.5), ("b", 2, "c", 0.5), ("c", 1, "a", 1.0), ("c", 2, "b", 1.0)}


def test_tables_of_rows_are_not_broadcast(spark):
    """Small files or shuffles of rows tempt Spark to send them through the driver."""
    features = checkpointed(spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 9).alias("fid"), F.lit(1.0).alias("val")))
    w = checkpointed(spark.range(18).select(F.lit(0).alias("learner"), (F.col("id") % 2).cast("int").alias("k"), F.floor(F.col("id") / 2).alias("fid"), (F.col("id") / 7 - 1).alias("w")))
    base = checkpointed(partition.nearest_cluster(features, w, 2))
    pairs = checkpointed(features.select("row_id", ((F.col("row_id") + 1) % 400).alias("other")))
    for d in (partition.pair_gradients(features, base, pairs, pairs, w), partition.pair_accuracy(base, pairs), partition.drawn_negatives(features, partition.dense_numbers(features), 400, 3, 1, 1)):
        plan = d._jdf.queryExecution().executedPlan().toString()
        on_rows = [x for x in plan.splitlines() if "HashJoin" in x and ("row_id" in x or "other" in x or "number" in x)]
        assert "SortMergeJoin" in plan and not on_rows


@pytest.mark.parametrize("budget, want", [(0, 1), (5, 1), (10, 3), (15, 3)])
def test_head_threshold(spark, budget, want):
    freq = spark.createDataFrame([(1, 3), (2, 3), (3, 1), (4, 1)], "label int, n long")
    assert labelgraph.head_threshold(freq, budget).first()["threshold"] == want


def test_votes(spark, labels):
    near = spark.createDataFrame([(0, 7, 0), (0, 7, 1), (1, 7, 1), (1, 7, 2)], "learner int, query_id long, row_id long")
    d = vote.top_labels(vote.label_scores(vote.neighbor_votes(near), labels))
    assert [(r["label"], r["score"]) for r in d.orderBy("rank").collect()] == [(2, 4), (1, 3), (3, 2)]


def test_cluster_of_unknown_features_is_the_first_silent_one(spark):
    x = spark.createDataFrame([(1, 5, 1.0), (2, 6, 1.0), (3, 7, 1.0)], "row_id long, fid int, val double")
    w = spark.createDataFrame([(0, 0, 5, -1.0), (0, 2, 6, 2.0)], "learner int, k int, fid int, w double")
    got = {r["row_id"]: r["cluster"] for r in partition.nearest_cluster(x, w, 3).collect()}
    assert got == {1: 1, 2: 2, 3: 0}


def test_nearest_cluster_equals_brute_force_in_any_blocks(spark):
    rng = np.random.default_rng(8)
    n, k = 80, 7
    x = {(i, int(f)): float(rng.integers(1, 4)) for i in range(n) for f in rng.choice(30, 4, replace=False)}
    w = {(t, c, f): float(rng.integers(-3, 3)) for t in range(2) for c in range(k) for f in range(28) if rng.random() < 0.4}
    features = spark.createDataFrame([(i, f, v) for (i, f), v in x.items()], "row_id long, fid int, val double")
    weights = spark.createDataFrame([(*key, v) for key, v in w.items()], "learner int, k int, fid int, w double")
    want = set()
    for t in range(2):
        for i in range(n):
            s = [sum(v * w.get((t, c, f), 0) for (j, f), v in x.items() if j == i) for c in range(k)]
            want.add((t, i, int(np.argmax(s)), max(s)))
    for most in (1_000_000, 60):
        got = {(r["learner"], r["row_id"], r["cluster"], r["score"]) for r in partition.nearest_cluster(features, weights, k, most=most).collect()}
        assert got == want
    blocks, fit = partition.weight_blocks(weights, k, 60)
    assert len(blocks) > 1 and fit and sum(b.count() for b in blocks) == len(w)


def test_scores_stay_where_their_row_is(spark):
    """Between the scan of the features and a row's best cluster lies one exchange, by row."""
    x = spark.range(4000).select((F.col("id") % 500).alias("row_id"), (F.col("id") % 40).cast("int").alias("fid"), F.lit(1.0).alias("val"))
    w = spark.range(4000).select(F.lit(0).alias("learner"), (F.col("id") % 100).cast("int").alias("k"), (F.col("id") / 100).cast("int").alias("fid"), F.col("id").cast("double").alias("w"))
    plan = partition.nearest_cluster(x, w, 100)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(learner" not in plan.split("hashpartitioning(row_id")[0] and not any("k#" in line and "hashpartitioning" in line for line in plan.splitlines())


def test_kmeans_objective_does_not_fall(spark):
    rng = np.random.default_rng(0)
    x = spark.createDataFrame([(i, j, float(v)) for i in range(60) for j, v in enumerate(rng.normal(size=4) + 5 * np.eye(4)[i % 4])], "row_id long, fid int, val double")
    w, history = partition.fit_kmeans(l2_normalize(x), 3, learners=1, max_iter=4, seed=1)
    assert all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    n = w.groupBy("learner", "k").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in n)


def test_every_draw_hits_one_row_and_every_row_can_be_hit(spark, monkeypatch):
    n, num_nn = 400, 5
    x = spark.createDataFrame([(3 * i + 1, i % 7, 1.0) for i in range(n)], "row_id long, fid int, val double")
    labels = x.select("row_id", (F.col("fid") % 3).alias("label"))
    seen = []
    whole = partition.pair_gradients

    def record(features, bases, positives, negatives, weights):
        seen.extend((r["row_id"], r["other"]) for r in negatives.collect())
        return whole(features, bases, positives, negatives, weights)

    monkeypatch.setattr(partition, "pair_gradients", record)
    partition.fit_pairwise(x, labels, 2, epochs=1, num_nn=num_nn, batches=2)
    drawn = Counter(i for i, _ in seen)
    assert drawn == {3 * i + 1: num_nn for i in range(n)}  # each row has all its draws
    hit = {j for _, j in seen}
    assert len(hit) > 0.98 * n  # 1 - exp(-5) of the rows on average; about 63 % before
    assert max(Counter(j for _, j in seen).values()) < 20  # no row stands for others


def test_dense_numbers(spark):
    ids = [5, -3, 10**12, 0, 77, *range(1000, 3000, 3)]
    got = {r["row_id"]: r["number"] for r in partition.dense_numbers(spark.createDataFrame([(i,) for i in ids], "row_id long").repartition(5)).collect()}
    assert got == {x: i for i, x in enumerate(sorted(ids))}
    assert partition.dense_numbers(spark.createDataFrame([], "row_id long")).count() == 0


def test_ftrl_weight_is_zero_within_the_threshold(spark):
    s = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 2, -0.25)], "learner int, k int, fid int, w double")
    g = spark.createDataFrame([(0, 0, 1, -6.0), (0, 0, 3, 9.0)], "learner int, k int, fid int, g double")
    d = partition.ftrl_step(partition.ftrl_state(s, 0.1, 4.0), g, 0.1, 4.0).collect()
    assert len(d) == 3
    assert all((r["w"] == 0) == (abs(r["z"]) <= 4) for r in d)
    assert [round(r["w"], 9) for r in d if r["fid"] == 2] == [-0.25]  # no gradient, no change


def test_sigmoid_does_not_overflow(spark):
    d = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(sigmoid(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in d] == [0.0, 0.5, 1.0]


def test_tiles_and_parts_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(i, i % 2, [float(v) for v in rng.normal(size=5)]) for i in range(120)] + [(999, 0, [0.0] * 5)], "row_id long, cluster int, emb array<double>")
    q = d.where("row_id < 20").withColumnRenamed("row_id", "query_id")
    get = lambda x: sorted((r["query_id"], r["rank"], r["row_id"]) for r in x.collect())
    whole = get(neighbors.knn(q, d, 5, within=("cluster",)))
    monkeypatch.setattr(neighbors, "TILE", 16)
    assert get(neighbors.knn(q, d, 5, within=("cluster",))) == whole
    far = get(neighbors.graph_search(q, d, 5, num_edge=20, eps=100.0, within=("cluster",), part_rows=25))
    assert far == whole  # on a connected graph with much slack the search is exact


def test_a_vector_is_sent_to_few_tiles(spark, monkeypatch):
    """Tiles grow before they become more, and a tile is scored in blocks: the same lists, ties included, as in one tile."""
    rng = np.random.default_rng(12)
    d = spark.createDataFrame([(i, [float(v) for v in rng.integers(-2, 3, 3)]) for i in range(400)], "row_id long, emb array<double>")
    q = d.withColumnRenamed("row_id", "query_id")
    get = lambda: sorted((r["query_id"], r["rank"], r["row_id"]) for r in neighbors.knn(q, d, 6, "dot", exclude_self=True).collect())
    whole, held = get(), []
    monkeypatch.setattr(neighbors, "TILE", 16)
    monkeypatch.setattr(neighbors, "BLOCKS", 2)
    monkeypatch.setattr(neighbors, "LINES", 8)
    assert get() == whole
    plan = neighbors.knn(q, d, 6, "dot")
    monkeypatch.setattr(neighbors, "_similarity", lambda a, b, metric, f=neighbors._similarity: held.append((len(a), len(b))) or f(a, b, metric))
    x = rng.normal(size=(40, 3))
    neighbors._best_of_blocks(x, x, 6, "dot")
    assert max(held) <= (8, 16) and len(held) == 15
    assert plan.groupBy("query_id").count().where("count <> 6").count() == 0


@pytest.mark.parametrize("small", [0, 1000])
def test_queries_of_a_part_walk_together(monkeypatch, small):
    """Hundreds of queries take a few rounds of arrays, not a walk each, and find what a walk of one alone finds."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(300, 8))
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1) + np.diag(np.full(300, np.inf))
    monkeypatch.setattr(neighbors, "SMALL", small)
    part = neighbors.GraphIndex(x, list(np.argsort(d2, axis=1)[:, :12]), 11, 0)
    q = rng.normal(size=(200, 8))
    at, of, found = part.search(q, 5, 0.1)
    assert np.bincount(at).tolist() == [5] * 200 and np.allclose(found, ((x[of] - q[at]) ** 2).sum(1))
    exact = np.argsort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :5]
    assert np.mean([i in exact[j] for j, i in zip(at, of)]) > 0.9
    alone = part.search(q[7:8], 5, 0.1)
    assert alone[1].tolist() == of[at == 7].tolist()
    at, of, _ = part.search(q, 5, 1e9)
    assert np.mean([i in exact[j] for j, i in zip(at, of)]) > 0.97  # all that edges lead to


def test_a_stored_index_serves_searches(spark, tmp_path):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(3 * i, i % 2, [float(v) for v in rng.normal(size=4)]) for i in range(300)] + [(1, 0, [0.0] * 4)], "row_id long, cluster int, emb array<double>")
    neighbors.build_index(d, 12, ("cluster",), part_rows=60).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 300 and index.where("size(edges) = 12").count() == 300
    assert index.select("cluster", "part").distinct().count() == 6
    inside = index.select("cluster", "part", F.explode("edges").alias("to")).join(index.selectExpr("row_id AS to", "cluster AS c", "part AS p"), "to")
    assert inside.where("c <> cluster OR p <> part").count() == 0
    q = d.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    exact = {(r["query_id"], r["row_id"]) for r in neighbors.knn(q, d, 5, within=("cluster",), exclude_self=True).collect()}
    found = [(r["query_id"], r["row_id"]) for r in neighbors.search_index(q, index, 5, 0.2, ("cluster",), exclude_self=True).collect()]
    assert len(exact & set(found)) >= 0.9 * len(exact) and all(i != j for i, j in found)
    assert neighbors.build_index(d.limit(0), 5, ("cluster",)).count() == 0


def brute_tree(rows, leaf, levels):
    """Node of each row, by the rule in the text."""
    at = {i: 1 for i in rows}
    for _ in range(levels):
        for node in set(at.values()):
            own = sorted(i for i in rows if at[i] == node)
            if len(own) <= leaf:
                continue
            far = lambda j: max(own[1:], key=lambda i: (((rows[i] - j) ** 2).sum(), -i))
            a = rows[far(rows[own[0]])]
            b = rows[far(a)]
            right = {i: (b - a) @ (rows[i] - (a + b) / 2) > 0 for i in own}
            if len(set(right.values())) == 2:
                at.update({i: 2 * node + right[i] for i in own})
    return at


def test_tree_grows_level_by_level(spark):
    rng = np.random.default_rng(4)
    x = {(c, 7 * i): rng.normal(size=4) for c in range(2) for i in range(40)} | {(1, 1000 + i): np.ones(4) for i in range(20)}
    d = spark.createDataFrame([(c, i, v.tolist()) for (c, i), v in x.items()], "part int, row_id long, emb array<double>")
    for levels in (2, 60):
        leaves, nodes = neighbors.grow_tree(d, 10, ("part",), levels)
        got = {(r["part"], r["row_id"]): r["node"] for r in leaves.collect()}
        want = {(c, i): n for c in range(2) for i, n in brute_tree({i: v for (p, i), v in x.items() if p == c}, 10, levels).items()}
        assert got == want
    sizes = Counter((c, n) for (c, _), n in got.items())
    assert sorted(sizes.values())[-2] <= 10 < max(sizes.values())  # only the equal vectors stay together
    for r in nodes.collect():
        below = [v for (c, i), v in x.items() if c == r["part"] and bin(got[c, i])[2:].startswith(bin(r["node"])[2:])]
        assert r["n"] == len(below) and np.allclose(r["center"], np.mean(below, axis=0))
    empty = neighbors.grow_tree(d.limit(0), 10, ("part",))
    assert empty[0].count() == 0 and empty[1].count() == 0


def test_subtrees_of_a_task_change_nothing(spark, monkeypatch):
    """Small nodes are split in a task by the same rule, equal vectors and the bound on levels included; fewer rounds read the vectors."""
    rng = np.random.default_rng(21)
    x = np.concatenate([rng.normal(size=(300, 5)), np.ones((40, 5))])
    d = checkpointed(spark.createDataFrame([(i * 7 % 1021, i % 2, v.tolist()) for i, v in enumerate(x)], "row_id long, part int, emb array<double>"))
    got = {}
    for bound in (0, 60, 4096):
        monkeypatch.setattr(neighbors, "SUBTREE", bound)
        for levels in (3, 60):
            (leaves, nodes), moved = shuffled_rows(spark, lambda: neighbors.grow_tree(d, 8, ("part",), levels))
            centers = {(r["part"], r["node"]): (r["n"], np.round(r["center"], 9).tolist()) for r in nodes.collect()}
            got[bound, levels] = sorted(map(tuple, leaves.select("part", "row_id", "node").collect())), centers, moved
    for levels in (3, 60):
        assert got[0, levels][:2] == got[60, levels][:2] == got[4096, levels][:2] and len(got[0, levels][0]) == 340
    assert got[4096, 60][2] < got[0, 60][2] / 2


def test_frontier_search(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(12, 6))
    d = spark.createDataFrame([(i, 0, (c[i % 12] + 0.4 * rng.normal(size=6)).tolist()) for i in range(600)], "row_id long, cluster int, emb array<double>")
    index = checkpointed(neighbors.build_index(d, 16, ("cluster",), part_rows=200))
    assert index.select("part").distinct().count() == 3
    tree = neighbors.grow_tree(index, 60, ("cluster", "part"))
    q = d.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    exact = {(r["query_id"], r["row_id"]): (r["rank"], round(r["score"], 9)) for r in neighbors.knn(q, d, 5, within=("cluster",), exclude_self=True).collect()}
    found, visited = neighbors.search_frontier(q, index, 5, 0.3, ("cluster",), exclude_self=True, tree=tree)
    got = {(r["query_id"], r["row_id"]): (r["rank"], round(r["score"], 9)) for r in found.collect()}
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact) and all(i != j for i, j in got)
    seen = [r["visited"] for r in visited.collect()]
    assert len(seen) == 30 and max(seen) < 600 and np.mean(seen) < 500
    wide, _ = neighbors.search_frontier(q.limit(3), index, 5, 1e9, ("cluster",), exclude_self=True, tree=tree)
    assert {(r["query_id"], r["row_id"]): (r["rank"], round(r["score"], 9)) for r in wide.collect()}.items() <= exact.items()  # with endless slack all is walked
    assert wide.count() == 15
    none, _ = neighbors.search_frontier(q, index.limit(0), 5, within=("cluster",))
    assert none.count() == 0


def test_frontier_search_walks_every_part(spark):
    """Vectors without any structure in many parts: a best over all parts must not end the walk of a part at its entry."""
    rng = np.random.default_rng(8)
    d = spark.createDataFrame([(i, 0, rng.normal(size=48).tolist()) for i in range(1000)], "row_id long, cluster int, emb array<double>")
    index = checkpointed(neighbors.build_index(d, 12, ("cluster",), part_rows=100))
    q = d.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")
    exact = {(r["query_id"], r["row_id"]) for r in neighbors.knn(q, d, 10, within=("cluster",), exclude_self=True).collect()}
    found, visited = neighbors.search_frontier(q, index, 10, 0.05, ("cluster",), exclude_self=True, leaf=16)
    got = {(r["query_id"], r["row_id"]) for r in found.collect()}
    assert len(got) == 200 and len(exact & got) >= 0.9 * len(exact)
    assert np.mean([r["visited"] for r in visited.collect()]) < 900


def test_pruning_leaves_out_head_labels(spark):
    labels = spark.createDataFrame([(i, 7) for i in range(30)] + [(i, 100 + i // 2) for i in range(30)], "row_id long, label int")
    freq = labelgraph.frequencies(labels)
    threshold = labelgraph.head_threshold(freq, 100)
    pruned = labelgraph.prune_heads(labels, freq, threshold)
    assert pruned.where("label = 7").count() == 0 and pruned.count() == 30
    near = labelgraph.label_knn(labels, 5, pruned=pruned).collect()
    assert {(r["row_id"], r["neighbor"], r["score"]) for r in near} == {(i, i ^ 1, 0.5) for i in range(30)}


def test_negatives_of_large_ids_do_not_overflow(spark):
    d = spark.createDataFrame([(9 * 10**18,), (9_000_000_000,), (5,)], "row_id long")
    got = {(r["row_id"], r["slot"]): r["negative"] for r in labelgraph.negatives(d, 2, 1_000_003, epoch=3).collect()}
    assert got == {(i, s): (1103515245 * i + 12345 * s + 21) % 1_000_003 for i in (9 * 10**18, 9_000_000_000, 5) for s in (0, 1)}


def test_hashed_weights_share_their_sum(spark):
    w = spark.createDataFrame([(0, k, f, float(10 * k + f)) for k in range(3) for f in range(4)], "learner int, k int, fid int, w double")
    got = {(r["k"], r["fid"]): r["w"] for r in partition.hash_weights(w, 5, 2).collect()}
    place = lambda k, f: (k * 5 + f) & 3
    assert got == {(k, f): sum(10.0 * a + b for a in range(3) for b in range(4) if place(a, b) == place(k, f)) for k in range(3) for f in range(4)}


def test_initial_rows(spark):
    x = spark.createDataFrame([(7 * i, i, 2.0) for i in range(500)], "row_id long, fid int, val double")
    d = partition.initial_rows(x, 20, 3, 5).collect()
    for t in range(3):
        own = [r for r in d if r["learner"] == t]
        assert sorted(r["k"] for r in own) == list(range(20)) and len({r["fid"] for r in own}) == 20
    assert len({frozenset(r["fid"] for r in d if r["learner"] == t) for t in range(3)}) == 3
    few = partition.initial_rows(x.where("fid < 4"), 9, 2, 5).collect()
    assert {(r["learner"], r["k"]) for r in few} == {(t, k) for t in range(2) for k in range(4)}


def test_pair_accuracy(spark):
    a = spark.createDataFrame([(0, 1, 0), (0, 2, 0), (0, 3, 1)], "learner int, row_id long, cluster int")
    pos = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1)], "row_id long, other long")
    assert [tuple(r) for r in partition.pair_accuracy(a, pos).collect()] == [(0, 4, 2, 0.5)]


def test_pairs_of_lists_are_made_after_the_row_is_known(spark):
    """A list goes to its row's cluster as one row; only then do its pairs go to the others' clusters."""
    n, m = 2000, 10
    a = checkpointed(spark.range(n).select(F.lit(0).alias("learner"), F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("cluster")))
    lists = checkpointed(spark.range(n).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(1), F.lit(m)), lambda i: (F.col("id") + i) % n).alias("others")))
    got, moved = shuffled_rows(spark, lambda: partition.pair_accuracy(a, lists).collect())
    pairs = lists.select("row_id", F.explode("others").alias("other"))
    assert got == partition.pair_accuracy(a, pairs).collect() and moved < n * m + 4 * n


def test_pairwise_batches_read_stored_features_and_lists(spark, monkeypatch):
    """A batch computes neither features nor neighbours again, and a positive's list is one row until its base is known."""
    x = l2_normalize(spark.createDataFrame([(i, i % 7, 1.0) for i in range(200)], "row_id long, fid int, val double"))
    seen, whole = [], partition.pair_gradients

    def record(features, bases, positives, negatives, weights):
        seen.append((features, bases, positives))
        return whole(features, bases, positives, negatives, weights)

    monkeypatch.setattr(partition, "pair_gradients", record)
    partition.fit_pairwise(x, x.select("row_id", (F.col("fid") % 3).alias("label")), 2, epochs=1, num_nn=5, batches=2)
    assert len(seen) == 2
    for d in seen[0] + seen[1]:
        assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    assert all(positives.count() == 200 for _, _, positives in seen)


def test_pair_gradients_of_lists_and_of_pairs(spark):
    """The gradient is that of its definition, whether others come as pairs or as lists."""
    rng = np.random.default_rng(5)
    x = {i: {int(f): float(rng.normal()) for f in rng.choice(6, 2, replace=False)} for i in range(8)}
    w = {(k, f): float(rng.normal()) for k in (0, 1) for f in range(6)}
    base = {i: i % 2 for i in range(8)}
    pos = {i: [(i + 1) % 8, (i + 1) % 8, (i + 3) % 8] for i in range(5)}
    neg = {i: [(i + 2) % 8, (i + 5) % 8] for i in range(8)}  # those of rows without positives do not count
    want = Counter()
    for i, own in pos.items():
        for y, others in ((1, own), (0, neg[i])):
            for j in others:
                e = y - 1 / (1 + np.exp(-sum(v * w[base[i], f] for f, v in x[j].items())))
                for f, v in x[j].items():
                    want[base[i], f] += e * v
    features = spark.createDataFrame([(i, f, v) for i, own in x.items() for f, v in own.items()], "row_id long, fid int, val double")
    bases = spark.createDataFrame([(0, i, k) for i, k in base.items()], "learner int, row_id long, cluster int")
    weights = spark.createDataFrame([(0, k, f, v) for (k, f), v in w.items()], "learner int, k int, fid int, w double")
    lists = [spark.createDataFrame(list(d.items()), "row_id long, others array<long>") for d in (pos, neg)]
    for p, n in (lists, [d.select("row_id", F.explode("others").alias("other")) for d in lists]):
        got = {(r["k"], r["fid"]): r["g"] for r in partition.pair_gradients(features, bases, p, n, weights).collect()}
        assert got.keys() == want.keys() and all(abs(got[at] - g) < 1e-9 for at, g in want.items())


def test_embedding_step_follows_the_numerical_gradient():
    """One base row, its positives and negatives: the applied step is the gradient of the ranking loss by finite differences."""
    from manylabel.operators import embed
    from manylabel.params import Params

    rng = np.random.default_rng(3)
    p = Params(emb_size=3, num_nn=2, emb_iter=1, eta0=1e-6, gamma=2.0)
    # rows share no features, so that each row's part of the matrix gets its own gradient
    x = [(np.arange(2 * i, 2 * i + 2), rng.normal(size=2)) for i in range(5)]
    labels = [np.array([1]), np.array([1]), np.array([1]), np.array([2]), np.array([3])]
    picked = {}

    class Recorder:
        """The learner's random numbers, with one base row and noted negatives."""

        def __init__(self, seed):
            self.inner = np.random.Generator(np.random.PCG64(seed))

        def uniform(self, a, b, shape):
            picked["w"] = self.inner.uniform(a, b, shape)
            return picked["w"].copy()

        def permutation(self, n):
            return np.array([0])

        def integers(self, a, b, n):
            return np.array([3, 4])

    whole, np.random.default_rng = np.random.default_rng, Recorder
    try:
        w, _ = embed._learn(x, labels, 10, p, 1)
    finally:
        np.random.default_rng = whole
    start = picked["w"]

    def loss(w):
        z = [v @ w[f] for f, v in x]
        cos = [z[0] @ z[j] / np.linalg.norm(z[0]) / np.linalg.norm(z[j]) for j in range(5)]
        return sum(np.log1p(sum(np.exp(-p.gamma * (cos[i] - cos[j])) for j in (3, 4))) for i in (1, 2))

    g = np.zeros_like(start)
    for i in np.ndindex(*start.shape):
        e = np.zeros_like(start)
        e[i] = 1e-6
        g[i] = (loss(start + e) - loss(start - e)) / 2e-6
    assert np.allclose((w - start) / p.eta0 * np.sqrt(1 + g * g), -g, atol=1e-3)


def loss_gradient(x, w, pairs, gamma):
    """Finite differences of the ranking objective by the weights; ``pairs`` maps a base row to its positives and negatives."""

    def objective(w):
        z = {i: sum(v * w[f] for f, v in own.items()) for i, own in x.items()}
        cos = lambda i, j: z[i] @ z[j] / np.linalg.norm(z[i]) / np.linalg.norm(z[j])
        return -sum(np.log1p(sum(np.exp(-gamma * (cos(i, p) - cos(i, q))) for q in neg)) for i, (pos, neg) in pairs.items() for p in pos)

    g = np.zeros_like(w)
    for at in np.ndindex(*w.shape):
        e = np.zeros_like(w)
        e[at] = 1e-6
        g[at] = (objective(w + e) - objective(w - e)) / 2e-6
    return g


def test_sharded_step_follows_the_numerical_gradient(spark):
    """A batch of three bases that share features and rows; the step is AdaGrad on the whole batch's gradient."""
    from manylabel.operators import embed
    from manylabel.params import Params

    rng = np.random.default_rng(3)
    p = Params(emb_size=3, gamma=2.0, eta0=0.1)
    x = {i: {int(f): float(rng.normal()) for f in rng.choice(8, 3, replace=False)} for i in range(6)}
    w = rng.normal(size=(8, 3))
    pairs = {0: ([1, 2], [3, 4]), 1: ([0, 2], [4, 5]), 2: ([1, 1], [5, 3])}
    given = [(0, 7, i, role, s, j) for i, near in pairs.items() for role in (1, 0) for s, j in enumerate(near[1 - role])]
    given += [(0, 7, 5, 1, 0, 4)]  # a base without negatives has no gradient
    state = embed.adagrad_step(
        spark.createDataFrame([(0, 7, i, f, v) for i, own in x.items() for f, v in own.items()], "learner int, cluster int, row_id long, fid int, val double"),
        spark.createDataFrame([(0, 7, f, w[f].tolist(), [1.0] * 3) for f in range(8)], "learner int, cluster int, fid int, w array<double>, grown array<double>"),
        spark.createDataFrame(given, "learner int, cluster int, row_id long, role int, slot int, other long"),
        p,
    )
    got = {r["fid"]: r for r in state.collect()}
    g = loss_gradient(x, w, pairs, p.gamma)
    assert np.allclose([got[f]["grown"] for f in range(8)], 1 + g * g, atol=1e-5)
    assert np.allclose([got[f]["w"] for f in range(8)], w + p.eta0 * g / np.sqrt(1 + g * g), atol=1e-5)


def test_tiles_of_the_sharded_step(spark):
    """Whatever the tiles, sums by row and by feature are those of a matrix product; a batch shuffles tiles and vectors, no entries."""
    from manylabel.operators import embed

    rng = np.random.default_rng(9)
    n, m, size = 120, 40, 3
    x = np.where(rng.random((n, m)) < 0.5, rng.normal(size=(n, m)), 0)
    x[7] = 0
    x[7, 39] = 1  # a row of an unknown feature alone
    w, g = rng.normal(size=(39, size)), rng.normal(size=(50, size))  # rows from 50 on have no gradient
    one = {"learner": F.lit(0), "cluster": F.lit(2)}
    entries = checkpointed(spark.createDataFrame([(int(i), int(f), float(x[i, f])) for i, f in zip(*np.nonzero(x))], "row_id long, fid int, val double").withColumns(one))
    state = checkpointed(spark.createDataFrame([(f, v.tolist()) for f, v in enumerate(w)], "fid int, w array<double>").withColumns(one))
    gradients = checkpointed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(g)], "row_id long, g array<double>").withColumns(one))
    for shape in ((1, 1), (3, 4)):
        tiles = checkpointed(embed.packed(entries, shape))
        assert tiles.count() <= shape[0] * shape[1]
        got, moved = shuffled_rows(spark, lambda: embed.projected(tiles, state, size, shape).collect())
        assert {r["row_id"] for r in got} == set(range(n)) and moved <= shape[0] * shape[1] + 39 * shape[1] + n * shape[0] < entries.count()
        assert np.allclose([r["z"] for r in sorted(got, key=lambda r: r["row_id"])], x[:, :39] @ w)
        by = {r["fid"]: r["g"] for r in embed.feature_gradients(tiles, gradients, size, shape).collect()}
        assert by.keys() == {f for f in range(m) if x[:50, f].any()} and all(np.allclose(v, x[:50, f] @ g) for f, v in by.items())


def test_large_clusters_are_learned_whole(spark):
    """One cluster above the bound and one below, four topics each: both get one matrix, and neighbours agree on the topic."""
    from manylabel.operators import embed
    from manylabel.params import Params

    rng = np.random.default_rng(12)
    topic = lambda i: i % 4
    x = [(i, int(f), 1.0) for i in range(480) for f in {*(30 * topic(i) + rng.integers(0, 30, 4)), *(120 + rng.integers(0, 40, 3))}]
    features = spark.createDataFrame(x, "row_id long, fid int, val double")
    labels = spark.createDataFrame([(i, topic(i)) for i in range(480)], "row_id long, label int")
    assigned = spark.createDataFrame([(0, int(i >= 400), i) for i in range(480)], "learner int, cluster int, row_id long")
    p = Params(emb_size=8, num_nn=4, emb_iter=2, seed=3)
    w, emb = embed.fit(l2_normalize(features), labels, assigned, p, max_rows=100, batches=3)
    assert {r["cluster"]: r["n"] for r in emb.groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {0: 400, 1: 80}
    assert w.where("cluster = 0").select("fid").distinct().count() == w.where("cluster = 0").count() > 100
    near = neighbors.knn(emb.withColumnRenamed("row_id", "query_id"), emb, 1, within=("learner", "cluster"), exclude_self=True)
    right = near.groupBy("cluster").agg(F.avg((F.col("query_id") % 4 == F.col("row_id") % 4).cast("double")).alias("p")).collect()
    assert all(r["p"] > 0.9 for r in right)
    again = embed.project(l2_normalize(features), w, assigned).join(emb.withColumnRenamed("emb", "unit"), ["learner", "cluster", "row_id"])
    assert again.count() == 480


def test_empty_rows(spark):
    x = spark.createDataFrame([], "row_id long, fid int, val double")
    w = spark.createDataFrame([], "learner int, k int, fid int, w double")
    assert partition.nearest_cluster(x, w, 2).count() == 0
    assert l2_normalize(x).count() == 0


@pytest.mark.parametrize("k", [1, 3, 7, 40])
def test_best_of_a_tile(k):
    """As a stable sort of each line finds them, with ties, endless scores and none at all."""
    rng = np.random.default_rng(5)
    s = rng.integers(0, 6, (50, 30)).astype(float)
    s[rng.random(s.shape) < 0.2], s[3], s[4, 5] = -np.inf, -np.inf, np.nan
    at, of = neighbors._best_of_tile(s, k)
    sound = np.where(np.isfinite(s), s, -np.inf)
    for i, line in enumerate(sound):
        want = [j for j in np.argsort(-line, kind="stable")[:k] if line[j] > -np.inf]
        assert sorted(of[at == i].tolist()) == sorted(want)


def test_projection_shuffles_rows_and_not_their_dimensions(spark):
    from manylabel.operators import embed

    features = checkpointed(spark.range(900).select((F.col("id") / 3).cast("long").alias("row_id"), (F.col("id") % 3).cast("int").alias("fid"), F.lit(2.0).alias("val")))
    matrix = spark.range(3).select(F.lit(0).alias("learner"), F.lit(0).alias("cluster"), F.col("id").cast("int").alias("fid"), F.array_repeat(F.col("id") / 2, 50).alias("w"))
    assigned = spark.range(300).select(F.lit(0).alias("learner"), F.lit(0).alias("cluster"), F.col("id").alias("row_id"))
    got, moved = shuffled_rows(spark, lambda: embed.project(features, matrix, assigned).collect())
    assert len(got) == 300 and all(r["emb"] == [3.0] * 50 for r in got) and moved < 5000


def test_reindex_sorts_no_group_in_one_task(spark):
    from manylabel.functions.vectors import reindex

    d = spark.range(3000).select((F.col("id") % 2).alias("cluster"), (F.col("id") * 7 % 500).alias("label"))
    out = reindex(d, "label", "cluster")
    got = {(r["cluster"], r["label"]): r["new_id"] for r in out.collect()}
    assert got == {(c, x): i for c in (0, 1) for i, x in enumerate(sorted({k * 7 % 500 for k in range(c, 3000, 2)}), 1)}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_frontier_search_of_small_parts_sends_no_pairs(spark, monkeypatch):
    """Parts that a task holds are walked there, with the results of the rounds of joins; a query is not sent to each part, nor a pair to anywhere."""
    rng = np.random.default_rng(31)
    x = rng.normal(size=(900, 8))
    x[600:660] = x[:60]  # copies: equal distances
    far = 2**60  # ids that a double does not hold
    d = spark.createDataFrame([(far + i * 7 % 1021, i % 2, v.tolist()) for i, v in enumerate(x)] + [(5, 2, x[0].tolist())], "row_id long, cluster int, emb array<double>")
    index = checkpointed(neighbors.build_index(d, 8, ("cluster",), part_rows=90))
    tree = neighbors.grow_tree(index, 12, ("cluster", "part"))
    q = checkpointed(d.where("row_id % 9 = 0 OR cluster = 2").withColumnRenamed("row_id", "query_id"))  # cluster 2 has one row, and it is the query
    got = {}
    for bound, small in ((0, 1024), (95, 0), (4096, 1024)):  # by joins, both ways (part sizes differ) with distances of pairs, in tasks
        monkeypatch.setattr(neighbors, "WALK", bound)
        monkeypatch.setattr(neighbors, "SMALL", small)
        monkeypatch.setattr(neighbors, "GROUPS", 1)
        (found, visited), moved = shuffled_rows(spark, lambda: [sorted(map(tuple, f.collect())) for f in neighbors.search_frontier(q, index, 5, 0.1, ("cluster",), exclude_self=True, tree=tree)])
        got[bound, small] = found, visited, moved
    assert len(got[0, 1024][0]) == 5 * (q.count() - 1) and (2, 5, 1) in got[0, 1024][1] and all(g[:2] == got[0, 1024][:2] for g in got.values())
    sizes = {r["count"] > 95 for r in index.groupBy("cluster", "part").count().collect()}
    assert sizes == {True, False} and got[4096, 1024][2] < got[0, 1024][2] / 5


def test_pairwise_learner_has_the_partners_of_frequent_labels(spark, monkeypatch):
    """A label of so many rows that its pairs are over 5,000 a row: its rows are learned from all the same."""
    n, seen = 5200, []
    x = checkpointed(l2_normalize(spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fid"), F.lit(1.0).alias("val"))))

    def record(features, bases, positives, negatives, weights):
        seen.append({r["row_id"]: r["others"] for r in positives.collect()})
        return features.limit(0).select(F.lit(0).alias("learner"), F.lit(0).alias("k"), "fid", F.lit(0.0).alias("g"))

    monkeypatch.setattr(partition, "pair_gradients", record)
    partition.fit_pairwise(x, x.select("row_id", F.lit(4).alias("label")), 2, epochs=1, num_nn=2, batches=1)
    assert seen == [{i: [j for j in range(3) if j != i][:2] for i in range(n)}]


def test_documents_terms_are_never_shuffled(spark, sf):
    """A document is shuffled as one row of text; its terms are counted and normalised where they are."""
    from manylabel.plans import fixtures

    features = l2_normalize(fixtures.documents(spark, sf)[0])
    n = fixtures.table(spark, sf, "documents").count()
    terms, moved = shuffled_rows(spark, lambda: [tuple(r) for r in features.groupBy().agg(F.count("*"), F.round(F.sum(F.col("val") * F.col("val")), 6)).collect()])
    assert moved < 2 * n < terms[0][0]
    texts = {r["doc_id"]: r["text"] for r in fixtures.table(spark, sf, "documents").collect()}
    assert terms[0][1] == sum(bool(re.search(r"[A-Za-z0-9_]", t or "")) for t in texts.values())


def test_embeddings_without_stored_matrices(spark):
    """The same embeddings; what is stored are they alone."""
    rng = np.random.default_rng(3)
    features = checkpointed(spark.createDataFrame([(i, int(f), 1.0) for i in range(60) for f in rng.choice(400, 8, replace=False)], "row_id long, fid int, val double"))
    labels = spark.createDataFrame([(i, i % 3) for i in range(60)], "row_id long, label int")
    assigned = spark.createDataFrame([(0, i % 2, i) for i in range(60)], "learner int, cluster int, row_id long")
    p = Params(emb_size=4, num_nn=2, emb_iter=1)
    (w, emb), (none, alone) = embed.fit(features, labels, assigned, p), embed.fit(features, labels, assigned, p, matrices=False)
    assert w.count() > 100 and none is None and sorted(map(tuple, emb.collect())) == sorted(map(tuple, alone.collect()))
    size = lambda d: sum(os.path.getsize(f.removeprefix("file:")) for f in d.inputFiles())
    assert size(alone) < size(emb) / 2


def test_negatives_are_drawn_where_the_base_is(spark):
    """Draws given as a column of the row's id are shuffled once, and give the gradients of the same draws as pairs."""
    n, m = 1500, 12
    features = checkpointed(spark.range(n).select((F.col("id") * 3).alias("row_id"), (F.col("id") % 11).cast("int").alias("fid"), (1.0 + F.col("id") % 4).alias("val")))
    rows = features.select("row_id")
    bases = checkpointed(rows.select(F.lit(0).alias("learner"), "row_id", (F.col("row_id") % 2).cast("int").alias("cluster")))
    positives = checkpointed(rows.where("row_id % 5 <> 0").select("row_id", F.array((F.col("row_id") + 3) % (3 * n)).alias("others")))
    weights = spark.createDataFrame([(0, k, f, 0.1 * f - 0.3 * k) for k in range(2) for f in range(11)], "learner int, k int, fid int, w double")
    numbered = checkpointed(partition.dense_numbers(rows))
    index = numbered.select(F.col("number").alias("negative"), F.col("row_id").alias("other"))
    pairs = labelgraph.negatives(rows, m, n).join(index.hint("merge"), "negative").select("row_id", "other")
    read = lambda g: {(r["k"], r["fid"]): round(r["g"], 9) for r in g.collect()}
    whole, many = shuffled_rows(spark, lambda: read(partition.pair_gradients(features, bases, positives, pairs, weights)))
    got, few = shuffled_rows(spark, lambda: read(partition.pair_gradients(features, bases, positives, labelgraph.negative_list(F.col("row_id"), m, n), weights, numbered)))
    assert got == whole and len(got) == 22 and few < many - n * m


def test_sharded_learner_shuffles_neither_entries_nor_the_matrix(spark, monkeypatch):
    """Each batch reads tiles and matrix where they are stored, in the plans as they are run."""
    rng = np.random.default_rng(41)
    features = checkpointed(spark.createDataFrame([(i, int(f), 1.0) for i in range(120) for f in rng.choice(300, 9, replace=False)], "row_id long, fid int, val double"))
    labels = spark.createDataFrame([(i, i % 3) for i in range(120)], "row_id long, label int")
    assigned = spark.createDataFrame([(0, 0, i) for i in range(120)], "learner int, cluster int, row_id long")
    seen, whole = [], embed.adagrad_step

    def record(x, state, *rest):
        seen.append((x, state, whole(x, state, *rest)))
        return seen[-1][-1]

    monkeypatch.setattr(embed, "adagrad_step", record)
    monkeypatch.setattr(embed, "TILE", 200)
    monkeypatch.setattr(embed, "MAX_TILE", 200)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        w, emb = embed.fit(features, labels, assigned, Params(emb_size=4, num_nn=2, emb_iter=1), max_rows=0, batches=1)
        (tiles, state, new) = seen[0]
        plan = new._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(seen) == 1 and emb.count() == 120 and w.count() == features.select("fid").distinct().count() and tiles.count() > 4
    sides = [b for a, b in zip(plan.splitlines(), plan.splitlines()[1:]) if "FileScan" in b and "Exchange" in a]
    assert "Bucketed: true" in plan and not [x for x in plan.splitlines() if "row_id_at" in x and "Exchange" in x] and not [x for x in sides if "grown" in x]


def test_tiles_grow_before_they_become_more(spark):
    shapes = []
    for n in (10, 4_000, 40_000):
        d = spark.range(n).select((F.col("id") % 100).alias("row_id"), (F.col("id") % 97).alias("fid"))
        old = embed.TILE, embed.MAX_TILE, embed.TILES
        embed.TILE, embed.MAX_TILE, embed.TILES = 500, 2000, 4
        try:
            shapes.append(embed.tile_shape(d))
        finally:
            embed.TILE, embed.MAX_TILE, embed.TILES = old
    assert [a * b for a, b in shapes] == [1, 4, 20]


def test_pairwise_batches_shuffle_no_features(spark, monkeypatch):
    """Rows are scored once in a batch, where their features are stored; the state is joined where it is."""
    rng = np.random.default_rng(17)
    x = l2_normalize(spark.createDataFrame([(i, int(f), 1.0) for i in range(300) for f in rng.choice(150, 20, replace=False)], "row_id long, fid int, val double"))
    labels = spark.createDataFrame([(i, i % 3) for i in range(300)], "row_id long, label int")
    scored, plans, moved, whole, step = [], [], [], partition.row_scores, partition.ftrl_step

    def record(features, weights, k):
        got, n = shuffled_rows(spark, lambda: whole(features, weights, k))
        moved.append(n)
        scored.append((got, partition.scores(features, weights), partition.nearest_cluster(features, weights, k, got.select("learner").distinct())))
        return got

    def planned(state, gradients, *rest):
        out = step(state, gradients, *rest)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(partition, "row_scores", record)
    monkeypatch.setattr(partition, "ftrl_step", planned)
    monkeypatch.setattr(partition, "emptied", lambda *_: None)  # earlier states are read below
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        w = partition.fit_pairwise(x, labels, 3, learners=2, epochs=2, num_nn=3, lam=0.01, batches=1, seed=5)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    read = lambda d, *c: sorted((*(r[i] for i in c[:-1]), round(r[c[-1]], 9)) for r in d.collect())
    assert w.count() > 100 and len(scored) == 2 and max(moved) < 1000  # of 6,000 features
    for got, want, near in scored:
        assert read(got, "learner", "row_id", "k", "score") == read(want, "learner", "row_id", "k", "score")
        best = partition.nearest_by_scores(x.select("row_id").distinct(), got, 3, got.select("learner").distinct())
        assert read(best, "learner", "row_id", "cluster", "score") == read(near, "learner", "row_id", "cluster", "score")
    for plan in plans:
        lines = plan.splitlines()
        scans = [(a, b) for a, b in zip(lines, lines[1:]) if "FileScan" in b]
        assert not [b for a, b in scans if "Exchange" in a and ("val#" in b or "z#" in b)]
