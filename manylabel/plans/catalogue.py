"""Every query by name, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize, long_form, reindex
from ..operators import embed, labelgraph, metrics, neighbors, partition, vote
from ..params import Params
from ..session import checkpointed, shared_path
from ..sources import model, svmlight
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _rounded(d: DataFrame, *names: str) -> DataFrame:
    return d.withColumns({n: F.round(n, 6) + 0.0 for n in names})  # no negative zeros


# rows and labels


@query("Q01_parse_lines", f"""WITH {fx.ORDERS}
SELECT row_id, l.labels, f.features FROM (SELECT row_id, string_agg(label::VARCHAR, ',' ORDER BY label) AS labels FROM lab GROUP BY row_id) l
JOIN (SELECT row_id, string_agg(fid || ':' || val::INT, ' ' ORDER BY fid) AS features FROM feat GROUP BY row_id) f USING (row_id)""")
def _(spark, sf_dir):
    d = svmlight.parse_lines(fx.lines(spark, sf_dir))
    features = F.transform("features", lambda f: F.concat_ws(":", f["fid"].cast("string"), f["val"].cast("int").cast("string")))
    return d.select("row_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), F.array_join(features, " ").alias("features"))


@query("Q02_dataset_summary", f"WITH {fx.ORDERS} SELECT (SELECT count(DISTINCT row_id) FROM feat) AS n_data, (SELECT max(fid) FROM feat)::BIGINT AS n_feature, (SELECT max(label) FROM lab)::BIGINT AS n_label")
def _(spark, sf_dir):
    return svmlight.summary(*fx.orders(spark, sf_dir))


@query("Q03_l2_normalize", f"WITH {fx.ORDERS} SELECT row_id, fid, round(val / sqrt(sum(val * val) OVER (PARTITION BY row_id)), 6) AS val FROM feat")
def _(spark, sf_dir):
    return _rounded(l2_normalize(fx.orders(spark, sf_dir)[0]), "val").select("row_id", "fid", "val")


@query("Q04_label_frequency", f"WITH {fx.ORDERS} SELECT label, count(*)::BIGINT AS n FROM lab GROUP BY label")
def _(spark, sf_dir):
    return labelgraph.frequencies(fx.orders(spark, sf_dir)[1])


@query("Q05_head_label_threshold", f"""WITH {fx.ORDERS},
f AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
r AS (SELECT n, sum(n * n - n) OVER (ORDER BY n, label ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT b.budget::INT AS budget, coalesce(max(n) FILTER (run <= b.budget * (SELECT count(DISTINCT row_id) FROM lab)), 0)::BIGINT AS threshold
FROM r, (VALUES (100), (5000)) b(budget) GROUP BY b.budget""")
def _(spark, sf_dir):
    _, labels = fx.orders(spark, sf_dir)
    freq = labelgraph.frequencies(labels)
    n = labels.agg(F.countDistinct("row_id")).first()[0]
    one = lambda b: labelgraph.head_threshold(freq, n * b).select(F.lit(b).alias("budget"), "threshold")
    return one(100).union(one(5000))


def _knn_sql(base: str, m: int, within: str = "", lab: str = "lab") -> str:
    """CTEs up to ``ranked(row_id, neighbor, score, rank)``."""
    same = f"AND a.{within} = b.{within}" if within else ""
    return f"""{base},
shared AS (SELECT a.row_id, b.row_id AS neighbor, count(*) AS common FROM {lab} a JOIN {lab} b ON a.label = b.label {same} WHERE a.row_id <> b.row_id GROUP BY ALL),
sizes AS (SELECT row_id AS neighbor, count(*) AS size FROM {lab} GROUP BY row_id),
scored AS (SELECT row_id, neighbor, common / size::DOUBLE AS score FROM shared JOIN sizes USING (neighbor)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, neighbor)::INT AS rank FROM scored) WHERE rank <= {m})"""


@query("Q06_label_knn", f"WITH {_knn_sql(fx.ORDERS, 10)} SELECT row_id, rank, neighbor, round(score, 6) AS score FROM ranked")
def _(spark, sf_dir):
    return _rounded(labelgraph.label_knn(fx.orders(spark, sf_dir)[1], 10), "score")


@query("Q06b_label_knn_in_cluster", "WITH " + _knn_sql(fx.ORDERS.replace("lab AS (SELECT DISTINCT l_orderkey AS row_id,", "lab AS (SELECT DISTINCT l_orderkey AS row_id, l_orderkey % 4 AS cluster,"), 10, "cluster") + " SELECT row_id % 4 AS cluster, row_id, rank, neighbor, round(score, 6) AS score FROM ranked")
def _(spark, sf_dir):
    labels = fx.orders(spark, sf_dir)[1].withColumn("cluster", F.col("row_id") % 4)
    return _rounded(labelgraph.label_knn(labels, 10, within=("cluster",)), "score")


_AMPLIFIED = _knn_sql(fx.ORDERS, 10) + """,
amp AS (SELECT r.row_id, s AS slot, r.neighbor FROM ranked r JOIN (SELECT row_id, count(*) AS n FROM ranked GROUP BY row_id) c USING (row_id), range(0, 10) x(s) WHERE r.rank = s % n + 1)"""


@query("Q07_amplified_positives", f"WITH {_AMPLIFIED} SELECT row_id, slot, neighbor FROM amp")
def _(spark, sf_dir):
    return labelgraph.amplified(labelgraph.label_lists(fx.orders(spark, sf_dir)[1], 10), 10)


@query("Q08_negative_samples", f"""WITH {fx.ORDERS}, r AS (SELECT DISTINCT row_id FROM feat)
SELECT row_id, s AS slot, (1103515245 * row_id::BIGINT + 12345 * s + 21) % (SELECT count(*) FROM r) AS negative FROM r, range(0, 10) x(s)""")
def _(spark, sf_dir):
    rows = fx.orders(spark, sf_dir)[0].select("row_id").distinct()
    return labelgraph.negatives(rows, 10, rows.count(), epoch=3)


@query("Q06c_label_knn_pruned", f"""WITH {fx.ORDERS.replace("lab AS", "whole AS")},
f AS (SELECT label, count(*) AS n FROM whole GROUP BY label),
r AS (SELECT n, sum(n * n - n) OVER (ORDER BY n, label ROWS UNBOUNDED PRECEDING) AS run FROM f),
t AS (SELECT coalesce(max(n) FILTER (run <= 50 * (SELECT count(DISTINCT row_id) FROM whole)), 0) AS t FROM r),
lab AS (SELECT row_id, label FROM whole JOIN f USING (label), t WHERE n <= t),
shared AS (SELECT a.row_id, b.row_id AS neighbor, count(*) AS common FROM lab a JOIN lab b ON a.label = b.label WHERE a.row_id <> b.row_id GROUP BY ALL),
sizes AS (SELECT row_id AS neighbor, count(*) AS size FROM whole GROUP BY row_id)
SELECT row_id, rank, neighbor, round(common / size::DOUBLE, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY common / size::DOUBLE DESC, neighbor)::INT AS rank FROM shared JOIN sizes USING (neighbor)) WHERE rank <= 10""")
def _(spark, sf_dir):
    """A budget of 50 pairs a row, which leaves out the labels that most rows share."""
    _, labels = fx.orders(spark, sf_dir)
    freq = labelgraph.frequencies(labels)
    threshold = labelgraph.head_threshold(freq, 50 * labels.agg(F.countDistinct("row_id")).first()[0])
    return _rounded(labelgraph.label_knn(labels, 10, pruned=labelgraph.prune_heads(labels, freq, threshold)), "score")


@query("Q06d_label_knn_hot", f"WITH {_knn_sql(fx.ORDERS + fx.HOT, 10, lab='hot')} SELECT row_id, rank, neighbor, round(score, 6) AS score FROM ranked")
def _(spark, sf_dir):
    """A label in half of all rows, and nothing pruned."""
    return _rounded(labelgraph.label_knn(fx.hot_labels(spark, sf_dir), 10, hot=256), "score")


# partitions

_KMEANS = fx.VECTORS + """,
c AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS k, e AS ce FROM emb QUALIFY k < 8),
s AS (SELECT row_id, k, list_dot_product(e, ce) AS score FROM emb, c),
a AS (SELECT row_id, k AS cluster, score FROM s QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, k) = 1)"""


def _first_eight(spark, sf_dir):
    emb, _ = fx.vectors(spark, sf_dir)
    features = long_form(emb, "row_id", "emb")
    ids = [r[0] for r in emb.select("row_id").orderBy("row_id").limit(8).collect()]
    k = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("row_id")).cast("int") - 1
    w = features.where(F.col("row_id").isin(ids)).select(F.lit(0).alias("learner"), k.alias("k"), "fid", F.col("val").alias("w"))
    return features, w, partition.nearest_cluster(features, w, 8)


@query("Q09_kmeans_assign", f"WITH {_KMEANS} SELECT row_id, cluster::INT AS cluster FROM a")
def _(spark, sf_dir):
    return _first_eight(spark, sf_dir)[2].select("row_id", "cluster")


@query("Q10_kmeans_update", f"""WITH {_KMEANS},
u AS (SELECT cluster, unnest(range(0, 64)) AS fid, unnest(e) AS val FROM a JOIN emb USING (row_id)),
t AS (SELECT cluster, fid, sum(val) AS s FROM u GROUP BY ALL)
SELECT cluster::INT AS k, fid::INT AS fid, round(s / sqrt(sum(s * s) OVER (PARTITION BY cluster)), 6) + 0.0 AS w FROM t""")
def _(spark, sf_dir):
    features, _, a = _first_eight(spark, sf_dir)
    return _rounded(partition.centers(features, a), "w").select("k", "fid", "w")


@query("Q11_kmeans_objective", f"WITH {_KMEANS} SELECT round(avg(score), 6) AS objective FROM a")
def _(spark, sf_dir):
    return _rounded(partition.objective(_first_eight(spark, sf_dir)[2]), "objective").select("objective")


@query("Q12_kmeans_fit")
def _(spark, sf_dir):
    features = long_form(fx.vectors(spark, sf_dir)[0], "row_id", "emb")
    w, _ = partition.fit_kmeans(features, 4, learners=2, max_iter=4, seed=7)
    return partition.nearest_cluster(features, w, 4).groupBy("learner", "cluster").agg(F.count("*").alias("n"))


@query("Q12b_kmeans_objective_rises", "SELECT t::INT AS round, true AS risen FROM range(1, 4) x(t)")
def _(spark, sf_dir):
    """Whether no round of assigning and recentring lowers the objective; all rounds, without the early end."""
    features = long_form(fx.vectors(spark, sf_dir)[0], "row_id", "emb")
    w, history = None, []
    for _ in range(4):
        w, gone = partition.fit_kmeans(features, 4, learners=2, max_iter=1, seed=7, start=w)
        history += gone
    return spark.createDataFrame([(i, b >= a - 1e-9) for i, (a, b) in enumerate(zip(history, history[1:]), 1)], "round int, risen boolean")


@query("Q13_ftrl_step", f"""WITH {_AMPLIFIED},
idx AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i FROM (SELECT DISTINCT row_id FROM feat)),
w AS (SELECT k, fid, ((31 * fid + 17 * k) % 101)::DOUBLE / 128 - 0.390625 AS w FROM (SELECT DISTINCT fid FROM feat), range(0, 2) x(k)),
sc AS (SELECT row_id, k, sum(val * w) AS score FROM feat JOIN w USING (fid) GROUP BY ALL),
base AS (SELECT row_id, k FROM sc QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, k) = 1),
pairs AS (SELECT row_id, neighbor AS other, 1.0::DOUBLE AS y FROM amp
          UNION ALL SELECT b.row_id, idx.row_id, 0.0 FROM base b, range(0, 10) x(s), idx
          WHERE b.row_id IN (SELECT row_id FROM amp) AND idx.i = (1103515245 * b.row_id::BIGINT + 12345 * s) % (SELECT count(*) FROM idx)),
e AS (SELECT b.k, p.other AS row_id, p.y - 1 / (1 + exp(-s.score)) AS e FROM pairs p JOIN base b USING (row_id) JOIN sc s ON s.row_id = p.other AND s.k = b.k),
g AS (SELECT k, fid, sum(e * val) AS g FROM e JOIN feat USING (row_id) GROUP BY ALL),
st AS (SELECT k, fid, w, coalesce(g, 0) AS g, w / 0.1 + sign(w) * 4 AS z FROM w LEFT JOIN g USING (k, fid)),
n2 AS (SELECT k, fid, 1 + g * g AS n, z + g + (sqrt(1 + g * g) - 1) / 0.1 * w AS z FROM st)
SELECT k::INT AS k, fid, round(CASE WHEN abs(z) <= 4 THEN 0 ELSE 0.1 * (z - sign(z) * 4) / sqrt(n) END, 5) + 0.0 AS w, round(n, 5) AS n, round(z, 5) + 0.0 AS z FROM n2""")
def _(spark, sf_dir):
    features, labels = fx.orders(spark, sf_dir)
    features, labels = checkpointed(features), checkpointed(labels)  # read many times
    w = features.select("fid").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    w = w.select(F.lit(0).alias("learner"), "k", "fid", (((31 * F.col("fid") + 17 * F.col("k")) % 101) / 128.0 - 0.390625).alias("w"))
    base = checkpointed(partition.nearest_cluster(features, w, 2))
    pos = labelgraph.label_lists(labels, 10).select("row_id", labelgraph.repeated("near", 10).alias("others"))
    rows = features.select("row_id").distinct()
    neg = labelgraph.negative_list(F.col("row_id"), 10, rows.count())
    g = partition.pair_gradients(features, base, pos, neg, w, partition.dense_numbers(rows))
    out = partition.ftrl_step(partition.ftrl_state(w, 0.1, 4.0), g, 0.1, 4.0)
    return out.select("k", "fid", *[(F.round(c, 5) + 0.0).alias(c) for c in ("w", "n", "z")])


@query("Q14_pairwise_fit")
def _(spark, sf_dir):
    features, labels = fx.orders(spark, sf_dir)
    features = checkpointed(l2_normalize(features))
    w = partition.fit_pairwise(features, labels, 2, learners=1, epochs=1, num_nn=5, lam=0.5, batches=2)
    return partition.nearest_cluster(features, w, 2, spark.range(1).select(F.lit(0).alias("learner"))).groupBy("cluster").agg(F.count("*").alias("n"))


@query("Q14b_negative_draws", f"WITH {fx.ORDERS} SELECT DISTINCT row_id, 5::BIGINT AS n FROM feat")
def _(spark, sf_dir):
    """How many negatives the pairwise learner draws for each row: every draw hits a row."""
    rows = fx.orders(spark, sf_dir)[0].select("row_id").distinct()
    drawn = partition.drawn_negatives(rows, partition.dense_numbers(rows), rows.count(), 5, seed=1, epoch=2)
    return drawn.groupBy("row_id").agg(F.count("*").alias("n"))


@query("Q14c_pairwise_learns", "SELECT 0::INT AS learner, true AS better UNION ALL SELECT 1, true")
def _(spark, sf_dir):
    """Whether, after training on terms and languages, positive pairs are in one cluster more often, by a tenth of them, than clusters of these sizes give by chance."""
    features, labels, _ = fx.documents(spark, sf_dir)
    features = checkpointed(l2_normalize(features))
    w = partition.fit_pairwise(features, labels, 4, learners=2, epochs=2, num_nn=5, lam=0.1, batches=2, seed=3)
    a = checkpointed(partition.nearest_cluster(features, w, 4))
    pos = labelgraph.label_lists(labels, 5).select("row_id", F.col("near").alias("others"))
    share = a.groupBy("learner", "cluster").agg(F.count("*").alias("n")).groupBy("learner").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n") / F.sum("n")).alias("chance"))
    return partition.pair_accuracy(a, pos).join(share, "learner").select("learner", (F.col("accuracy") > F.col("chance") + 0.1).alias("better"))


_ASSIGNED = """
sc AS (SELECT row_id, k, sum(val * ((31 * fid + 17 * k) % 101 - 50)) AS score FROM feat, range(0, 8) x(k) GROUP BY ALL),
a AS (SELECT row_id, k::INT AS cluster FROM sc QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, k) = 1)"""
_CLUSTERS = f"{fx.ORDERS},{_ASSIGNED}"


def _arithmetic_clusters(spark, sf_dir):
    features, labels = fx.orders(spark, sf_dir)
    w = features.select("fid").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(8)])))
    w = w.select(F.lit(0).alias("learner"), "k", "fid", ((31 * F.col("fid") + 17 * F.col("k")) % 101 - 50).cast("double").alias("w"))
    return features, labels, w, partition.nearest_cluster(features, w, 8)


@query("Q15_nearest_cluster", f"WITH {_CLUSTERS} SELECT row_id, cluster FROM a")
def _(spark, sf_dir):
    return _arithmetic_clusters(spark, sf_dir)[3].select("row_id", "cluster")


@query("Q16_cluster_sizes", f"WITH {_CLUSTERS} SELECT cluster, count(*)::BIGINT AS n FROM a GROUP BY cluster")
def _(spark, sf_dir):
    return _arithmetic_clusters(spark, sf_dir)[3].groupBy("cluster").agg(F.count("*").alias("n"))


@query("Q16b_pair_accuracy", f"""WITH {_AMPLIFIED}, {_ASSIGNED}
SELECT count(*)::BIGINT AS n_pairs, count(*) FILTER (a.cluster = b.cluster)::BIGINT AS n_correct, round(count(*) FILTER (a.cluster = b.cluster) / count(*)::DOUBLE, 6) AS accuracy
FROM amp JOIN a USING (row_id) JOIN a b ON b.row_id = amp.neighbor""")
def _(spark, sf_dir):
    _, labels, _, a = _arithmetic_clusters(spark, sf_dir)
    pos = labelgraph.label_lists(labels, 10).select("row_id", labelgraph.repeated("near", 10).alias("others"))
    return _rounded(partition.pair_accuracy(checkpointed(a), pos), "accuracy").select("n_pairs", "n_correct", "accuracy")


@query("Q15b_hashed_weights", f"""WITH {fx.ORDERS}, w AS (SELECT k, fid, ((31 * fid + 17 * k) % 101 - 50)::DOUBLE AS w, (k * 1000003 + fid) & 255 AS slot FROM (SELECT DISTINCT fid FROM feat), range(0, 8) x(k)),
h AS (SELECT k, fid, sum(w) OVER (PARTITION BY slot) AS w FROM w),
sc AS (SELECT row_id, k, sum(val * w) AS score FROM feat JOIN h USING (fid) GROUP BY ALL)
SELECT row_id, k::INT AS cluster, score FROM sc QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, k) = 1""")
def _(spark, sf_dir):
    """The nearest cluster when weights share 256 slots, so that most places collide."""
    features, _, w, _ = _arithmetic_clusters(spark, sf_dir)
    return partition.nearest_cluster(features, partition.hash_weights(w, 1000003, 8), 8).select("row_id", "cluster", "score")


@query("Q17_reindex_labels", f"WITH {_CLUSTERS} SELECT DISTINCT cluster, label, dense_rank() OVER (PARTITION BY cluster ORDER BY label)::INT AS new_id FROM a JOIN lab USING (row_id)")
def _(spark, sf_dir):
    _, labels, _, a = _arithmetic_clusters(spark, sf_dir)
    return reindex(labels.join(a, "row_id"), "label", "cluster")


@query("Q18_project", f"""WITH {_CLUSTERS}
SELECT row_id, cluster, d::INT AS dim, round(sum(val * ((31 * fid + 17 * d) % 101 / 101.0::DOUBLE - 0.5)), 6) + 0.0 AS x FROM feat JOIN a USING (row_id), range(0, 8) x(d) GROUP BY ALL""")
def _(spark, sf_dir):
    features, _, w, a = _arithmetic_clusters(spark, sf_dir)
    vec = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda d: ((31 * F.col("fid") + 17 * d) % 101) / 101.0 - 0.5)
    matrix = w.select("learner", F.col("k").alias("cluster"), "fid", vec.alias("w"))
    d = embed.project(features, matrix, a)
    return d.select("row_id", "cluster", F.posexplode("emb").alias("dim", "x")).withColumn("x", F.round("x", 6) + 0.0)


_PAIRS = """
n AS (SELECT count(*) AS n FROM emb),
pr AS (SELECT row_id, 'p' AS role, t AS slot, (row_id + 1 + t) % n AS other FROM emb, n, range(0, 3) x(t)
       UNION ALL SELECT row_id, 'q', t, (7 * row_id + 13 * t + 5) % n FROM emb, n, range(0, 3) x(t)),
cs AS (SELECT pr.row_id, role, slot::INT AS slot, list_cosine_similarity(a.e, b.e) AS cosine FROM pr JOIN emb a USING (row_id) JOIN emb b ON b.row_id = pr.other)"""


@query("Q19_rank_loss_coefficients", f"""WITH {fx.VECTORS}, {_PAIRS},
t AS (SELECT p.row_id, p.slot AS ps, q.slot AS qs, exp(-10 * (p.cosine - q.cosine)) AS t FROM cs p JOIN cs q USING (row_id) WHERE p.role = 'p' AND q.role = 'q'),
a AS (SELECT row_id, ps, qs, 10 * t / (1 + sum(t) OVER (PARTITION BY row_id, ps)) AS a FROM t)
SELECT row_id, 'p' AS role, ps AS slot, round(sum(a), 6) AS coefficient FROM a GROUP BY ALL UNION ALL SELECT row_id, 'q', qs, round(-sum(a), 6) FROM a GROUP BY ALL""")
def _(spark, sf_dir):
    from ..functions.vectors import dot, norm

    emb, _ = fx.vectors(spark, sf_dir)
    n = emb.count()
    three = F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("slot")
    d = emb.select("row_id", "emb", three)
    pr = d.select("*", F.lit("p").alias("role"), ((F.col("row_id") + 1 + F.col("slot")) % n).alias("other")).union(
        d.select("*", F.lit("q").alias("role"), ((7 * F.col("row_id") + 13 * F.col("slot") + 5) % n).alias("other"))
    )
    cs = pr.join(emb.toDF("other", "emb2"), "other")
    cs = cs.select("row_id", "role", "slot", (dot(F.col("emb"), F.col("emb2")) / (norm(F.col("emb")) * norm(F.col("emb2")))).alias("cosine"))
    return _rounded(embed.rank_coefficients(cs, 10.0), "coefficient")


@query("Q20_embedding_fit")
def _(spark, sf_dir):
    features, labels, assigned = fx.documents(spark, sf_dir)
    p = Params(emb_size=16, num_nn=5, emb_iter=2, seed=1)
    _, emb = embed.fit(l2_normalize(features), labels, assigned, p, matrices=False)
    by = ("learner", "cluster")
    near = neighbors.knn(emb.withColumnRenamed("row_id", "query_id"), emb, 10, within=by, exclude_self=True)
    near = near.select(*by, F.col("query_id").alias("row_id"), F.col("row_id").alias("neighbor"))
    return _rounded(embed.weighted_precision(embed.local_precision(near, labels, by, depth=1)), "precision")


@query("Q20b_embedding_precision", "SELECT true AS enough")
def _(spark, sf_dir):
    """Whether seven tenths of the learned nearest neighbours agree on a document's language."""
    return QUERIES["Q20_embedding_fit"](spark, sf_dir).where("k = 1").select((F.col("precision") > 0.7).alias("enough"))


@query("Q20c_embedding_sharded", "SELECT 1::BIGINT AS clusters, true AS enough")
def _(spark, sf_dir):
    """The same for one cluster of all documents, whose matrix stays a table: seven tenths of the nearest neighbours agree."""
    features, labels, assigned = fx.documents(spark, sf_dir)
    one = assigned.withColumn("cluster", F.lit(0))
    _, emb = embed.fit(l2_normalize(features), labels, one, Params(emb_size=16, num_nn=5, emb_iter=2, seed=1), max_rows=0)
    q = emb.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    near = neighbors.knn(q, emb, 10, within=("learner", "cluster"), exclude_self=True)
    near = near.select("learner", "cluster", F.col("query_id").alias("row_id"), F.col("row_id").alias("neighbor"))
    p = embed.weighted_precision(embed.local_precision(near, labels, ("learner", "cluster"), depth=1))
    return p.select((F.col("precision") > 0.7).alias("enough")).join(emb.agg(F.countDistinct("cluster").alias("clusters"))).select("clusters", "enough")


@query("Q20d_embedding_step", f"""WITH {fx.VECTORS}, {_PAIRS.split("cs AS")[0].rstrip().rstrip(",")},
w AS (SELECT f, d, ((31 * f + 17 * d) % 101)::DOUBLE / 101 - 0.5 AS w FROM range(0, 64) x(f), range(0, 4) y(d)),
u AS (SELECT row_id, f, e[f + 1] AS val FROM emb, range(0, 64) x(f)),
z AS (SELECT row_id, list(x ORDER BY d) AS z FROM (SELECT row_id, d, sum(val * w) AS x FROM u JOIN w USING (f) GROUP BY ALL) GROUP BY row_id),
cs AS (SELECT pr.row_id, role, slot, other, a.z AS za, b.z AS zb, list_dot_product(a.z, b.z) AS i, sqrt(list_dot_product(a.z, a.z)) AS na, sqrt(list_dot_product(b.z, b.z)) AS nb FROM pr JOIN z a USING (row_id) JOIN z b ON b.row_id = pr.other),
t AS (SELECT p.row_id, p.slot AS ps, q.slot AS qs, exp(-10 * (p.i / p.na / p.nb - q.i / q.na / q.nb)) AS t FROM cs p JOIN cs q USING (row_id) WHERE p.role = 'p' AND q.role = 'q'),
a AS (SELECT row_id, ps, qs, 10 * t / (1 + sum(t) OVER (PARTITION BY row_id, ps)) AS a FROM t),
co AS (SELECT row_id, 'p' AS role, ps AS slot, sum(a) AS c FROM a GROUP BY ALL UNION ALL SELECT row_id, 'q', qs, -sum(a) FROM a GROUP BY ALL),
gz AS (SELECT cs.row_id, d, c / (na * nb) * (zb[d + 1] - i / (na * na) * za[d + 1]) AS g FROM cs JOIN co USING (row_id, role, slot), range(0, 4) y(d)
       UNION ALL SELECT cs.other, d, c / (na * nb) * (za[d + 1] - i / (nb * nb) * zb[d + 1]) FROM cs JOIN co USING (row_id, role, slot), range(0, 4) y(d)),
gw AS (SELECT f, d, sum(val * g) AS g FROM (SELECT row_id, d, sum(g) AS g FROM gz GROUP BY ALL) JOIN u USING (row_id) GROUP BY ALL)
SELECT f::INT AS fid, d::INT AS dim, round(w + 0.1 * g / sqrt(1 + g * g), 5) + 0.0 AS w, round(1 + g * g, 2) AS grown FROM gw JOIN w USING (f, d)""")
def _(spark, sf_dir):
    """One batch of the sharded learner over all vectors: projections, ranking gradients of rows, their sums by feature, and the AdaGrad step."""
    emb, _ = fx.vectors(spark, sf_dir)
    n = emb.count()
    one = {"learner": F.lit(0), "cluster": F.lit(0)}
    x = long_form(emb, "row_id", "emb").withColumns(one)
    w = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: ((31 * F.col("fid") + 17 * d) % 101) / 101.0 - 0.5)
    state = x.select("learner", "cluster", "fid").distinct().withColumns({"w": w, "grown": F.array_repeat(F.lit(1.0), 4)})
    three = emb.select("row_id", F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("slot")).withColumns(one)
    pairs = three.withColumns({"role": F.lit(1), "other": (F.col("row_id") + 1 + F.col("slot")) % n}).unionByName(three.withColumns({"role": F.lit(0), "other": (7 * F.col("row_id") + 13 * F.col("slot") + 5) % n}))
    out = embed.adagrad_step(x, state, pairs, Params(emb_size=4, gamma=10.0, eta0=0.1))
    d = out.select("fid", F.posexplode(F.arrays_zip("w", "grown")).alias("dim", "s"))
    return d.select("fid", "dim", (F.round("s.w", 5) + 0.0).alias("w"), F.round("s.grown", 2).alias("grown"))


_LOCAL = """
v AS (SELECT g, n.row_id, label, count(*) AS votes FROM nb n JOIN lab ON lab.row_id = n.neighbor GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, label) AS rank FROM v),
h AS (SELECT g, rank, count(*) AS hits FROM r WHERE rank <= 5 AND (row_id, label) IN (SELECT row_id, label FROM lab) GROUP BY ALL),
ks AS (SELECT k FROM range(1, 6) x(k)), c AS (SELECT g, count(DISTINCT row_id) AS n FROM nb GROUP BY g),
p AS (SELECT c.g, k, n, coalesce(sum(hits), 0) / (n * k)::DOUBLE AS precision FROM c CROSS JOIN ks LEFT JOIN h ON h.g = c.g AND h.rank <= k GROUP BY c.g, k, n)"""
_LOO = """
nb AS (SELECT * FROM (SELECT {g} AS g, a.row_id, b.row_id AS neighbor, row_number() OVER (PARTITION BY a.row_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.row_id) AS rank
       FROM emb a JOIN emb b ON a.row_id <> b.row_id {on}) WHERE rank <= 10)"""


@query("Q21_loo_precision", f"WITH {fx.VECTORS}, {_LOO.format(g=0, on='')}, {_LOCAL} SELECT k, round(precision, 6) AS precision FROM p")
def _(spark, sf_dir):
    emb, labels = fx.vectors(spark, sf_dir)
    near = neighbors.knn(emb.withColumnRenamed("row_id", "query_id"), emb, 10, exclude_self=True)
    near = near.select(F.col("query_id").alias("row_id"), F.col("row_id").alias("neighbor"))
    return _rounded(embed.local_precision(near, labels), "precision").select("k", "precision")


@query("Q22_achievable_precision", f"WITH {_AMPLIFIED}, nb AS (SELECT 0 AS g, row_id, neighbor FROM amp), {_LOCAL} SELECT k, round(precision, 6) AS precision FROM p")
def _(spark, sf_dir):
    _, labels = fx.orders(spark, sf_dir)
    near = labelgraph.amplified(labelgraph.label_lists(labels, 10), 10)
    return _rounded(embed.local_precision(near, labels), "precision").select("k", "precision")


# search


def _knn(spark, sf_dir, metric):
    m = fx.vectors(spark, sf_dir)[0]
    return _rounded(neighbors.knn(fx.search_queries(m), m, 10, metric, exclude_self=True), "score")


def _search_sql(score: str) -> str:
    return f"""WITH {fx.VECTORS},
s AS (SELECT q.row_id AS query_id, m.row_id, {score} AS score FROM emb q, emb m WHERE q.row_id % 20 = 0 AND m.row_id <> q.row_id)
SELECT query_id, rank, row_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id)::INT AS rank FROM s) WHERE rank <= 10"""


@query("Q23_knn_cosine", _search_sql("list_cosine_similarity(q.e, m.e)"))
def _(spark, sf_dir):
    return _knn(spark, sf_dir, "cosine")


@query("Q24_knn_euclid", _search_sql("-list_sum(list_transform(list_zip(q.e, m.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"))
def _(spark, sf_dir):
    return _knn(spark, sf_dir, "euclid")


@query("Q25_knn_graph", f"""WITH {fx.VECTORS},
s AS (SELECT a.row_id AS src, b.row_id AS dst, list_distance(a.e, b.e) ** 2 AS d2 FROM emb a, emb b WHERE a.row_id <> b.row_id)
SELECT src, dst, rank, round(d2, 6) AS d2, round(1 - d2 / 2, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst)::INT AS rank FROM s) WHERE rank <= 50""")
def _(spark, sf_dir):
    from ..functions.vectors import cosine_of_distance

    d = neighbors.knn_graph(fx.vectors(spark, sf_dir)[0], 50)
    return _rounded(d.withColumn("cosine", cosine_of_distance(F.col("d2"))), "d2", "cosine")


@query("Q26_tree_split", f"""WITH {fx.VECTORS},
b0 AS (SELECT * FROM emb WHERE row_id = (SELECT min(row_id) FROM emb)),
a AS (SELECT m.* FROM emb m, b0 WHERE m.row_id <> b0.row_id ORDER BY list_distance(m.e, b0.e) DESC, m.row_id LIMIT 1),
b AS (SELECT m.* FROM emb m, a, b0 WHERE m.row_id NOT IN (a.row_id, b0.row_id) ORDER BY list_distance(m.e, a.e) DESC, m.row_id LIMIT 1)
SELECT m.row_id, (list_sum(list_transform(range(1, 65), lambda i: (b.e[i] - a.e[i]) * (m.e[i] - (a.e[i] + b.e[i]) / 2))) > 0)::INT AS side FROM emb m, a, b""")
def _(spark, sf_dir):
    emb, _ = fx.vectors(spark, sf_dir)
    return neighbors.split(emb, emb.agg(F.min("row_id")).first()[0])


def _level_sql(level: int, leaf: int) -> str:
    """From ``n0(row_id, node, e)``: base, a and b of each full node, and the next level's nodes."""
    i = level
    return f"""
s{i} AS (SELECT node, count(*) AS n, arg_min(e, row_id) AS be, min(row_id) AS bid FROM n{i} GROUP BY node HAVING count(*) > {leaf}),
a{i} AS (SELECT node, e AS ae FROM n{i} JOIN s{i} USING (node) WHERE row_id <> bid QUALIFY row_number() OVER (PARTITION BY node ORDER BY list_distance(e, be) DESC, row_id) = 1),
b{i} AS (SELECT node, e AS be FROM n{i} JOIN s{i} USING (node) JOIN a{i} USING (node) WHERE row_id <> bid QUALIFY row_number() OVER (PARTITION BY node ORDER BY list_distance(e, ae) DESC, row_id) = 1),
n{i + 1} AS (SELECT row_id, CASE WHEN ae IS NULL THEN node WHEN list_sum(list_transform(range(1, 65), lambda i: (b{i}.be[i] - ae[i]) * (e[i] - (ae[i] + b{i}.be[i]) / 2))) > 0 THEN 2 * node + 1 ELSE 2 * node END AS node, e
       FROM n{i} LEFT JOIN a{i} USING (node) LEFT JOIN b{i} USING (node))"""


_TREE = fx.VECTORS + ",\nn0 AS (SELECT row_id, 1::BIGINT AS node, e FROM emb)," + ",".join(_level_sql(i, 32) for i in range(3))


@query("Q26b_tree_levels", f"WITH {_TREE} SELECT row_id, node FROM n3")
def _(spark, sf_dir):
    """Three levels of the tree: each row's node, which tells its path."""
    return neighbors.grow_tree(fx.vectors(spark, sf_dir)[0], leaf=32, levels=3)[0]


@query("Q26c_tree_leaves", "SELECT count(*)::BIGINT AS n_rows, true AS bounded, true AS nested FROM embeddings")
def _(spark, sf_dir):
    """The whole tree: every row is in one leaf, leaves are bounded, and a node has the rows of its two children."""
    leaves, nodes = neighbors.grow_tree(fx.vectors(spark, sf_dir)[0], leaf=32)
    n = leaves.groupBy("node").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_rows"), (F.max("n") <= 32).alias("bounded"))
    both = nodes.where("node > 1").groupBy(F.shiftright("node", 1).alias("node")).agg(F.sum("n").alias("below"), F.count("*").alias("c"))
    whole = nodes.join(both, "node", "left").agg(F.every(F.col("below").isNull() | ((F.col("below") == F.col("n")) & (F.col("c") == 2))).alias("nested"))
    return n.join(whole)


@query("Q27_ball", f"""WITH {fx.VECTORS},
u AS (SELECT row_id, unnest(range(0, 64)) AS dim, unnest(e) AS x FROM emb), c AS (SELECT dim, avg(x) AS mean FROM u GROUP BY dim)
SELECT dim::INT AS dim, round(mean, 6) + 0.0 AS value FROM c
UNION ALL SELECT -1, round(sqrt(max(d2)), 6) FROM (SELECT row_id, sum((x - mean) * (x - mean)) AS d2 FROM u JOIN c USING (dim) GROUP BY row_id)""")
def _(spark, sf_dir):
    mean, radius = neighbors.ball(fx.vectors(spark, sf_dir)[0])
    return _rounded(mean.select("dim", F.col("mean").alias("value")).union(radius.select(F.lit(-1), "radius")), "value")


@query("Q28_graph_search")
def _(spark, sf_dir):
    m = fx.vectors(spark, sf_dir)[0].withColumns({"learner": F.lit(0), "cluster": F.lit(0)})
    return neighbors.graph_search(fx.search_queries(m), m, 10, num_edge=50, eps=0.1, part_rows=256, exclude_self=True)


@query("Q28b_graph_search_recall", "SELECT count(*)::BIGINT * 10 AS n_true, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, sf_dir):
    """Whether the graph search finds nine tenths of the exact neighbours."""
    exact = _knn(spark, sf_dir, "cosine").select("query_id", "row_id")
    found = QUERIES["Q28_graph_search"](spark, sf_dir).select("query_id", "row_id", F.lit(1).alias("hit"))
    d = exact.join(found, ["query_id", "row_id"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("hits"))
    return d.select("n_true", (F.col("hits") >= 0.9 * F.col("n_true")).alias("enough"))


@query("Q28c_frontier_search", "SELECT count(*)::BIGINT * 10 AS n_true, true AS enough, true AS bounded FROM embeddings WHERE vec_id % 20 = 0")
def _(spark, sf_dir):
    """The search in rounds over several parts: recall of nine tenths, and queries that see fewer rows than there are."""
    m = fx.vectors(spark, sf_dir)[0].withColumns({"learner": F.lit(0), "cluster": F.lit(0)})
    index = checkpointed(neighbors.build_index(m, 20, part_rows=256))
    found, visited = neighbors.search_frontier(fx.search_queries(m), index, 10, eps=0.05, exclude_self=True)
    exact = _knn(spark, sf_dir, "cosine").select("query_id", "row_id")
    d = exact.join(found.select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("hits"))
    seen = visited.agg(F.avg("visited").alias("seen"), F.count("*").alias("q")).join(m.agg(F.count("*").alias("n")))
    return d.join(seen).select("n_true", (F.col("hits") >= 0.9 * F.col("n_true")).alias("enough"), ((F.col("seen") < 0.9 * F.col("n")) & (10 * F.col("q") == F.col("n_true"))).alias("bounded"))


# votes and scores


def _neighbours(spark, sf_dir):
    emb, labels = fx.vectors(spark, sf_dir)
    q, m = fx.split_queries(fx.four_learners(emb))
    return neighbors.knn(q, m, 10, within=("learner",)), labels


def _predictions(spark, sf_dir):
    near, labels = _neighbours(spark, sf_dir)
    d = vote.top_labels(vote.label_scores(vote.neighbor_votes(near), labels)).withColumnRenamed("query_id", "row_id")
    true = labels.where("row_id % 5 = 0")
    return d, true, labels.where("row_id % 5 <> 0")


@query("Q29_neighbor_votes", f"WITH {fx.LEARNERS} SELECT query_id, row_id, votes FROM votes")
def _(spark, sf_dir):
    return vote.neighbor_votes(_neighbours(spark, sf_dir)[0])


@query("Q30_label_scores", f"WITH {fx.LEARNERS} SELECT query_id, label, score FROM score")
def _(spark, sf_dir):
    near, labels = _neighbours(spark, sf_dir)
    return vote.label_scores(vote.neighbor_votes(near), labels)


@query("Q31_top_labels", f"WITH {fx.LEARNERS} SELECT row_id, rank, label, score FROM pred")
def _(spark, sf_dir):
    return _predictions(spark, sf_dir)[0]


@query("Q32_render_result", f"""WITH {fx.LEARNERS}
SELECT t.row_id, t.l || chr(9) || coalesce(p.p, '') AS value FROM (SELECT row_id, string_agg(label::VARCHAR, ',' ORDER BY label) AS l FROM true_ GROUP BY row_id) t
LEFT JOIN (SELECT row_id, string_agg(label || ':' || score || '.0', ',' ORDER BY rank) AS p FROM pred GROUP BY row_id) p USING (row_id)""")
def _(spark, sf_dir):
    pred, true, _ = _predictions(spark, sf_dir)
    return svmlight.render_results(pred.withColumn("score", F.col("score").cast("double")), true)


@query("Q33_precision_at_k", f"WITH {fx.LEARNERS} SELECT k, round(sum(hit)::DOUBLE / (k * (SELECT count(DISTINCT row_id) FROM true_)), 6) AS value FROM ks JOIN hit ON rank <= k GROUP BY k")
def _(spark, sf_dir):
    pred, true, _ = _predictions(spark, sf_dir)
    return _rounded(metrics.precision_at_k(pred, true, true), "value")


@query("Q34_ndcg_at_k", f"WITH {fx.LEARNERS} SELECT k, round(sum(hit / log2(rank + 1) / ideal) / (SELECT count(DISTINCT row_id) FROM true_), 6) AS value FROM hit JOIN ideal USING (row_id) WHERE rank <= k GROUP BY k")
def _(spark, sf_dir):
    pred, true, _ = _predictions(spark, sf_dir)
    return _rounded(metrics.ndcg_at_k(pred, true, true), "value")


_TEXT = fx.LEARNERS + """,
o AS (SELECT row_id, label, rank, row_number() OVER (PARTITION BY row_id ORDER BY label) AS place FROM pred),
h2 AS (SELECT 'score' AS ordering, row_id, label, rank FROM o UNION ALL SELECT 'text', row_id, label, place FROM o),
t2 AS (SELECT ordering, h2.row_id, rank, (t.label IS NOT NULL)::INT AS hit FROM h2 LEFT JOIN true_ t USING (row_id, label)),
n2 AS (SELECT count(DISTINCT row_id) + count(DISTINCT row_id) FILTER (row_id % 3 = 0) AS n FROM true_)"""


def _from_text(spark, sf_dir, metric):
    pred, true, _ = _predictions(spark, sf_dir)
    path = shared_path(spark, "results")
    fx.result_lines(pred, true).write.text(path)
    rows, true, pred = svmlight.read_results(spark, path)
    one = lambda name, ordered: metric(metrics.rerank(pred, ordered), true, rows).select(F.lit(name).alias("ordering"), "k", "value")
    return _rounded(one("score", False).union(one("text", True)), "value")


@query("Q33b_precision_from_text", f"WITH {_TEXT} SELECT ordering, k, round(sum(hit)::DOUBLE / (k * (SELECT n FROM n2)), 6) AS value FROM ks JOIN t2 ON rank <= k GROUP BY ordering, k")
def _(spark, sf_dir):
    """From result text, with the predictions ranked by score and as they stand; lines without two parts count as rows."""
    return _from_text(spark, sf_dir, metrics.precision_at_k)


@query("Q34b_ndcg_from_text", f"WITH {_TEXT} SELECT ordering, k, round(sum(hit / log2(rank + 1) / ideal) / (SELECT n FROM n2), 6) AS value FROM t2 JOIN ideal USING (row_id) WHERE rank <= k GROUP BY ordering, k")
def _(spark, sf_dir):
    return _from_text(spark, sf_dir, metrics.ndcg_at_k)


@query("Q35_propensity", f"WITH {fx.LEARNERS} SELECT label, round(weight, 6) AS weight FROM weight UNION ALL SELECT -1, round(unseen, 6) FROM unseen")
def _(spark, sf_dir):
    _, _, train = _predictions(spark, sf_dir)
    w, unseen = metrics.propensities(train, train.select("row_id").distinct().count())
    return _rounded(w.union(spark.range(1).select(F.lit(-1).cast("bigint"), F.lit(unseen))), "weight")


def _scored(spark, sf_dir, metric):
    pred, true, train = _predictions(spark, sf_dir)
    return _rounded(metric(pred, true, *metrics.propensities(train, train.select("row_id").distinct().count())), "value")


@query("Q36_psp_at_k", f"WITH {fx.LEARNERS} SELECT k, round((SELECT sum(weight) FROM got WHERE rank <= k) / (SELECT sum(weight) FROM best WHERE rank <= k), 6) AS value FROM ks")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, metrics.psp_at_k)


@query("Q37_psndcg_at_k", f"""WITH {fx.LEARNERS},
g AS (SELECT k, sum(weight / log2(rank + 1) / ideal) AS g FROM got JOIN ideal USING (row_id) WHERE rank <= k GROUP BY k),
b AS (SELECT k, sum(weight / log2(rank + 1) / ideal) AS b FROM best JOIN ideal USING (row_id) WHERE rank <= k GROUP BY k)
SELECT k, round(g / b, 6) AS value FROM g JOIN b USING (k)""")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, metrics.psndcg_at_k)


@query("Q38_weighted_precision", f"WITH {fx.VECTORS}, {_LOO.format(g='a.row_id % 3', on='AND a.row_id % 3 = b.row_id % 3')}, {_LOCAL} SELECT k, round(sum(precision * n) / sum(n), 6) AS precision FROM p GROUP BY k")
def _(spark, sf_dir):
    emb, labels = fx.vectors(spark, sf_dir)
    emb = emb.withColumn("cluster", F.col("row_id") % 3)
    near = neighbors.knn(emb.withColumnRenamed("row_id", "query_id"), emb, 10, within=("cluster",), exclude_self=True)
    near = near.select("cluster", F.col("query_id").alias("row_id"), F.col("row_id").alias("neighbor"))
    return _rounded(embed.weighted_precision(embed.local_precision(near, labels, ("cluster",))), "precision")


@query("Q39_model_size", f"""WITH {fx.ORDERS}, w AS (SELECT k, fid, (31 * fid + 17 * k) % 101 - 50 AS w FROM (SELECT DISTINCT fid FROM feat), range(0, 8) x(k))
SELECT 'clusters' AS part, count(*) FILTER (w <> 0)::BIGINT AS n_values, round(count(*) FILTER (w <> 0) / count(*)::DOUBLE, 6) AS density FROM w
UNION ALL SELECT 'embeddings', sum(len(embedding))::BIGINT, 1.0 FROM embeddings""")
def _(spark, sf_dir):
    return _rounded(model.sizes(_arithmetic_clusters(spark, sf_dir)[2], fx.vectors(spark, sf_dir)[0]), "density")


@query("Q39b_model_size_of_all_parts", f"""WITH {fx.ORDERS}, {_TREE.lstrip().replace("lab AS", "vlab AS", 1)},
w AS (SELECT k, fid, (31 * fid + 17 * k) % 101 - 50 AS w FROM (SELECT DISTINCT fid FROM feat), range(0, 8) x(k)),
m AS (SELECT k, fid, d, (31 * fid + 17 * d + k) % 101 - 50 AS x FROM w, range(0, 4) y(d)),
v AS (SELECT count(*) AS n FROM emb),
paths AS (SELECT DISTINCT node >> s AS node FROM n3, range(0, 4) x(s) WHERE node >> s > 0)
SELECT 'clusters' AS part, count(*) FILTER (w <> 0)::BIGINT AS n_values, round(count(*) FILTER (w <> 0) / count(*)::DOUBLE, 6) AS density FROM w
UNION ALL SELECT 'embeddings', sum(len(embedding))::BIGINT, 1.0 FROM embeddings
UNION ALL SELECT 'projections', count(*) FILTER (x <> 0)::BIGINT, round(count(*) FILTER (x <> 0) / count(*)::DOUBLE, 6) FROM m
UNION ALL SELECT 'index', (n * least(20, n - 1))::BIGINT, round(least(20, n - 1) / (n - 1)::DOUBLE, 6) FROM v
UNION ALL SELECT 'tree', (SELECT count(*) FROM paths)::BIGINT, round((SELECT count(*) FROM paths) / n::DOUBLE, 6) FROM v""")
def _(spark, sf_dir):
    emb, _ = fx.vectors(spark, sf_dir)
    w = _arithmetic_clusters(spark, sf_dir)[2]
    vec = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: ((31 * F.col("fid") + 17 * d + F.col("k")) % 101 - 50).cast("double"))
    matrix = w.select("learner", F.col("k").alias("cluster"), "fid", vec.alias("w"))
    index = neighbors.build_index(emb.withColumns({"learner": F.lit(0), "cluster": F.lit(0)}), 20)
    return _rounded(model.sizes(w, emb, matrix, index, neighbors.grow_tree(emb, leaf=32, levels=3)[1]), "density")


@query("Q41_model_round_trip", f"""WITH {fx.ORDERS}, {fx.VECTORS.lstrip().replace("lab AS", "vlab AS", 1)},
w AS (SELECT t, k, fid, (31 * fid + 17 * k + t) % 101 - 50 AS w FROM (SELECT DISTINCT fid FROM feat), range(0, 4) x(k), range(0, 2) y(t))
SELECT 'labels' AS part, -1::INT AS learner, count(*)::BIGINT AS n, sum(label)::DOUBLE AS total FROM lab
UNION ALL SELECT 'clusters', t::INT, count(*)::BIGINT, sum(w)::DOUBLE FROM w GROUP BY t
UNION ALL SELECT 'assignments', t::INT, count(*)::BIGINT, sum((row_id + t) % 4)::DOUBLE FROM emb, range(0, 2) y(t) GROUP BY t
UNION ALL SELECT 'embeddings', t::INT, count(*)::BIGINT, round(sum(list_sum(e)), 4) FROM emb, range(0, 2) y(t) GROUP BY t
UNION ALL SELECT 'projections', t::INT, count(*)::BIGINT, sum(w)::DOUBLE FROM w GROUP BY t""")
def _(spark, sf_dir):
    """A model of three learners is saved, and the first two of them are loaded again."""
    features, labels = fx.orders(spark, sf_dir)
    emb, _ = fx.vectors(spark, sf_dir)
    learner = F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("learner")
    w = features.select("fid", learner).distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    w = w.withColumn("w", ((31 * F.col("fid") + 17 * F.col("k") + F.col("learner")) % 101 - 50).cast("double"))
    e = emb.select("row_id", "emb", learner).withColumn("cluster", ((F.col("row_id") + F.col("learner")) % 4).cast("int"))
    path = shared_path(spark, "model")
    model.Model(labels, w, e, w.select("learner", F.col("k").alias("cluster"), "fid", F.array("w").alias("w")), e).save(path)
    m = model.Model.load(spark, path, num_learner=2)
    part = lambda name, d, value: d.groupBy("learner").agg(F.count("*").alias("n"), F.round(F.sum(value), 4).cast("double").alias("total")).select(F.lit(name).alias("part"), "learner", "n", "total")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    out = part("labels", m.labels.withColumn("learner", F.lit(-1)), F.col("label"))
    for name, d, value in (("clusters", m.clusters, F.col("w")), ("assignments", m.assignments, F.col("cluster")), ("embeddings", m.embeddings, total("emb")), ("projections", m.projections, total("w"))):
        out = out.union(part(name, d, value))
    return out


@query("Q40_flagship", f"""WITH {fx.VECTORS},
near AS (SELECT * FROM (SELECT q.row_id AS query_id, m.row_id, row_number() OVER (PARTITION BY q.row_id ORDER BY list_cosine_similarity(q.e, m.e) DESC, m.row_id) AS rank
         FROM emb q, emb m WHERE q.row_id % 5 = 0 AND m.row_id % 5 <> 0) WHERE rank <= 10),
score AS (SELECT query_id AS row_id, label, count(*) AS score FROM near JOIN lab USING (row_id) GROUP BY ALL),
hit AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, label) AS rank FROM score),
t AS (SELECT row_id, label FROM lab WHERE row_id % 5 = 0)
SELECT k::INT AS k, round(count(t.label)::DOUBLE / (k * (SELECT count(DISTINCT row_id) FROM t)), 6) AS value FROM range(1, 6) x(k) JOIN hit ON rank <= k LEFT JOIN t USING (row_id, label) GROUP BY k""")
def _(spark, sf_dir):
    emb, labels = fx.vectors(spark, sf_dir)
    q, m = fx.split_queries(emb)
    pred = vote.top_labels(vote.label_scores(vote.neighbor_votes(neighbors.knn(q, m, 10)), labels)).withColumnRenamed("query_id", "row_id")
    true = labels.where("row_id % 5 = 0")
    return _rounded(metrics.precision_at_k(pred, true, true), "value")
