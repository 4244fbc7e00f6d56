"""Training and prediction from end to end, and the command line.

    python -m manylabel.plans.pipeline train settings.json [key=value ...]
    python -m manylabel.plans.pipeline predict settings.json [key=value ...]
    python -m manylabel.plans.pipeline score [--ordered] RESULTS [TRAIN_FILE A B]

``--ordered`` keeps the order of the predictions in the file instead of that of their scores.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as settings
from ..functions.vectors import l2_normalize
from ..operators import embed, metrics, neighbors, partition, vote
from ..params import Params
from ..session import checkpointed
from ..sources import svmlight
from ..sources.model import Model


def train(features: DataFrame, labels: DataFrame, p: Params) -> Model:
    x = checkpointed(l2_normalize(features))
    n = x.select("row_id").distinct().count()
    k = p.clusters(n)
    learners = features.sparkSession.range(p.num_learner).select(F.col("id").cast("int").alias("learner"))
    if k == 1:  # nothing to learn: every row is of cluster 0
        w = features.sparkSession.createDataFrame([], "learner int, k int, fid int, w double")
        assigned = x.select("row_id").distinct().join(F.broadcast(learners)).select("learner", "row_id", F.lit(0).alias("cluster"))
    else:
        if p.cls_type == 0:
            w, _ = partition.fit_kmeans(x, k, p.num_learner, p.cls_iter, p.seed)
        else:
            w = partition.fit_pairwise(x, labels, k, p.num_learner, p.cls_iter, p.num_nn, p.eta0, p.lam, p.seed, normalize=p.label_normalize > 0)
        if p.hash_bits:
            w = partition.hash_weights(w, 1 + x.agg(F.max("fid")).first()[0], p.hash_bits)
        assigned = partition.nearest_cluster(x, w, k, learners)
    assigned = checkpointed(assigned.select("learner", "row_id", "cluster"))
    w_emb, emb = embed.fit(x, labels, assigned, p)
    index = neighbors.build_index(emb, p.num_edge) if p.pred_type > 0 else None  # built once, and saved with the model
    return Model(labels, w.select("learner", "k", "fid", "w"), assigned, w_emb, emb, index)


def predict(model: Model, features: DataFrame, p: Params) -> DataFrame:
    """``(query_id, rank, label, score)``: the best labels of each row by votes over learners."""
    x = l2_normalize(features)
    emb = model.embeddings.where(F.col("learner") < p.num_learner)
    learners = emb.select("learner").distinct()
    has_clusters = bool(model.clusters.take(1))
    k = 1 + (model.clusters.agg(F.max("k")).first()[0] if has_clusters else 0)
    if has_clusters:
        assigned = partition.nearest_cluster(x, model.clusters.where(F.col("learner") < p.num_learner), k, learners)
    else:
        assigned = x.select("row_id").distinct().join(F.broadcast(learners)).withColumn("cluster", F.lit(0))
    q = embed.project(x, model.projections, assigned).withColumnRenamed("row_id", "query_id")
    within = ("learner", "cluster")
    if p.pred_type > 0:
        index = model.index if model.index is not None else neighbors.build_index(emb, p.num_edge, within)
        near = neighbors.search_index(q, index.where(F.col("learner") < p.num_learner), p.num_nn, p.search_eps, within, p.seed)
    else:
        near = neighbors.knn(q, emb, p.num_nn, "cosine", within)
    return vote.top_labels(vote.label_scores(vote.neighbor_votes(near), model.labels), p.top_labels)


def main(argv: list[str]) -> int:
    spark = SparkSession.builder.getOrCreate()
    ordered = "--ordered" in argv
    mode, path, *rest = (a for a in argv if a != "--ordered")
    if mode == "score":
        d, true, pred = svmlight.read_results(spark, path)
        pred = metrics.rerank(pred, ordered)
        out = [("P", metrics.precision_at_k(pred, true, d)), ("nDCG", metrics.ndcg_at_k(pred, true, d))]
        if rest:
            rows = svmlight.read_dataset(spark, rest[0])
            w, unseen = metrics.propensities(svmlight.labels_of(rows), rows.count(), *map(float, rest[1:3]))
            out = [("PSP", metrics.psp_at_k(pred, true, w, unseen)), ("PSnDCG", metrics.psndcg_at_k(pred, true, w, unseen))]
        print(f"#samples={d.count()}")
        for name, values in out:
            for r in values.orderBy("k").collect():
                print(f"{name}@{r['k']}={r['value']:.6f}")
        return 0
    p = settings.override(settings.from_json(path), rest)
    if mode == "train":
        rows = checkpointed(svmlight.read_dataset(spark, p.train_file))
        train(svmlight.features_of(rows), svmlight.labels_of(rows), p).save(p.model_file)
    elif mode == "predict":
        rows = checkpointed(svmlight.read_dataset(spark, p.predict_file, keep_unlabelled=True))
        found = predict(Model.load(spark, p.model_file, p.num_learner), svmlight.features_of(rows), p).withColumnRenamed("query_id", "row_id")
        true = svmlight.labels_of(rows)
        svmlight.write_results(found, true, p.result_file)
    else:
        raise SystemExit("the first argument is train, predict or score")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
