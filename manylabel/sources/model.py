"""A model is a folder of Parquet tables; those with a learner are partitioned by it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Columns of the tables; the learner is the folder, and a table without rows still has its columns.
TABLES = {
    "labels": "row_id long, label int",
    "clusters": "k int, fid int, w double, learner int",
    "assignments": "cluster int, row_id long, learner int",
    "projections": "cluster int, fid int, w array<double>, learner int",
    "embeddings": "cluster int, row_id long, emb array<double>, learner int",
    "index": "cluster int, part int, row_id long, emb array<double>, edges array<long>, learner int",
}


@dataclass
class Model:
    """labels(row_id, label); clusters(learner, k, fid, w); assignments(learner, cluster, row_id); projections(learner, cluster, fid, w); embeddings(learner, cluster, row_id, emb)."""

    labels: DataFrame
    clusters: DataFrame
    assignments: DataFrame
    projections: DataFrame
    embeddings: DataFrame
    #: index(learner, cluster, part, row_id, emb, edges) of the graph search; without one a search builds its own.
    index: DataFrame | None = None

    def save(self, path: str) -> None:
        for name, schema in TABLES.items():
            d = getattr(self, name)
            if d is None:  # none must not leave an older one
                d = self.embeddings.sparkSession.createDataFrame([], schema)
            w = d.select(*[F.col(f.name).cast(f.dataType) for f in _columns(schema)]).write.mode("overwrite")
            (w if name == "labels" else w.partitionBy("learner")).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, num_learner: int | None = None) -> Model:
        """The first learners only, by partition pruning."""
        read = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}
        if num_learner is not None:
            read = {k: d if k == "labels" else d.where(F.col("learner") < num_learner) for k, d in read.items()}
        if not read["index"].take(1):
            del read["index"]
        return cls(**read)


def _columns(schema: str) -> list[StructField]:
    return StructType.fromDDL(schema).fields


def sizes(weights: DataFrame, embeddings: DataFrame | None = None, projections: DataFrame | None = None, index: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Part, number of non-zero values, and density over its groups' full shape.

    Parts are the clusters' weights; the embeddings; the projections (non-zero values, over all features of any cluster); the index (edges, over the
    vertices' possible ones) and its trees (nodes, over the leaves' rows).
    """
    w = weights.where(F.abs("w") > 0)
    shape = weights.agg(F.countDistinct("k").alias("k"), F.countDistinct("fid").alias("f"))
    out = w.agg(F.count("*").alias("n_values")).join(shape).select(F.lit("clusters").alias("part"), "n_values", (F.col("n_values") / (F.col("k") * F.col("f"))).alias("density"))
    if embeddings is not None:
        out = out.union(embeddings.agg(F.sum(F.size("emb")).alias("n_values")).select(F.lit("embeddings"), "n_values", F.lit(1.0)))
    if projections is not None:
        held = F.sum(F.size(F.filter("w", lambda x: x != 0))).alias("n_values")
        d = projections.agg(held, F.countDistinct("learner", "cluster").alias("g"), F.countDistinct("fid").alias("f"), F.max(F.size("w")).alias("e"))
        out = out.union(d.select(F.lit("projections"), "n_values", F.col("n_values") / (F.col("g") * F.col("f") * F.col("e"))))
    if index is not None:
        d = index.agg(F.sum(F.size("edges")).alias("n_values"), F.count("*").alias("n"))
        out = out.union(d.select(F.lit("index"), "n_values", F.col("n_values") / (F.col("n") * (F.col("n") - 1))))
    if nodes is not None:
        d = nodes.agg(F.count("*").alias("n_values"), F.sum(F.when(F.col("node") == 1, F.col("n"))).alias("n"))
        out = out.union(d.select(F.lit("tree"), "n_values", F.col("n_values") / F.col("n")))
    return out
