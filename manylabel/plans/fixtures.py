"""Multi-label rows and vectors derived from the star-schema tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, unit
from ..sources import svmlight


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Features ``(row_id, fid, val)`` (lines by supplier) and labels ``(row_id, label)`` (distinct parts) of each order."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("fid"), F.col("l_partkey").alias("label")).repartition("row_id")
    features = d.groupBy("row_id", "fid").agg(F.count("*").cast("double").alias("val"))  # an order's lines are together from here on
    return features, d.select("row_id", "label").distinct()


def hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of orders, and one more that half of all orders have."""
    labels = orders(spark, sf_dir)[1]
    return labels.union(labels.select("row_id").distinct().where("row_id % 2 = 0").select("row_id", F.lit(0)))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text rows, labels and features in the order of their ids."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("fid"), F.col("l_partkey").alias("label")).repartition("row_id")
    features = d.groupBy("row_id", "fid").agg(F.count("*").cast("double").alias("val"))  # an order's lines are together from here on
    labels = d.select("row_id", "label").distinct()
    f = features.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("fid", "val"))).alias("features"))
    rows = labels.groupBy("row_id").agg(F.sort_array(F.collect_list("label")).alias("labels")).join(f, "row_id")
    return rows.select("row_id", svmlight.render_lines(rows).alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(row_id, emb)`` and labels: the vector's own and 100 + id mod 7."""
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), as_double(F.col("embedding")).alias("emb"), "label")
    labels = d.select("row_id", F.explode(F.array(F.col("label").cast("bigint"), F.lit(100) + F.col("row_id") % 7)).alias("label"))
    return d.select("row_id", "emb"), labels


def search_queries(d: DataFrame) -> DataFrame:
    """The ids divisible by 20 as ``query_id``, to be searched in all rows."""
    return d.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")


def split_queries(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Held-out rows for metrics (ids divisible by 5, as ``query_id``) and the rows to learn from."""
    return d.where("row_id % 5 = 0").withColumnRenamed("row_id", "query_id"), d.where("row_id % 5 <> 0")


def four_learners(d: DataFrame) -> DataFrame:
    """Learner t sees dimensions 16 t to 16 t + 15, renormalised."""
    d = d.withColumn("learner", F.explode(F.array(*[F.lit(t) for t in range(4)])))
    return d.withColumn("emb", unit(F.slice("emb", F.col("learner") * 16 + 1, 16)))


def documents(spark: SparkSession, sf_dir: str, cluster_rows: int = 250) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term counts of documents by a term's hash, language labels, and clusters of about ``cluster_rows``."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text", "lang")
    words = d.select("row_id", "text").repartition("row_id").select("row_id", F.explode(F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")).alias("w"))
    # a document's words are together from here on: it is shuffled once as text, and its terms never
    features = words.groupBy("row_id", F.pmod(F.xxhash64("w"), F.lit(1 << 20)).cast("int").alias("fid")).agg(F.count("*").cast("double").alias("val"))
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    labels = d.where("lang IS NOT NULL").select("row_id", F.array_position(langs, F.col("lang")).cast("int").alias("label"))
    n = max(1, -(-d.count() // cluster_rows))
    assigned = d.select(F.lit(0).alias("learner"), F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int").alias("cluster"), "row_id")
    return features, labels, assigned


def result_lines(predictions: DataFrame, true: DataFrame) -> DataFrame:
    """Result text whose predictions stand in the order of their labels, and a line without two parts for each third row."""
    by_label = predictions.withColumn("rank", F.row_number().over(Window.partitionBy("row_id").orderBy("label")))
    whole = svmlight.render_results(by_label.withColumn("score", F.col("score").cast("double")), true).select("value")
    return whole.union(true.select("row_id").distinct().where("row_id % 3 = 0").select(F.concat(F.lit("alone"), F.col("row_id"))))


ORDERS = """
feat AS (SELECT l_orderkey AS row_id, l_suppkey AS fid, count(*)::DOUBLE AS val FROM lineitem GROUP BY ALL),
lab AS (SELECT DISTINCT l_orderkey AS row_id, l_partkey AS label FROM lineitem)"""
HOT = """,
hot AS (SELECT row_id, label FROM lab UNION ALL SELECT DISTINCT l_orderkey, 0 FROM lineitem WHERE l_orderkey % 2 = 0)"""
VECTORS = """
emb AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS e FROM embeddings),
lab AS (SELECT vec_id AS row_id, unnest([label::BIGINT, 100 + vec_id % 7]) AS label FROM embeddings)"""
LEARNERS = VECTORS + """,
part AS (SELECT row_id, t AS learner, list_slice(e, 16 * t + 1, 16 * t + 16) AS e FROM emb, range(0, 4) x(t)),
near AS (SELECT * FROM (SELECT q.learner, q.row_id AS query_id, m.row_id, row_number() OVER (PARTITION BY q.learner, q.row_id ORDER BY list_cosine_similarity(q.e, m.e) DESC, m.row_id) AS rank
         FROM part q JOIN part m USING (learner) WHERE q.row_id % 5 = 0 AND m.row_id % 5 <> 0) WHERE rank <= 10),
votes AS (SELECT query_id, row_id, count(*)::BIGINT AS votes FROM near GROUP BY ALL),
score AS (SELECT query_id, label, sum(votes)::BIGINT AS score FROM votes JOIN lab USING (row_id) GROUP BY ALL),
pred AS (SELECT query_id AS row_id, label, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label)::INT AS rank FROM score) WHERE rank <= 10),
true_ AS (SELECT row_id, label FROM lab WHERE row_id % 5 = 0),
hit AS (SELECT p.row_id, p.label, p.rank, (t.label IS NOT NULL)::INT AS hit FROM pred p LEFT JOIN true_ t USING (row_id, label) WHERE rank <= 5),
ks AS (SELECT k::INT AS k FROM range(1, 6) x(k)),
size AS (SELECT row_id, count(*) AS size FROM true_ GROUP BY row_id),
ideal AS (SELECT row_id, k, list_sum(list_transform(range(1, least(k, size) + 1), lambda r: 1 / log2(r + 1))) AS ideal FROM size, ks),
trainl AS (SELECT label, count(*) AS n FROM lab WHERE row_id % 5 <> 0 GROUP BY label),
const AS (SELECT (ln((SELECT count(*) FROM emb WHERE row_id % 5 <> 0)) - 1) * pow(2.5, 0.55) AS c),
weight AS (SELECT label, 1 + c * pow(n + 1.5, -0.55) AS weight FROM trainl, const),
unseen AS (SELECT 1 + c * pow(1.5, -0.55) AS unseen FROM const),
best AS (SELECT * FROM (SELECT row_id, coalesce(weight, unseen) AS weight, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(weight, unseen) DESC, label) AS rank
         FROM true_ LEFT JOIN weight USING (label), unseen WHERE row_id IN (SELECT row_id FROM pred)) WHERE rank <= 5),
got AS (SELECT row_id, rank, coalesce(weight, unseen) AS weight FROM hit LEFT JOIN weight USING (label), unseen WHERE hit = 1)"""
