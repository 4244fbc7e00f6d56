"""Multi-label text rows ``l1,l2 f1:v1 f2:v2`` and result rows ``l1,l2<TAB>p1:s1,p2:s2``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed

_LABELS = "array<int>"
_FEATURES = "array<struct<fid:int,val:float>>"


def parse_lines(lines: DataFrame, value: str = "value", keep_unlabelled: bool = False) -> DataFrame:
    """Adds ``labels`` and ``features``; rows that are empty, a header or malformed go.

    A line that starts with blank or with a ``fid:val`` pair has no labels: it goes, or with
    ``keep_unlabelled`` (queries) keeps an empty list. Repeated labels and features stay.
    """
    line = F.regexp_replace(F.col(value), r"[\r\n]+$", "")
    tokens, first = F.col("__t"), F.get("__t", 0)
    lines = lines.withColumn("__t", F.filter(F.split(line, r"[ \t]+"), lambda x: x != ""))
    bare = F.col(value).rlike(r"^[ \t]") | first.contains(":")
    pairs = F.when(bare, tokens).otherwise(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))))
    d = lines.withColumns({"__l": F.when(bare, F.lit("")).otherwise(first), "__p": F.filter(pairs, lambda x: x.rlike(r"^[^:]+:[^:]+$"))})
    ids = F.filter(F.split("__l", ","), lambda x: x != "")
    labels = F.transform(ids, lambda x: x.try_cast("int")).cast(_LABELS).alias("labels")
    features = F.transform("__p", lambda x: F.struct(F.substring_index(x, ":", 1).try_cast("int").alias("fid"), F.substring_index(x, ":", -1).try_cast("float").alias("val"))).cast(_FEATURES).alias("features")
    # generated as one row each: Spark would move the filter below a projection and so split and cast every line twice
    d = d.select(*[c for c in d.columns if c not in ("labels", "features")], F.inline(F.array(F.struct(labels, features))))
    sound = ~F.exists("labels", lambda x: x.isNull()) & ~F.exists("features", lambda x: x["fid"].isNull() | x["val"].isNull())
    enough = F.size("features") > 0
    return d.where(sound & enough & (F.lit(keep_unlabelled) | (F.size("labels") > 0))).drop("__l", "__p", "__t")


def read_dataset(spark: SparkSession, path: str, keep_unlabelled: bool = False) -> DataFrame:
    """``row_id, labels, features`` of a text file; ids are dense and follow the order of accepted lines."""
    d = parse_lines(spark.read.text(path), keep_unlabelled=keep_unlabelled).select("labels", "features")
    # a number that grows within a partition, and the rows of the partitions before it; stored, as both must meet the same partitions
    d = checkpointed(d.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    first = d.groupBy(part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))  # one row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("__part", (before - F.col("__first")).alias("__shift"))
    return d.withColumn("__part", part).join(F.broadcast(first), "__part").select((F.col("__at") + F.col("__shift")).alias("row_id"), "labels", "features")


def features_of(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.explode("features").alias("f")).select("row_id", "f.fid", F.col("f.val").cast("double").alias("val"))


def labels_of(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.explode("labels").alias("label"))


def render_lines(rows: DataFrame) -> Column:
    """The text of ``labels`` and ``features``."""
    pairs = F.transform("features", lambda f: F.concat_ws(":", f["fid"].cast("string"), f["val"].cast("string")))
    return F.concat_ws(" ", F.array_join(F.col("labels").cast("array<string>"), ","), F.array_join(pairs, " "))


def summary(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, largest feature id and largest label."""
    f = features.agg(F.countDistinct("row_id").alias("n_data"), F.max("fid").cast("bigint").alias("n_feature"))
    return f.join(labels.agg(F.max("label").cast("bigint").alias("n_label")))  # one row each


def render_results(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """``row_id, value`` from ranked ``(row_id, rank, label, score)`` and true ``(row_id, label)``; a row without predictions ends at its TAB."""
    p = predictions.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("rank", "label", "score"))).alias("p"))
    t = labels.groupBy("row_id").agg(F.sort_array(F.collect_list("label")).alias("l"))
    text = F.array_join(F.transform("p", lambda x: F.format_string("%d:%.1f", x["label"], x["score"].cast("double"))), ",")
    true = F.coalesce(F.array_join(F.col("l").cast("array<string>"), ","), F.lit(""))
    return t.join(p, "row_id", "full_outer").select("row_id", F.concat(true, F.lit("\t"), F.coalesce(text, F.lit(""))).alias("value"))


def parse_results(lines: DataFrame, value: str = "value") -> DataFrame:
    """``labels`` and ``preds``; a line without exactly two parts keeps null lists, so that it still counts as a row, and malformed entries go."""
    parts = F.filter(F.split(F.col(value), r"\s+"), lambda x: x != "")
    two = F.size(parts) == 2
    preds = F.transform(F.split(F.get(parts, 1), ","), lambda x: F.struct(F.substring_index(x, ":", 1).try_cast("int").alias("label"), F.substring_index(x, ":", -1).try_cast("double").alias("score")))
    preds = F.filter(preds, lambda x: x["label"].isNotNull() & x["score"].isNotNull())
    labels = F.filter(F.transform(F.split(F.get(parts, 0), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return lines.withColumns({"labels": F.when(two, labels).cast(_LABELS), "preds": F.when(two, preds)})


def read_results(spark: SparkSession, path: str, value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(row_id)`` of every line, ``true(row_id, label)`` and ``predictions(row_id, rank, label, score)`` in the order of the text."""
    d = checkpointed(parse_results(spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id()), value))
    pred = d.where("preds IS NOT NULL").select("row_id", F.posexplode("preds").alias("at", "p")).select("row_id", (F.col("at") + 1).alias("rank"), "p.label", "p.score")
    return d.select("row_id"), labels_of(d.where("labels IS NOT NULL")), pred


def write_results(predictions: DataFrame, labels: DataFrame, path: str) -> None:
    render_results(predictions, labels).orderBy("row_id").select("value").write.mode("overwrite").text(path)
