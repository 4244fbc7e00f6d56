"""Votes of neighbours over learners, summed to label scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelgraph import top


def neighbor_votes(neighbours: DataFrame) -> DataFrame:
    """``(query_id, row_id, votes)``: how many learners found a row; search scores do not matter."""
    return neighbours.groupBy("query_id", "row_id").agg(F.count("*").alias("votes"))


def label_scores(votes: DataFrame, labels: DataFrame) -> DataFrame:
    """``(query_id, label, score)``: votes of the neighbours that carry a label."""
    return votes.join(labels, "row_id").groupBy("query_id", "label").agg(F.sum("votes").alias("score"))


def top_labels(scores: DataFrame, m: int = 10) -> DataFrame:
    return top(scores, ("query_id",), F.col("score"), "label", m).select("query_id", "rank", "label", "score")
