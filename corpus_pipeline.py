"""From raw documents to shuffled token ids, in five stages of the text operators.

Each stage is a function of ``(spark, docs, sf_dir)`` that returns a DataFrame; written as
Parquet it is the next stage's ``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manylabel.llm import bpe_words, jaccard_join, line_dedup, poisson_mixing, quality_rules
from manylabel.llm.common import emptied, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.apply_rules(docs).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents hold stay in the last of them only; ``n_chars`` follows the text."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to their source's target weight, in global random order."""
    return poisson_mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy, and their text."""
    return bpe_words.encode_decode(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mixing), ("BPE encoding and decoding", tokens)]

#: SQL cannot express the BPE stage; the tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage keeps is a table in the shared checkpoint folder until the next one has read it."""
    docs, path = table(spark, sf_dir, "documents"), None
    *early, (_, last) = STAGES
    for _, stage in early:
        kept = written(stage(spark, docs, sf_dir))
        if path:
            emptied(docs, path)
        docs, path = kept
    return last(spark, docs, sf_dir)
