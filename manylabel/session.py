"""Writing intermediate state where every executor can read it again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The run's folder inside the one that ``spark.checkpoint.dir`` names (a folder of our own only where it is unset and all runs on one machine)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows as a table in the shared folder: computed once, and with the size of its files, where a checkpoint would carry on
    the estimates of its plan, which in a loop of joins grow beyond all bounds."""
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """As :func:`checkpointed`, with the table's path, for loops that free what they have left behind."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, keys: list[str], buckets: int = 0) -> tuple[DataFrame, str]:
    """As :func:`written`, in buckets by ``keys`` (as many as a shuffle has partitions, or ``buckets`` if they are more): joined, grouped or cogrouped by them, the rows are not shuffled.

    The catalogue only knows the table until its reader is made.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    name = os.path.basename(path).replace("-", "_")
    df.write.option("path", path).bucketBy(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out, path


def emptied(df: DataFrame, path: str) -> None:
    """Frees the room of a table of :func:`written` that nobody reads any more."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)
