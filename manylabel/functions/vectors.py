"""Column expressions and relations for sparse rows ``(row_id, fid, val)`` and dense ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine_of_distance(d2: Column) -> Column:
    """The cosine of unit vectors at a squared distance."""
    return 1 - d2 / 2


def sigmoid(x: Column) -> Column:
    """Without overflow at either end."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def slot(k: Column, fid: Column, columns: int, bits: int) -> Column:
    """Feature hashing of a weight's place."""
    return (k.cast("bigint") * columns + fid).bitwiseAND((1 << bits) - 1)


def l2_normalize(features: DataFrame, by: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Sparse rows of norm 1; rows of zeros stay."""
    n = F.sqrt(F.sum(F.col("val") * F.col("val")).over(Window.partitionBy(*by)))
    return features.withColumn("__n", n).withColumn("val", F.when(F.col("__n") > 0, F.col("val") / F.col("__n")).otherwise(F.col("val"))).drop("__n")


def long_form(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    return vectors.select(F.col(id_column).alias("row_id"), F.posexplode(as_double(F.col(vector))).alias("fid", "val"))


def reindex(pairs: DataFrame, id_column: str, by: str) -> DataFrame:
    """``(by, id, new_id)``: the distinct ids of each group in ascending order, numbered from 1.

    All groups are numbered together by a range partition, and each group's first number taken off: no task holds a group.
    """
    from ..operators.partition import dense_numbers

    d = checkpointed(dense_numbers(pairs.select(by, id_column).distinct(), (by, id_column)))
    first = d.groupBy(F.col(by).alias("__by")).agg(F.min("number").alias("__first"))
    d = d.join(first, F.col(by).eqNullSafe(F.col("__by")))
    return d.select(by, id_column, (F.col("number") - F.col("__first") + 1).cast("int").alias("new_id"))
