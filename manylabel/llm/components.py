"""Connected components of a table of links, by alternating star contractions on DataFrames.

Every round replaces links by links to smaller neighbours, so that the links of a component
end as one star around its smallest node. A node with very many links is a skewed join
key, which Spark's adaptive execution splits, and its minimum comes from partial aggregates.
Each round is written to the shared checkpoint folder; nothing is collected but two counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _is_star(e: DataFrame) -> bool:
    """Each node points to one root, and no root points on."""
    several = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    on = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return not several.union(on).take(1)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the first two columns but the roots; ``root`` is the least node reachable.

    Links with a null end, loops and repeats change nothing; no links give an empty table.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    e = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = checkpointed(e)
    while not _is_star(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # large star: larger neighbours go to the least of the node and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: the smaller neighbours and the node go to the least of them
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = checkpointed(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
