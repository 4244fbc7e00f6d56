"""Hard-negative mining: a two-dimensional block matrix product, and the best of each tile per anchor-positive window.

1. Anchors and members are matrices of integers. Rows are sharded into blocks by hash, columns into
   chunks of ``chunk`` dimensions, as in SUMMA: the tile (i, j) of scores is the sum over chunks d of
   ``A[i, d] B[j, d]^T``. Each (i, j, d) is one multiplication, which gives a partial int64 tile; the partial
   tiles of (i, j) are shuffled together and added. The number of blocks follows from the counts of
   rows, so that a tile has the same bounded size on any input, and no task holds a label or a table.
2. Positives: the product runs within each label (a label is only a prefix of the tile's key; its rows
   are cut in as many blocks as it needs). A tile keeps each anchor's best rows, and a window ranks the tiles' best.
3. Negatives: anchors carry their positives' scores as windows of permitted scores. The product runs over all
   rows; of a summed tile each window keeps its best rows of another label, and a window ranks them over tiles.

Multiplying in doubles is exact as long as every sum stays below 2**53, and is then what a tile does; else it
multiplies int64. Rows cannot overflow: a component beyond 2**25 in size (after scaling) raises an error.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite component take no
part; rows that share an id are one row, the one of least label, then least vector; vectors of
different lengths are padded with zeros, so an empty vector scores 0 with every row; an anchor
without other rows of its label, and a positive without fitting negatives, give no rows; ties go
to the smaller id; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Anchors and members of a tile, and dimensions of a chunk.
ANCHOR_ROWS, MEMBER_ROWS, CHUNK = 256, 2048, 32
#: The largest component, which keeps sums of 64 bits exact for up to 2**12 dimensions.
LIMIT = 1 << 25


def quantized(vectors: DataFrame, id_column: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """``(id, label, q)``: sound rows, one for each id, with ``q = floor(scale * x)``."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(id_column).isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    fits = lambda v: F.when(F.abs(v * scale) <= LIMIT, F.floor(v * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling")).cast("long"))
    d = vectors.where(sound).select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, fits).alias("q"))
    return d.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def _blocks(d: DataFrame, by: list[str], name: str, rows: int) -> DataFrame:
    n = d.groupBy(*by) if by else d
    return n.agg(F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("long").alias(name))


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2**53 else a @ b.T


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of one chunk; short ones are padded."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def tiles(anchors: DataFrame, members: DataFrame, by: tuple[str, ...] = (), chunk: int = CHUNK, anchor_rows: int = ANCHOR_ROWS, member_rows: int = MEMBER_ROWS) -> DataFrame:
    """Partial tiles ``(by, i, j, d, anchors, members, part)``; ``d`` is null in the one row of a tile that carries both sides' ids.

    ``anchors`` is (by, id, label, q, windows), ``members`` (by, id, label, q). Each side is repeated
    once for each block of the other, as any product of all pairs of blocks must.
    """
    by = list(by)
    size, other = _blocks(members, by, "right", member_rows), _blocks(anchors, by, "left", anchor_rows)
    dims = anchors.select(F.size("q").alias("w")).union(members.select(F.size("q").alias("w"))).agg(F.greatest(F.coalesce(F.max("w"), F.lit(1)), F.lit(1)).alias("w"))
    grid = (size.join(other, by) if by else size.join(other)).join(F.broadcast(dims))  # one row for each group
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    chunks = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("w") - 1) / chunk).cast("int")), lambda d: F.struct(d.alias("d"), F.slice("q", d * chunk + 1, F.lit(chunk)).alias("q"))))

    def side(d: DataFrame, *own: str) -> DataFrame:
        own_names = [F.col(c).alias(c) for c in (*by, "id", *own)]
        d = d.select(*own_names, "q")
        return d.join(grid, by) if by else d.join(F.broadcast(grid))  # without groups, one row

    a = side(anchors, "label", "windows").withColumn("i", F.pmod(F.xxhash64("id"), "left")).withColumn("j", to("right"))
    b = side(members, "label").withColumn("j", F.pmod(F.xxhash64("id"), "right")).withColumn("i", to("left"))
    a = a.select(*by, "i", "j", "id", "label", "windows", chunks.alias("c")).select(*by, "i", "j", "id", "label", "windows", "c.d", "c.q")
    b = b.select(*by, "i", "j", "id", "label", chunks.alias("c")).select(*by, "i", "j", "id", "label", "c.d", "c.q")
    keys = [*by, "i", "j", "d"]
    kind = ", ".join([*(f"{k} long" for k in (*by, "i", "j", "d")), "anchors array<struct<id:long,label:long,windows:array<long>>>", "members array<struct<id:long,label:long>>", "part binary"])

    def multiply(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, "anchors", "members", "part"]
        if not len(x) or not len(y):
            return pd.DataFrame(columns=names)
        x, y = x.sort_values("id"), y.sort_values("id")
        part = _exact_product(_matrix(x["q"], chunk), _matrix(y["q"], chunk)).tobytes()
        left = right = None
        if key[-1] == 0:  # the ids travel once
            left = [{"id": p, "label": q, "windows": list(w)} for p, q, w in zip(x["id"], x["label"], x["windows"])]
            right = [{"id": p, "label": q} for p, q in zip(y["id"], y["label"])]
        return pd.DataFrame([(*key, left, right, part)], columns=names)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(multiply, kind)


def _best(partial: DataFrame, by: tuple[str, ...], k: int, same: bool) -> DataFrame:
    """``(anchor_id, slot, id, score)``: the best ``k`` of each window of a summed tile, of the anchor's label or of another.

    ``windows`` holds pairs of a lowest and a highest score; an anchor without windows has one that is open.
    """
    keys = [*by, "i", "j"]

    def add(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        head = g[g["d"] == 0].iloc[0]
        ids = np.array([m["id"] for m in head["members"]], np.int64)
        labels = np.array([m["label"] for m in head["members"]], np.int64)
        total = np.zeros((len(head["anchors"]), len(ids)), np.int64)
        for part in g["part"]:
            total += np.frombuffer(part, np.int64).reshape(total.shape)
        out = []
        for a, scores in zip(head["anchors"], total):
            fit = (labels == a["label"]) & (ids != a["id"]) if same else labels != a["label"]
            own, s = ids[fit], scores[fit]
            order = np.argsort(-s, kind="stable")  # ids ascend, so ties stay in their order
            own, s = own[order], s[order]
            windows = np.asarray(a["windows"], np.int64).reshape(-1, 2)
            for slot, (low, high) in enumerate(windows if len(windows) else [(None, None)]):
                first = 0 if high is None else np.searchsorted(-s, -high)
                last = len(s) if low is None else np.searchsorted(-s, -low, side="right")
                for p in range(first, min(last, first + k)):
                    out.append((a["id"], slot, own[p], s[p]))
        return pd.DataFrame(out, columns=["anchor_id", "slot", "id", "score"])

    near = partial.groupBy(*keys).applyInPandas(add, "anchor_id long, slot int, id long, score long")
    w = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(members: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low_percent: int = 80, chunk: int = CHUNK, anchor_rows: int = ANCHOR_ROWS, member_rows: int = MEMBER_ROWS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from rows ``(id, label, q)`` of :func:`quantized`.

    A positive's window holds the scores s with ``low_percent * positive <= 100 * s <= 100 * positive``.
    """
    size = {"chunk": chunk, "anchor_rows": anchor_rows, "member_rows": member_rows}
    none = F.array().cast("array<long>").alias("windows")
    same = tiles(anchors.select("id", "label", "q", none).withColumn("g", F.col("label")), members.withColumn("g", F.col("label")), ("g",), **size)
    pos = stored(_best(same, ("g",), positives, True).select("anchor_id", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # the least score of the window, rounded up: integers, as the scores are below 2**62 / 100 in size
    low = -F.floor(-F.lit(low_percent).cast("decimal(38,0)") * F.col("positive_score") / 100).cast("long")
    windows = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slot", low.alias("low"), "positive_score"))), lambda x: F.array(x["low"], x["positive_score"])))
    held = pos.groupBy(F.col("anchor_id").alias("id")).agg(windows.alias("windows"))
    every = tiles(anchors.select("id", "label", "q").join(held, "id"), members, (), **size)
    neg = _best(every, (), negatives, False).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").withColumn("slot", F.col("slot") + 1)
    return neg.join(pos, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stored(quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", noisy))
    return mine(rows, rows.where("id % 100 = 0"))


SQL = {
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, m.id, a.label = m.label AS same, list_sum(list_transform(list_zip(a.q, m.q), lambda x: x[1] * x[2]))::BIGINT AS score FROM e a, e m WHERE a.id % 100 = 0 AND a.id <> m.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
}
QUERIES = {"op11_hard_negatives": op11_hard_negatives}
