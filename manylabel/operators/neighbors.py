"""Nearest neighbours in embedding space: exact in tiles, and by a tree and a neighbour graph."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, dot, squared_distance, unit
from ..session import checkpointed

#: Vectors of a block of a tile; a tile has up to so many blocks on each side once there are as many tiles, fewer for vectors of more dimensions than this.
TILE, BLOCKS, WIDTH = 2048, 8, 64
#: Lines of a tile that are scored at once.
LINES = 256
#: Vectors of one part of a search index, and of the parts that a task walks one after the other.
PART = 8192
#: Queries of a task, cells (query, row) that a walk holds at once, and pairs that are measured at once.
QUERIES, STATE, PAIRS = 16_384, 1 << 21, 1 << 14
#: Vectors of a part whose edges are a matrix.
SMALL = 1024


def _similarity(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclid":
        return -((q * q).sum(1)[:, None] - 2 * (q @ m.T) + (m * m).sum(1)[None])
    if metric == "dot":
        return q @ m.T
    nq, nm = np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1)
    s = q @ m.T
    s /= np.where(nq > 0, nq, 1)[:, None] * np.where(nm > 0, nm, 1)[None]
    s[:, ~(nm > 0)] = -np.inf
    return s


def _best_of_tile(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each line's ``k`` largest finite scores, ties to the left, in no order: found without sorting the lines."""
    real = np.isfinite(s)
    s = np.where(real, s, -np.inf)
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above = s > least
        tied = s == least
        real &= above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(real)


def _best_of_blocks(q: np.ndarray, m: np.ndarray, k: int, metric: str, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_best_of_tile` for all scores of two sides, and the scores: no more than ``LINES`` by ``TILE`` of them are held.

    Once a line has ``k`` scores, only greater ones of later blocks count. Pairs of equal ids ``same`` are left out.
    """
    out = []
    for i in range(0, len(q), LINES):
        n = len(q[i : i + LINES])
        at, of, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, -np.inf)
        for j in range(0, len(m), TILE):
            s = _similarity(q[i : i + n], m[j : j + TILE], metric)
            if same is not None:
                s[same[0][i : i + n, None] == same[1][None, j : j + TILE]] = -np.inf
            new_at, new_of = np.nonzero((s > least[:, None]) & (s < np.inf)) if j else _best_of_tile(s, k)
            at, of, score = np.r_[at, new_at], np.r_[of, new_of + j], np.r_[score, s[new_at, new_of]]
            order = np.lexsort((of, -score, at))
            at, of, score = at[order], of[order], score[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            least[at[place == k - 1]] = score[place == k - 1]
            at, of, score = at[place < k], of[place < k], score[place < k]
        out.append((at + i, of, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def knn(queries: DataFrame, members: DataFrame, k: int, metric: str = "cosine", within: tuple[str, ...] = (), exclude_self: bool = False) -> DataFrame:
    """``(within, query_id, rank, row_id, score)``, exact; ties by id.

    ``queries`` is (within, query_id, emb), ``members`` (within, row_id, emb). Both sides are cut in
    tiles by hash; a pair of tiles is scored block by block and keeps its own best k, and the
    tiles' best are ranked together. No task holds a whole cluster. A vector is sent to each tile of the other side, so
    tiles grow to ``BLOCKS`` blocks before they become more. Zero vectors are no candidates of a cosine.
    """
    by = list(within)
    width = F.coalesce(F.max(F.size("emb")), F.lit(1)).alias("width")
    size = members.groupBy(*by).agg(F.count("*").alias("n"), width) if by else members.agg(F.count("*").alias("n"), width)
    qsize = queries.groupBy(*by).agg(F.count("*").alias("m")) if by else queries.agg(F.count("*").alias("m"))
    size = size.join(qsize, by) if by else size.join(qsize)
    side = TILE * F.greatest(F.lit(1), F.floor(F.lit(BLOCKS) / F.ceil(F.col("width") / WIDTH)))
    tiles = lambda n: F.least(F.ceil(F.col(n) / TILE), F.greatest(F.lit(BLOCKS), F.ceil(F.col(n) / side))).cast("int")
    size = size.select(*by, tiles("n").alias("right"), tiles("m").alias("left")).where("right > 0 AND left > 0")
    of = lambda d: d.join(size, by) if by else d.join(F.broadcast(size))  # noqa: E731  (one row without groups)
    q = of(queries).select(*by, F.pmod(F.xxhash64("query_id"), "left").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("right") - F.lit(1).cast("bigint"))).alias("j"), "query_id", as_double(F.col("emb")).alias("emb"))
    own = [F.col(c).alias(c) for c in by]  # both sides may stem from one table: these are columns of their own
    m = of(members).select(*own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("left") - F.lit(1).cast("bigint"))).alias("i"), F.pmod(F.xxhash64("row_id"), "right").alias("j"), "row_id", as_double(F.col("emb")).alias("emb"))
    keys = [*by, "i", "j"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields if f.name in by), "query_id long, row_id long, score double"])

    def tile(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*by, "query_id", "row_id", "score"])
        b = b.sort_values("row_id")
        ids, qid = b["row_id"].to_numpy(), a["query_id"].to_numpy()
        at, of, score = _best_of_blocks(np.stack(a["emb"]), np.stack(b["emb"]), k, metric, (qid, ids) if exclude_self else None)
        out = pd.DataFrame({"query_id": qid[at], "row_id": ids[of], "score": score})
        for name, value in zip(by, key):
            out[name] = value
        return out[[*by, "query_id", "row_id", "score"]]

    near = q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInPandas(tile, schema)
    w = Window.partitionBy(*by, "query_id").orderBy(F.col("score").desc(), "row_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "query_id", "rank", "row_id", "score")


def knn_graph(members: DataFrame, num_edge: int, within: tuple[str, ...] = ()) -> DataFrame:
    """``(within, src, dst, rank, d2)``: each vertex's nearest others by squared distance."""
    d = knn(members.withColumnRenamed("row_id", "query_id"), members, num_edge, "euclid", within, exclude_self=True)
    return d.select(*within, F.col("query_id").alias("src"), F.col("row_id").alias("dst"), "rank", (-F.col("score")).alias("d2"))


def ball(members: DataFrame, within: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The mean vector ``(within, dim, mean)`` and the largest distance to it ``(within, radius)``."""
    long = members.select(*within, "row_id", F.posexplode(as_double(F.col("emb"))).alias("dim", "x"))
    mean = long.groupBy(*within, "dim").agg(F.avg("x").alias("mean"))
    d2 = long.join(mean, [*within, "dim"]).groupBy(*within, "row_id").agg(F.sum((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("d2"))
    return mean, (d2.groupBy(*within) if within else d2).agg(F.sqrt(F.max("d2")).alias("radius"))


def split(members: DataFrame, base_id: int) -> DataFrame:
    """One level of the tree: ``(row_id, side)`` with 0 left of the plane between a, farthest from the base, and b, farthest from a."""
    m = members.select("row_id", as_double(F.col("emb")).alias("emb"))
    base = m.where(F.col("row_id") == base_id).select(F.col("row_id").alias("base"), F.col("emb").alias("base_emb"))
    far = lambda d, e, i: d.where(F.col("row_id") != F.col(i)).select("row_id", "emb", squared_distance(F.col("emb"), F.col(e)).alias("d2")).orderBy(F.col("d2").desc(), "row_id").limit(1)
    a = far(m.join(F.broadcast(base)), "base_emb", "base").select(F.col("row_id").alias("a"), F.col("emb").alias("a_emb"))
    b = far(m.where(F.col("row_id") != base_id).join(F.broadcast(a)), "a_emb", "a").select(F.col("row_id").alias("b"), F.col("emb").alias("b_emb"))
    d = m.join(F.broadcast(a)).join(F.broadcast(b))
    normal = F.zip_with("b_emb", "a_emb", lambda x, y: x - y)
    middle = F.zip_with("a_emb", "b_emb", lambda x, y: (x + y) / 2)
    z = dot(normal, F.zip_with("emb", middle, lambda x, y: x - y))
    return d.select("row_id", F.when(z <= 0, F.lit(0)).otherwise(F.lit(1)).alias("side"))


class GraphIndex:
    """The vectors of one part with their given edges (row positions), and a binary tree for entry points."""

    def __init__(self, x: np.ndarray, edges: list[np.ndarray], leaf: int, seed: int):
        self.x, self.leaf, self.rng = x, max(1, leaf), np.random.default_rng(seed)
        sizes = np.array([len(e) for e in edges], int)
        self.to = np.full((len(x), sizes.max(initial=0)), -1)
        self.to[np.arange(self.to.shape[1]) < sizes[:, None]] = np.concatenate([np.zeros(0, int), *edges])
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray) -> dict:
        node = {"center": self.x[rows].mean(axis=0) if len(rows) else None, "rows": rows}
        if len(rows) <= self.leaf:
            return node
        distance = lambda i, of: ((self.x[of] - self.x[i]) ** 2).sum(axis=1)
        base = self.rng.choice(rows)
        a = rows[np.argmax(distance(base, rows))]
        others = rows[rows != base]
        b = others[np.argmax(distance(a, others))]
        plane, middle = self.x[b] - self.x[a], (self.x[a] + self.x[b]) / 2
        right = (self.x[rows] - middle) @ plane > 0
        if right.all() or not right.any():
            return node
        return node | {"left": self._grow(rows[~right]), "right": self._grow(rows[right])}

    def entries(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lines of ``q`` and the rows of the leaf that they come to: from the root, the child of the nearer centre."""
        out, todo = [], [(self.root, np.arange(len(q)))]
        while todo:
            node, at = todo.pop()
            if "left" not in node:
                out.append((at, node["rows"]))
                continue
            left, right = (((q[at] - node[c]["center"]) ** 2).sum(axis=1) for c in ("left", "right"))
            todo += [(node["left"], at[left <= right]), (node["right"], at[left > right])]
        return out

    def search(self, q: np.ndarray, k: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines of ``q``, row positions and squared distances, each line's nearest first, for all lines in the same rounds.

        From the nearest leaf, edges are followed from rows that are closer than (1 + eps) times the worst of
        a line's best k so far; a round visits the rows that the rows of the last one lead to.
        """
        at, of, d2 = [], [], []
        step = max(1, STATE // max(len(self.x), 1))
        for i in range(0, len(q), step):
            found = self._walk(q[i : i + step], k, eps)
            line, row = _best_of_tile(-found, k)
            order = np.lexsort((row, found[line, row], line))
            line, row = line[order], row[order]
            at.append(line + i), of.append(row), d2.append(found[line, row])
        return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (at, of, d2))

    def _walk(self, q: np.ndarray, k: int, eps: float) -> np.ndarray:
        """Squared distances of each line to the rows that it has visited, endless to others."""
        found = np.full((len(q), len(self.x)), np.inf)
        new = np.zeros(found.shape, bool)
        for at, rows in self.entries(q):
            new[at[:, None], rows[None]] = True
        small = len(self.x) <= SMALL  # its distances and the steps along its edges are products
        d2 = -_similarity(q, self.x, "euclid") if small else None
        leads = np.zeros((len(self.x) if small else 0,) * 2, np.float32)
        if small:
            row, e = np.nonzero(self.to >= 0)
            leads[row, self.to[row, e]] = 1
        while new.any():
            if small:
                np.copyto(found, d2, where=new)
            else:
                self._measure(q, new, found)
            worst = np.partition(found, k - 1, axis=1)[:, k - 1] if found.shape[1] >= k else np.full(len(q), np.inf)
            near = new & (found <= (1 + eps) * worst[:, None])
            if small:
                new = near.astype(np.float32) @ leads > 0
            else:
                new[:] = False
                line, row = np.nonzero(near)
                for j in range(0, len(line), PAIRS):
                    to = self.to[row[j : j + PAIRS]]
                    a, to = np.repeat(line[j : j + PAIRS], to.shape[1]), to.ravel()
                    new[a[to >= 0], to[to >= 0]] = True
            new &= ~np.isfinite(found)
        return found

    def _measure(self, q: np.ndarray, new: np.ndarray, found: np.ndarray) -> None:
        line, row = np.nonzero(new)
        for j in range(0, len(line), PAIRS):
            a, b = line[j : j + PAIRS], row[j : j + PAIRS]
            found[a, b] = ((self.x[b] - q[a]) ** 2).sum(axis=1)


def build_index(members: DataFrame, num_edge: int = 50, within: tuple[str, ...] = ("learner", "cluster"), part_rows: int = PART) -> DataFrame:
    """``(within, part, row_id, emb, edges)``: unit vectors with the ids of their nearest others in their part.

    A cluster is dealt by hash in parts of about ``part_rows``, as many as its size asks for; edges
    are found in tiles. The index is a plain table: written once, it serves any number of searches.
    Zero vectors are not in it.
    """
    by = list(within)
    size = members.groupBy(*by).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("__parts"))
    m = members.join(size, by).withColumn("part", F.pmod(F.xxhash64("row_id"), "__parts").cast("int"))
    m = m.select(*by, "part", "row_id", unit(as_double(F.col("emb"))).alias("emb")).where(F.exists("emb", lambda x: x != 0))
    edges = knn_graph(m, num_edge, (*within, "part")).groupBy(*by, "part", F.col("src").alias("row_id"))
    edges = edges.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"]).alias("edges"))
    return m.join(edges, [*by, "part", "row_id"], "left").select(*by, "part", "row_id", "emb", F.coalesce("edges", F.array().cast("array<long>")).alias("edges"))


def _dealt(queries: DataFrame, index: DataFrame, rows: DataFrame, by: list[str], least: int = 1) -> tuple[DataFrame, DataFrame]:
    """``queries`` and ``rows(by, part, ...)`` with the ``group`` of parts and the ``deal`` of queries whose task they go to.

    A group has as many parts of a cluster of ``index`` as make up ``PART`` rows, fewer if there would be less than ``least`` groups.
    """
    size = index.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"))
    together = F.least(F.floor(F.lit(PART) * F.col("parts") / F.col("n")), F.floor(F.col("parts") / least))
    size = size.select(*by, F.greatest(F.lit(1), together).cast("int").alias("together"))
    deal = queries.groupBy(*by).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("deals"))
    group = F.floor(F.col("part") / F.col("together")).cast("int").alias("group")
    names = [c for c in rows.columns if c not in by]
    own = [F.col(c).alias(c) for c in (*by, *names)]  # both sides may stem from one table: these are columns of their own
    dealt = rows.select(*own).join(size, by).join(deal, by).select(*by, group, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), *names)
    groups = index.select(*by, "part").distinct().join(size, by).select(*by, group).distinct()
    q = queries.join(deal, by).withColumn("deal", F.pmod(F.xxhash64("query_id"), "deals").cast("int")).drop("deals")
    return q.join(groups, by), dealt


def search_index(queries: DataFrame, index: DataFrame, k: int, eps: float = 0.0, within: tuple[str, ...] = ("learner", "cluster"), seed: int = 0, exclude_self: bool = False) -> DataFrame:
    """``(within, query_id, rank, row_id, score)``: every part of a query's cluster is walked along its edges, and the parts' best are merged; scores are cosines.

    A task has as many parts of a cluster as make up ``PART`` rows, with at most some ``QUERIES`` queries, and keeps a query's best of them all. So queries are sent
    once for each such group of parts, and not for each part.
    """
    by = list(within)
    q, dealt = _dealt(queries.select(*by, "query_id", as_double(F.col("emb")).alias("emb")), index, index, by)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields if f.name in by), "query_id long, row_id long, score double"])
    want = k + exclude_self

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame(columns=["query_id", "row_id", "score"])]
        if len(a) and len(b):
            e, qid = np.stack(a["emb"]).astype(float), a["query_id"].to_numpy()
            norm = np.linalg.norm(e, axis=1, keepdims=True)
            e /= np.where(norm > 0, norm, 1)
            for _, rows in b.sort_values("row_id").groupby("part"):
                ids = rows["row_id"].to_numpy()
                part = GraphIndex(np.stack(rows["emb"]).astype(float), [np.searchsorted(ids, x) for x in rows["edges"]], want, seed)
                at, of, d2 = part.search(e, want, eps)
                one = pd.DataFrame({"query_id": qid[at], "row_id": ids[of], "score": 1 - d2 / 2})
                found.append(one[one["query_id"] != one["row_id"]] if exclude_self else one)
        best = pd.concat(found[1:] or found).sort_values(["score", "row_id"], ascending=[False, True], kind="stable").groupby("query_id").head(k)
        for name, value in zip(by, key):
            best[name] = value
        return best[[*by, "query_id", "row_id", "score"]]

    keys = [*by, "group", "deal"]
    near = q.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(run, schema)
    w = Window.partitionBy(*by, "query_id").orderBy(F.col("score").desc(), "row_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "query_id", "rank", "row_id", "score")


def graph_search(queries: DataFrame, members: DataFrame, k: int, num_edge: int = 50, eps: float = 0.0, within: tuple[str, ...] = ("learner", "cluster"), seed: int = 0, part_rows: int = PART, exclude_self: bool = False) -> DataFrame:
    """:func:`build_index` and :func:`search_index` in one."""
    return search_index(queries, checkpointed(build_index(members, num_edge, within, part_rows)), k, eps, within, seed, exclude_self)


# the same search in rounds: a tree grown level by level, and a frontier that follows the edges, by joins where a part is large

#: Vectors of a leaf, and levels of a tree; a node's number (1 for the root, 2 n and 2 n + 1 below n) fits 63 bits.
LEAF, LEVELS = 32, 60


#: A node of at most so many rows is split further in one task.
SUBTREE = 4096


def _subtree(t: pa.Table, by: list[str], leaf: int, levels: int) -> pa.Table:
    """The leaves ``(by, row_id, -, -)`` and the inner and outer nodes below the root ``(by, -, n, center)`` of one node's tree, by the rule of :func:`grow_tree`.

    Sums go over the dimensions in their order, as Spark's do, so that the same rows are the farthest.
    """
    t = t.sort_by("row_id")
    emb = t["emb"].combine_chunks()
    x = emb.flatten().to_numpy().reshape(t.num_rows, -1).T.copy()
    in_order = lambda terms: reduce(np.add, terms, np.zeros(1))
    distance = lambda rows, i: in_order((d[rows] - d[i]) * (d[rows] - d[i]) for d in x)
    todo, rows_of, nodes, sizes, means = [(t["node"][0].as_py(), np.arange(t.num_rows), 0)], [], [], [], []
    while todo:
        node, rows, level = todo.pop()
        if level:
            nodes.append(node), sizes.append(len(rows)), means.append(x[:, rows].mean(axis=1))
        if len(rows) > leaf and level < levels:
            others = rows[1:]  # the first is the base
            a = others[np.argmax(distance(others, rows[0]))]
            b = others[np.argmax(distance(others, a))]
            right = in_order((d[b] - d[a]) * (d[rows] - (d[a] + d[b]) / 2) for d in x) > 0
            if right.any() and not right.all():
                todo += [(2 * node, rows[~right], level + 1), (2 * node + 1, rows[right], level + 1)]
                continue
        rows_of.append((node, rows))
    order = np.concatenate([rows for _, rows in rows_of])
    n, m = len(order), len(nodes)
    first = pa.array(np.zeros(n + m, int))
    out = {c: t[c].combine_chunks().take(first) for c in by[:-1]}
    out["node"] = pa.array([*np.repeat([node for node, _ in rows_of], [len(rows) for _, rows in rows_of]), *nodes], pa.int64())
    out["row_id"] = pa.concat_arrays([t["row_id"].combine_chunks().take(pa.array(order)), pa.nulls(m, t.schema.field("row_id").type)])
    out["n"] = pa.array([None] * n + sizes, pa.int64())
    return pa.table(out | {"center": pa.array([None] * n + means, pa.list_(pa.float64()))})


def grow_tree(members: DataFrame, leaf: int = LEAF, within: tuple[str, ...] = (), levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Leaves ``(within, row_id, node)`` and nodes ``(within, node, n, center)`` of a binary tree for each group.

    A node of more than ``leaf`` rows is split by the plane between a, the row farthest from the row of least id, and b, the
    one farthest from a (neither is that row). A round splits all nodes of a level in all groups: a and b are
    aggregates with partial maxima, so that no task holds a node of more than ``SUBTREE`` rows; the
    trees below smaller nodes are grown each in one task. A node whose rows all
    fall on one side, such as equal vectors, stays a leaf.
    """
    by = [*within, "node"]
    active = checkpointed(members.select(*within, "row_id", as_double(F.col("emb")).alias("emb")).withColumn("node", F.lit(1).cast("long")))
    width = (active.agg(F.max(F.size("emb"))).first()[0]) or 0
    center = F.array(*[F.avg(F.get("emb", i)) for i in range(width)]).cast("array<double>")
    far = lambda e: F.max(F.struct(squared_distance(F.col("emb"), F.col(e)).alias("d2"), (-F.col("row_id")).alias("m"), F.col("emb").alias("emb")))
    right = dot(F.zip_with("b", "a", lambda x, y: x - y), F.zip_with("emb", F.zip_with("a", "b", lambda x, y: (x + y) / 2), lambda x, y: x - y)) > 0
    leaves, nodes = [], []
    whole = F.every((F.size("emb") == width) & F.coalesce(F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))
    kinds = {f.name: f.dataType.simpleString() for f in active.schema.fields}
    grown = ", ".join([*(f"{c} {kinds[c]}" for c in (*by, "row_id")), "n long, center array<double>"])
    for level in range(levels + 1):
        info = checkpointed(active.groupBy(*by).agg(F.count("*").alias("n"), center.alias("center"), F.min(F.struct("row_id", "emb")).alias("base"), whole.alias("whole")))
        nodes.append(info.select(*by, "n", "center"))
        small = info.where((F.col("n") > leaf) & (F.col("n") <= SUBTREE) & F.col("whole") & F.lit(level < levels)).select(*by)
        if small.take(1):
            left = levels - level
            below = checkpointed(active.join(small, by, "left_semi").groupBy(*by).applyInArrow(lambda t: _subtree(t, by, leaf, left), grown))
            leaves.append(below.where("n IS NULL").select(*by, "row_id"))
            nodes.append(below.where("n IS NOT NULL").select(*by, "n", "center"))
            active, info = active.join(small, by, "left_anti"), info.join(small, by, "left_anti")
        full = info.where((F.col("n") > leaf) & F.lit(level < levels)).select(*by, F.col("base.row_id").alias("base_id"), F.col("base.emb").alias("base"))
        leaves.append(checkpointed(active.join(full, by, "left_anti").select(*by, "row_id")))
        if not full.take(1):
            break
        rows = active.join(full, by)
        others = rows.where("row_id <> base_id")
        first = checkpointed(others.groupBy(*by).agg(far("base").alias("f")).select(*by, F.col("f.emb").alias("a")))
        second = others.join(first, by).groupBy(*by).agg(far("a").alias("f")).select(*by, F.col("f.emb").alias("b"))
        sides = checkpointed(rows.join(first.join(second, by), by).select(*by, "row_id", "emb", right.cast("int").alias("side")))
        stuck = checkpointed(sides.groupBy(*by).agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high").select(*by))
        leaves.append(checkpointed(sides.join(stuck, by, "left_semi").select(*by, "row_id")))
        active = sides.join(stuck, by, "left_anti").select(*within, "row_id", "emb", (2 * F.col("node") + F.col("side")).alias("node"))  # not stored: stuck nodes are few
    together = lambda parts: reduce(DataFrame.union, parts)
    return checkpointed(together(leaves).select(*within, "row_id", "node")), checkpointed(together(nodes))


def nearest_leaf(queries: DataFrame, nodes: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``(within, query_id, node)``: from the root, the child of the nearer centre, ties to the left; a level in each round."""
    by = list(within)
    children = nodes.select(*by, F.shiftright("node", 1).alias("parent"), F.col("node").alias("child"), "center").where("child > 1")
    at = checkpointed(queries.select(*by, "query_id", as_double(F.col("emb")).alias("emb"), F.lit(1).cast("long").alias("node")))
    done = []
    for _ in range(LEVELS + 1):
        step = at.join(children.withColumnRenamed("parent", "node"), [*by, "node"], "left")
        step = step.groupBy(*by, "query_id", "node").agg(F.min(F.struct(squared_distance(F.col("emb"), F.col("center")).alias("d2"), "child", F.col("emb").alias("emb"))).alias("s"))
        step = checkpointed(step.select(*by, "query_id", "node", F.col("s.child").alias("child"), F.col("s.emb").alias("emb")))
        done.append(step.where("child IS NULL").select(*by, "query_id", "node"))
        at = step.where("child IS NOT NULL").select(*by, "query_id", "emb", F.col("child").alias("node"))
        if not at.take(1):
            break
    return checkpointed(reduce(DataFrame.union, done))


#: Rows of a part that is walked in one task, cells (query, row) that such a walk holds at once, and groups of parts at least, if there are as many parts.
WALK, WALKED, GROUPS = 2 * PART, 1 << 16, 48


def _apart(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances of the columns of ``q`` and ``x`` (by broadcasting), summed over the dimensions in their order, as Spark's are."""
    out = np.zeros(np.broadcast_shapes(q.shape[1:], x.shape[1:]))
    for a, b in zip(q, x):
        d = b - a
        d *= d
        out += d
    return out


def _walk_part(q: np.ndarray, x: np.ndarray, edges: list[np.ndarray], leaf: np.ndarray, centers: dict[int, np.ndarray], place: int, eps: float) -> np.ndarray:
    """Squared distances of each line of ``q`` to the rows of a part that it visits by the rule of :func:`search_frontier`, endless to others.

    ``leaf`` has the rows' nodes, ``centers`` those of all nodes; the best at ``place`` (from 1) bounds a line's walk.
    """
    n, width = x.shape
    columns, of = x.T.copy(), q.T.copy()
    new = np.zeros((len(q), n), bool)
    todo = [(1, np.arange(len(q)))]
    while todo:
        node, at = todo.pop()
        if 2 * node not in centers:
            new[at[:, None], np.flatnonzero(leaf == node)[None]] = True
            continue
        left, right = (_apart(of[:, at], centers[c][:, None]) for c in (2 * node, 2 * node + 1))
        todo += [(2 * node, at[left <= right]), (2 * node + 1, at[left > right])]
    found, seen = np.full(new.shape, np.inf), new.copy()
    sizes = np.array([len(e) for e in edges], int)
    ends, to = np.cumsum(sizes), np.concatenate([np.zeros(0, int), *edges])
    small = n <= SMALL  # distances of all pairs, and steps along the edges as a product
    if small:
        d2, leads = _apart(of[:, :, None], columns[:, None, :]), np.zeros((n, n), np.float32)
        leads[np.repeat(np.arange(n), sizes), to] = 1
    while new.any():
        if small:
            np.copyto(found, d2, where=new)
        else:
            line, row = np.nonzero(new)
            for j in range(0, len(line), PAIRS):
                a, b = line[j : j + PAIRS], row[j : j + PAIRS]
                found[a, b] = _apart(of[:, a], columns[:, b])
        bound = np.partition(found, place - 1, axis=1)[:, place - 1] if n >= place else np.full(len(q), np.inf)
        near = new & (found <= (1 + eps) * bound[:, None])
        if small:
            new = near.astype(np.float32) @ leads > 0
        else:
            new = np.zeros_like(seen)
            line, row = np.nonzero(near)
            for j in range(0, len(line), PAIRS):
                a, b = line[j : j + PAIRS], row[j : j + PAIRS]
                steps = np.repeat(ends[b] - sizes[b] - np.cumsum(sizes[b]) + sizes[b], sizes[b]) + np.arange(sizes[b].sum())
                new[np.repeat(a, sizes[b]), to[steps]] = True
        new &= ~seen
        seen |= new
    return found


def _walk_parts(q: DataFrame, index: DataFrame, leaves: DataFrame, nodes: DataFrame, parts: DataFrame, by: list[str], want: int, k: int, eps: float, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """The best ``(by, query_id, row_id, d2)`` and the ``(by, query_id, visited)`` of each group of parts, every part walked in one task.

    What is shuffled is the index, a query for each group of parts, and its best ``k`` and number of visited rows there.
    """
    kinds = {f.name: f.dataType.simpleString() for f in index.schema.fields}
    rows = index.select(*by, "part", "row_id", "emb", "edges").join(leaves, [*by, "part", "row_id"])
    centers = nodes.select(*by, "part", F.lit(0).cast(kinds["row_id"]).alias("row_id"), F.col("center").alias("emb"), F.array().cast(kinds["edges"]).alias("edges"), "node")
    rows = rows.withColumn("inner", F.lit(False)).unionByName(centers.withColumn("inner", F.lit(True))).join(parts, by)
    q, dealt = _dealt(q.withColumnRenamed("q", "emb"), index, rows, by, GROUPS)
    keys = [*by, "group", "deal"]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found, visited = [pd.DataFrame(columns=["query_id", "row_id", "d2"])], np.zeros(len(a), int)
        if len(a) and len(b):
            e, qid = np.stack(a["emb"]).astype(float), a["query_id"].to_numpy()
            place = math.ceil(want * (1 + 1 / int(b["parts"].iloc[0])) / 2)
            for _, part in b.groupby("part"):
                inner = part["inner"].to_numpy(bool)
                own = part[~inner].sort_values("row_id")
                tree = dict(zip(part["node"][inner], (np.asarray(c, float) for c in part["emb"][inner])))
                ids, x = own["row_id"].to_numpy(), np.stack(own["emb"]).astype(float)
                edges = [np.searchsorted(ids, v) for v in own["edges"]]
                step = max(1, WALKED // len(x))
                for i in range(0, len(e), step):
                    d2 = _walk_part(e[i : i + step], x, edges, own["node"].to_numpy(), tree, place, eps)
                    visited[i : i + step] += np.isfinite(d2).sum(axis=1)
                    at, of = _best_of_tile(-d2, want)
                    one = pd.DataFrame({"query_id": qid[at + i], "row_id": ids[of], "d2": d2[at, of]})
                    found.append(one[one["query_id"] != one["row_id"]] if exclude_self else one)
        best = pd.concat(found[1:] or found).sort_values(["query_id", "d2", "row_id"], kind="stable").groupby("query_id").head(k)
        lists = {i: (g["row_id"].tolist(), g["d2"].tolist()) for i, g in best.groupby("query_id")}
        out = pd.DataFrame([(i, n, *lists.get(i, ([], []))) for i, n in zip(a["query_id"], visited) if n], columns=["query_id", "visited", "row_id", "d2"])
        for name, value in zip(by, key):
            out[name] = value
        return out[[*by, "query_id", "visited", "row_id", "d2"]]

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "query_id long, visited long, row_id array<long>, d2 array<double>"])
    d = checkpointed(q.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(run, schema))
    return d.select(*by, "query_id", F.explode(F.arrays_zip("row_id", "d2")).alias("x")).select(*by, "query_id", "x.row_id", "x.d2"), d.select(*by, "query_id", "visited")


def search_frontier(queries: DataFrame, index: DataFrame, k: int, eps: float = 0.0, within: tuple[str, ...] = ("learner", "cluster"), exclude_self: bool = False, leaf: int = LEAF, tree: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(within, query_id, rank, row_id, score)`` and ``(within, query_id, visited)``: best-first search in rounds.

    ``index`` is a table of :func:`build_index`, ``tree`` one of :func:`grow_tree` within its parts. The rows of the leaf nearest to a query in each part are its first
    frontier. A round measures the frontier, merges it into the query's best of each part, and follows the edges of
    those rows that are closer than (1 + eps) times the part's bound to rows not seen before; since a bound only
    shrinks, a row that is too far once stays so. The bound of a part is its own ``k``-th best distance if there is one part, and goes down to that of
    half as many with more parts: rows are dealt by hash, so a part holds few of a query's best, while the best over all parts would end the walk of most parts
    at their entries. It ends when no query has a frontier. A part of up to ``WALK`` rows is walked in one task (:func:`_walk_parts`), so that
    neither its pairs nor a query for each part are shuffled; the rounds of larger parts are joins, and nothing is held by query or part in a task.
    """
    by, keys = list(within), [*within, "part"]
    want = k + exclude_self
    q = checkpointed(queries.select(*by, "query_id", unit(as_double(F.col("emb"))).alias("q")))
    leaves, nodes = tree or grow_tree(index, leaf, tuple(keys))
    sizes = checkpointed(index.groupBy(*keys).agg(F.count("*").alias("n")))
    parts = sizes.groupBy(*by).agg(F.count("*").alias("parts"))
    large = sizes.where(F.col("n") > WALK).select(*keys)
    walks = []
    if large.take(1):
        some = [d.join(large, keys, "left_semi") for d in (index, leaves, nodes)]
        walks.append(_walk_by_joins(q, *some, parts, by, want, eps))
        index, leaves, nodes = (d.join(large, keys, "left_anti") for d in (index, leaves, nodes))
    if not walks or index.take(1):
        walks.append(_walk_parts(q, index, leaves, nodes, parts, by, want, k, eps, exclude_self))
    best, visited = (reduce(DataFrame.unionByName, x) for x in zip(*walks))
    if exclude_self:
        best = best.where("query_id <> row_id")
    w = Window.partitionBy(*by, "query_id").orderBy("d2", "row_id")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*by, "query_id", "rank", "row_id", (1 - F.col("d2") / 2).alias("score")), visited.groupBy(*by, "query_id").agg(F.sum("visited").alias("visited"))


def _walk_by_joins(q: DataFrame, index: DataFrame, leaves: DataFrame, nodes: DataFrame, parts: DataFrame, by: list[str], want: int, eps: float) -> tuple[DataFrame, DataFrame]:
    """The best ``(by, query_id, row_id, d2)`` of each part and the ``(by, query_id, visited)``, for parts of any size."""
    keys = [*by, "part"]
    vertices = index.select(*[F.col(c).alias(c) for c in (*keys, "row_id", "emb", "edges")])
    start = q.select(*by, "query_id", F.col("q").alias("emb")).join(nodes.where("node = 1").select(*keys), by)
    entries = nearest_leaf(start, nodes, tuple(keys))
    new = checkpointed(entries.join(leaves, [*keys, "node"]).select(*keys, "query_id", "row_id"))
    seen, best = new, None
    edges, vertices = vertices.select(*keys, "row_id", "edges"), vertices.drop("edges")
    own = [*keys, "query_id"]
    while new.take(1):
        met = new.join(vertices, [*keys, "row_id"]).join(q, [*by, "query_id"])
        met = checkpointed(met.select(*own, "row_id", squared_distance(F.col("emb"), F.col("q")).alias("d2")))
        found = met if best is None else best.unionByName(met)
        w = Window.partitionBy(*own).orderBy("d2", "row_id")
        ranked = checkpointed(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= want))
        best = ranked.drop("rank")
        bound = ranked.join(parts, by).where(F.col("rank") == F.ceil(want * (1 + 1 / F.col("parts")) / 2)).select(*own, F.col("d2").alias("bound"))
        near = met.join(bound, own, "left").where(F.col("bound").isNull() | (F.col("d2") <= (1 + eps) * F.col("bound")))
        new = near.join(edges, [*keys, "row_id"]).select(*own, F.explode("edges").alias("row_id")).distinct().join(seen, [*own, "row_id"], "left_anti")
        new = checkpointed(new)
        seen = seen.unionByName(new)  # tables of rounds, none is written twice
    if best is None:
        best = new.select(*own, "row_id", F.lit(0.0).alias("d2"))
    return best.select(*by, "query_id", "row_id", "d2"), seen.groupBy(*by, "query_id").agg(F.count("*").alias("visited"))
