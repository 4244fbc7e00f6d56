"""Linear embeddings of sparse rows: projection, the ranking loss, the learner, and leave-one-out quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import unit
from ..params import Params
from ..session import bucketed, checkpointed, emptied, written
from .labelgraph import amplified, label_lists, top
from .partition import dense_numbers

#: Rows of a cluster that is learned in one task; batches of an epoch of a larger one.
GROUP_ROWS, BATCHES = 20_000, 4
#: Entries of a tile of rows and features; once there are ``TILES``, tiles grow to ``MAX_TILE`` entries before they become more.
TILE, MAX_TILE, TILES = 250_000, 4_000_000, 32


def project(features: DataFrame, projections: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(learner, cluster, row_id, emb)``: each row by its cluster's matrix; unknown features add nothing, a row of unknown features has no embedding."""
    d = features.join(assigned.select("learner", "cluster", "row_id"), "row_id").join(projections, ["learner", "cluster", "fid"])
    width = projections.agg(F.max(F.size("w"))).first()[0] or 0
    d = d.groupBy("learner", "cluster", "row_id").agg(_summed(F.col("w"), F.col("val"), width).alias("emb"), F.max(F.size("w")).alias("n"))  # one row for each row, not for each dimension
    return d.where("n > 0").select("learner", "cluster", "row_id", F.slice("emb", 1, F.col("n")).alias("emb"))


def rank_coefficients(cosines: DataFrame, gamma: float) -> DataFrame:
    """``(row_id, role, slot, coefficient)`` from ``(row_id, role, slot, cosine)``, role ``p`` or ``q``.

    Each positive p has the loss ``log(1 + sum over q of exp(-gamma (cos p - cos q)))``; the
    coefficients are the ascent directions of the cosines.
    """
    p = cosines.where("role = 'p'").select("row_id", F.col("slot").alias("ps"), F.col("cosine").alias("pc"))
    q = cosines.where("role = 'q'").select("row_id", F.col("slot").alias("qs"), F.col("cosine").alias("qc"))
    t = p.join(q, "row_id").withColumn("t", F.exp(-gamma * (F.col("pc") - F.col("qc"))))
    denom = t.groupBy("row_id", "ps").agg((1 + F.sum("t")).alias("denom"))
    a = t.join(denom, ["row_id", "ps"]).withColumn("a", gamma * F.col("t") / F.col("denom"))
    up = a.groupBy("row_id", F.lit("p").alias("role"), F.col("ps").alias("slot")).agg(F.sum("a").alias("coefficient"))
    down = a.groupBy("row_id", F.lit("q").alias("role"), F.col("qs").alias("slot")).agg((-F.sum("a")).alias("coefficient"))
    return up.union(down)


def _label_lists(labels: list[np.ndarray], m: int, normalize: bool) -> list[np.ndarray]:
    """Each row's label neighbours in its own group, repeated to ``m``; ties by position."""
    holders: dict[int, list[int]] = {}
    for i, own in enumerate(labels):
        for x in own:
            holders.setdefault(int(x), []).append(i)
    out = []
    for i, own in enumerate(labels):
        near = np.concatenate([holders[int(x)] for x in own] or [np.empty(0, int)]).astype(int)
        near, common = np.unique(near[near != i], return_counts=True)
        score = common / np.array([len(labels[j]) for j in near]) if normalize else common
        best = near[np.lexsort((near, -score))][:m]
        out.append(np.resize(best, m) if len(best) else best)
    return out


def _learn(x: list[tuple[np.ndarray, np.ndarray]], labels: list[np.ndarray], n_features: int, p: Params, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and the rows' unit embeddings after ``emb_iter`` epochs of AdaGrad on the ranking loss."""
    rng = np.random.default_rng(seed)
    bound = 1 / np.sqrt(max(np.mean([len(f) for f, _ in x]), 1))
    w = rng.uniform(-bound, bound, (n_features, p.emb_size))
    grown = np.ones_like(w)
    near = _label_lists(labels, p.num_nn, p.label_normalize > 0)

    def step(i: int, g: np.ndarray) -> None:
        f, v = x[i]
        g = v[:, None] * g[None]
        grown[f] += g * g  # a row's features are distinct
        w[f] += p.eta0 * g / np.sqrt(grown[f])

    def toward(h: np.ndarray, nh: float, others: np.ndarray, no: np.ndarray, inner: np.ndarray, a: np.ndarray) -> np.ndarray:
        """The gradients at ``h`` of the cosines with each of ``others``, weighted by ``a``."""
        return (a / (nh * no))[:, None] * (others - (inner / (nh * nh))[:, None] * h)

    for _ in range(p.emb_iter):
        for i in rng.permutation(len(x)):
            if not len(near[i]):
                continue
            pos, neg = near[i], rng.integers(0, len(x), len(near[i]))
            z = lambda j: x[j][1] @ w[x[j][0]]
            base, zs = z(i), np.stack([z(j) for j in (*pos, *neg)])
            n0, ns = np.linalg.norm(base), np.linalg.norm(zs, axis=1)
            if not n0:
                continue
            sound, ns = ns > 0, np.where(ns > 0, ns, 1)
            inner = zs @ base
            cos = inner / (n0 * ns)
            t = np.exp(-p.gamma * (cos[: len(pos), None] - cos[None, len(pos) :]))
            a = p.gamma * t / (1 + t.sum(axis=1, keepdims=True))
            a = np.concatenate([a.sum(axis=1), -a.sum(axis=0)]) * sound
            step(i, toward(base, n0, zs, ns, inner, a).sum(axis=0))
            back = (a / (n0 * ns))[:, None] * (base[None] - (inner / (ns * ns))[:, None] * zs)
            for j, g in zip((*pos, *neg), back):
                step(j, g)
    emb = np.stack([v @ w[f] for f, v in x])
    n = np.linalg.norm(emb, axis=1, keepdims=True)
    return w, np.where(n > 0, emb / np.where(n > 0, n, 1), emb)


def fit(features: DataFrame, labels: DataFrame, assigned: DataFrame, p: Params, max_rows: int = GROUP_ROWS, batches: int = BATCHES, matrices: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """Projections ``(learner, cluster, fid, w)`` and embeddings ``(learner, cluster, row_id, emb)``, one matrix for each cluster.

    Without ``matrices`` the projections of clusters of up to ``max_rows`` are learned but not stored, and none are returned: they take many times the room of the embeddings. A cluster of up to ``max_rows`` rows is learned in one group of one task; the rows and the
    matrix of a larger one stay spread over all tasks (:func:`fit_sharded`).
    """
    features = features.groupBy("row_id", "fid").agg(F.sum("val").alias("val"))
    size = assigned.groupBy("learner", "cluster").agg(F.count("*").alias("n"))
    large = checkpointed(size.where(F.col("n") > max_rows).select("learner", "cluster"))
    any_large = bool(large.take(1))
    if not any_large:
        return fit_groups(features, labels, assigned, p, matrices)
    small = assigned.join(large, ["learner", "cluster"], "left_anti")
    any_small = bool(small.take(1))
    if any_small:
        features = checkpointed(features)  # read twice
    w, emb = fit_sharded(features, labels, assigned.join(large, ["learner", "cluster"], "left_semi"), p, batches)
    if any_small:
        more_w, more_emb = fit_groups(features, labels, small, p, matrices)
        w, emb = w.unionByName(more_w) if matrices else w, emb.unionByName(more_emb)
    return w if matrices else None, emb


def fit_groups(features: DataFrame, labels: DataFrame, assigned: DataFrame, p: Params, matrices: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """As :func:`fit`, each cluster in one group: for clusters that a task holds."""
    rows = features.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("fid", "val"))).alias("f"))
    rows = rows.join(labels.groupBy("row_id").agg(F.sort_array(F.collect_list("label")).alias("l")), "row_id", "left")
    d = assigned.select("learner", "cluster", "row_id").join(rows, "row_id")
    d = d.select("learner", "cluster", "row_id", F.transform("f", lambda s: s["fid"].cast("int")).alias("fids"), F.transform("f", lambda s: s["val"].cast("double")).alias("vals"), F.coalesce("l", F.array().cast("array<int>")).cast("array<int>").alias("l"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("row_id")
        ids = np.unique(np.concatenate([*g["fids"]]))  # features of this cluster, in order
        x = [(np.searchsorted(ids, f), np.asarray(v)) for f, v in zip(g["fids"], g["vals"])]
        w, emb = _learn(x, [np.asarray(v) for v in g["l"]], len(ids), p, hash((p.seed, *map(int, key))) & 0x7FFFFFFF)
        out = pd.DataFrame({"kind": 1, "key": g["row_id"].to_numpy(), "vec": list(emb)})
        if matrices:
            out = pd.concat([pd.DataFrame({"kind": 0, "key": ids, "vec": list(w)}), out])
        out["learner"], out["cluster"] = key
        return out[["learner", "cluster", "kind", "key", "vec"]]

    both = checkpointed(d.groupBy("learner", "cluster").applyInPandas(run, "learner int, cluster int, kind int, key long, vec array<double>"))
    w = both.where("kind = 0").select("learner", "cluster", F.col("key").cast("int").alias("fid"), F.col("vec").alias("w"))
    return w if matrices else None, both.where("kind = 1").select("learner", "cluster", F.col("key").alias("row_id"), F.col("vec").alias("emb"))


# a cluster of any size: rows and matrix are tables

_CLUSTER = ["learner", "cluster"]
_TILE = [*_CLUSTER, "fb", "rb"]


def _summed(values: Column, scale: Column, size: int) -> Column:
    """The sum of scaled vectors as one sum for each component, which Spark adds up before it shuffles."""
    return F.array(*[F.sum(F.get(values, d) * scale) for d in range(size)])


def _uniform(*key: Column | str) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 52)) / float(1 << 52)


def start_weights(x: DataFrame, p: Params) -> DataFrame:
    """State ``(learner, cluster, fid, w, grown)``: uniform within 1 / sqrt(a row's mean number of features), and AdaGrad sums of 1."""
    bound = x.groupBy(*_CLUSTER).agg((1 / F.sqrt(F.count("*") / F.countDistinct("row_id"))).alias("bound"))
    d = x.select(*_CLUSTER, "fid").distinct().join(bound, _CLUSTER)
    w = F.transform(F.sequence(F.lit(0), F.lit(p.emb_size - 1)), lambda i: (2 * _uniform(F.lit(p.seed), F.lit("w"), "learner", "cluster", "fid", i) - 1) * F.col("bound"))
    return d.select(*_CLUSTER, "fid", w.alias("w"), F.array_repeat(F.lit(1.0), p.emb_size).alias("grown"))


def tile_shape(x: DataFrame) -> tuple[int, int]:
    """Numbers of feature blocks and row blocks of tiles of ``x``, with as many copies of a row as of a feature or nearly so.

    Vectors go to the tiles of their block, and sums leave them, so what is shuffled grows with the root of the number of tiles.
    """
    n, rows, fids = x.agg(F.count("*"), F.approx_count_distinct("row_id"), F.approx_count_distinct("fid")).first()
    tiles = -(-n // min(max(TILE, n // TILES), MAX_TILE))
    blocks = min(max(1, round((tiles * max(fids, 1) / max(rows, 1)) ** 0.5)), max(tiles, 1))
    return blocks, max(1, -(-tiles // blocks))


def packed(x: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """One row for each tile of ``x(learner, cluster, row_id, fid, val)``: its distinct rows and features, and of each entry their places and its value."""
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    x = x.select(*_CLUSTER, "row_id", "fid", F.col("val").cast("double").alias("val"), block("fid", shape[0]).alias("fb"), block("row_id", shape[1]).alias("rb"))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    types = {c: to_arrow_type(x.schema[c].dataType) for c in x.columns}

    def one(t: pa.Table) -> pa.Table:
        out = {c: pa.array([t[c][0].as_py()], types[c]) for c in _TILE}
        for c in ("row_id", "fid"):
            ids, at = np.unique(t[c].to_numpy(), return_inverse=True)
            out |= {c: pa.array([ids], pa.list_(types[c])), f"{c}_at": pa.array([at.astype(np.int32)], pa.list_(pa.int32()))}
        return pa.table(out | {"val": pa.array([t["val"].to_numpy()], pa.list_(pa.float64()))})

    own = ", ".join(f"{c} {kinds[c]}" for c in _TILE)
    return x.groupBy(*_TILE).applyInArrow(one, f"{own}, row_id array<{kinds['row_id']}>, row_id_at array<int>, fid array<{kinds['fid']}>, fid_at array<int>, val array<double>")


def _summed_in_tiles(tiles: DataFrame, other: DataFrame, shape: tuple[int, int], on: str, vectors: str, by: str, size: int, whole: bool) -> DataFrame:
    """``(learner, cluster, by, sums)``: the sums of ``val`` times the vector of ``other`` that belongs to an entry's ``on``, a row for each ``by`` of a tile.

    A vector goes to all tiles of its block. A ``by`` without any vector has zeros if ``whole``, else it is left out.
    """
    mine, n, theirs, m = ("fb", shape[0], "rb", shape[1]) if on == "fid" else ("rb", shape[1], "fb", shape[0])
    other = other.select(*_CLUSTER, on, vectors, F.pmod(F.xxhash64(on), F.lit(n)).cast("int").alias(mine)).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    kind = tiles.schema[by].dataType.elementType
    types = {c: to_arrow_type(tiles.schema[c].dataType) for c in _CLUSTER}
    flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy()

    def one(a: pa.Table, b: pa.Table) -> pa.Table:
        keys, sums = np.zeros(0, int), np.zeros((0, size))
        if a.num_rows:
            keys, place, at, val, want = (flat(a, c) for c in (by, f"{by}_at", f"{on}_at", "val", on))
            wide = np.zeros((len(want), size))  # zeros for those without a vector
            known = np.zeros(len(want), bool)
            if b.num_rows:
                ids = b[on].to_numpy()
                order = np.argsort(ids)
                to = order[np.minimum(np.searchsorted(ids, want, sorter=order), len(ids) - 1)]
                known = ids[to] == want
                wide[known] = flat(b, vectors).reshape(-1, size)[to[known]]
            sums = np.stack([np.bincount(place, val * wide[at, d], len(keys)) for d in range(size)], axis=1)
            if not whole:
                met = np.bincount(place, known[at], len(keys)) > 0
                keys, sums = keys[met], sums[met]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * size), pa.array(sums.ravel()))
        own = {c: pa.array([a[c][0].as_py()] * len(keys) if len(keys) else [], types[c]) for c in _CLUSTER}
        return pa.table(own | {by: pa.array(keys, type=to_arrow_type(kind)), "sums": lists})

    schema = ", ".join([*(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in _CLUSTER), f"{by} {kind.simpleString()}", "sums array<double>"])
    parts = tiles.groupBy(*_TILE).cogroup(other.groupBy(*_TILE)).applyInArrow(one, schema)
    return parts.groupBy(*_CLUSTER, by).agg(_summed(F.col("sums"), F.lit(1.0), size).alias("sums"))


def projected(tiles: DataFrame, state: DataFrame, size: int, shape: tuple[int, int]) -> DataFrame:
    """``(learner, cluster, row_id, z)`` of the rows of :func:`packed` tiles; every row is there.

    A tile sums its rows where it is, so what is shuffled besides the packed entries is a
    vector for each row and block of features, and not one for each entry.
    """
    return _summed_in_tiles(tiles, state, shape, "fid", "w", "row_id", size, True).withColumnRenamed("sums", "z")


def feature_gradients(tiles: DataFrame, g: DataFrame, size: int, shape: tuple[int, int]) -> DataFrame:
    """``(learner, cluster, fid, g)``: the gradients ``g(learner, cluster, row_id, g)`` of rows summed by their features."""
    return _summed_in_tiles(tiles, g, shape, "row_id", "g", "fid", size, False).withColumnRenamed("sums", "g")


def row_gradients(z: DataFrame, pairs: DataFrame, gamma: float, size: int) -> DataFrame:
    """``(learner, cluster, row_id, g)``: the summed ascent directions of the ranking objective at each row's ``z``.

    ``pairs`` is (learner, cluster, row_id, role, slot, other), role 1 for positives and 0 for negatives. A
    base's own gradient and those of its positives and negatives count; rows of zeros have none.
    """
    own = [F.col(c).alias(c) for c in _CLUSTER]
    held = pairs.join(z.select(*own, F.col("row_id").alias("other"), F.col("z").alias("oz")), [*_CLUSTER, "other"])
    held = held.groupBy(*_CLUSTER, "row_id").agg(F.sort_array(F.collect_list(F.struct("role", "slot", "other", "oz"))).alias("near"))  # as many as slots
    held = held.join(z, [*_CLUSTER, "row_id"])

    def directions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t, c, i, near, base in zip(frame["learner"], frame["cluster"], frame["row_id"], frame["near"], frame["z"]):
                base, zs = np.asarray(base, float), np.array([np.asarray(x["oz"], float) for x in near])
                role = np.array([x["role"] for x in near])
                n0, ns = np.linalg.norm(base), np.linalg.norm(zs, axis=1)
                if not n0 or role.all() or not role.any():
                    continue
                sound, ns = ns > 0, np.where(ns > 0, ns, 1)
                inner = zs @ base
                cos = inner / (n0 * ns)
                term = np.exp(-gamma * (cos[role == 1][:, None] - cos[role == 0][None]))
                a = gamma * term / (1 + term.sum(axis=1, keepdims=True))
                each = np.zeros(len(role))
                each[role == 1], each[role == 0] = a.sum(axis=1), -a.sum(axis=0)
                each = (each * sound / (n0 * ns))[:, None]
                out.append((t, c, i, (each * (zs - (inner / (n0 * n0))[:, None] * base)).sum(axis=0)))
                out += [(t, c, x["other"], g) for x, g in zip(near, each * (base - (inner / (ns * ns))[:, None] * zs))]
            yield pd.DataFrame(out, columns=[*_CLUSTER, "row_id", "g"])

    g = held.mapInPandas(directions, "learner int, cluster int, row_id long, g array<double>")
    return g.groupBy(*_CLUSTER, "row_id").agg(_summed(F.col("g"), F.lit(1.0), size).alias("g"))


def adagrad_step(x: DataFrame, state: DataFrame, pairs: DataFrame, p: Params, shape: tuple[int, int] | None = None) -> DataFrame:
    """The state after one batch: rows are projected, and the gradients of the pairs' rows summed by feature. With ``shape``, ``x`` is packed already."""
    if shape is None:
        shape = tile_shape(x)
        x = checkpointed(packed(x, shape))
    g = row_gradients(projected(x, state, p.emb_size, shape), pairs, p.gamma, p.emb_size)
    by_feature = feature_gradients(x, g, p.emb_size, shape)
    d = state.join(by_feature, [*_CLUSTER, "fid"], "left")
    grown = F.when(F.col("g").isNull(), F.col("grown")).otherwise(F.zip_with("grown", "g", lambda n, v: n + v * v))
    d = d.select(*_CLUSTER, "fid", "w", "g", grown.alias("grown"))
    step = F.zip_with("g", "grown", lambda v, n: p.eta0 * v / F.sqrt(n))
    return d.select(*_CLUSTER, "fid", F.when(F.col("g").isNull(), F.col("w")).otherwise(F.zip_with("w", step, lambda w, v: w + v)).alias("w"), "grown")


def numbered_rows(assigned: DataFrame) -> DataFrame:
    """``(learner, cluster, row_id, at, n)``: rows numbered from 0 within their cluster, and its size."""
    d = checkpointed(dense_numbers(assigned, (*_CLUSTER, "row_id")))
    first = d.groupBy(*_CLUSTER).agg(F.min("number").alias("first"), F.count("*").alias("n"))  # one row for each cluster
    return d.join(first, _CLUSTER).select(*_CLUSTER, "row_id", (F.col("number") - F.col("first")).alias("at"), "n")


def fit_sharded(features: DataFrame, labels: DataFrame, assigned: DataFrame, p: Params, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """As :func:`fit`, for clusters of any size, all learners and clusters in the same jobs.

    The matrix is a table ``(learner, cluster, fid, w, grown)``. An epoch deals the rows to ``batches`` by a keyed hash.
    Entries are packed once in tiles of rows and features; a batch projects the rows and sums their
    gradients by feature in these tiles. Tiles and matrix stay in buckets, so that only vectors are shuffled. Neighbours and numbers are found once.
    """
    x = features.join(assigned.select("row_id", *_CLUSTER).hint("merge"), "row_id")
    x = checkpointed(x.select(*_CLUSTER, "row_id", "fid", F.col("val").cast("double").alias("val")))
    rows = checkpointed(x.select(*_CLUSTER, "row_id").distinct())
    near = label_lists(labels.join(rows, "row_id").select(*_CLUSTER, "row_id", "label"), p.num_nn, p.label_normalize > 0, within=tuple(_CLUSTER))
    positives = checkpointed(amplified(near, p.num_nn, (*_CLUSTER, "row_id")).select(*_CLUSTER, "row_id", F.lit(1).alias("role"), F.col("slot").cast("int").alias("slot"), F.col("neighbor").alias("other")))
    numbered = checkpointed(numbered_rows(rows))
    bases = checkpointed(numbered.join(positives.select(*_CLUSTER, "row_id").distinct(), [*_CLUSTER, "row_id"], "left_semi"))
    target = numbered.select(*_CLUSTER, "at", F.col("row_id").alias("other"))
    places = [*_CLUSTER, "fid"]
    state, at = bucketed(start_weights(x, p).repartition(*places), places)
    shape = tile_shape(x)
    tiles = bucketed(packed(x, shape), _TILE, shape[0] * shape[1])[0]
    for epoch in range(p.emb_iter):
        for b in range(batches):
            own = bases.where(F.pmod(F.xxhash64(F.lit(p.seed), F.lit(epoch), *_CLUSTER, "row_id"), F.lit(batches)) == b)
            drawn = own.select(*_CLUSTER, "row_id", "n", F.explode(F.sequence(F.lit(0), F.lit(p.num_nn - 1))).alias("slot"))
            drawn = drawn.select(*_CLUSTER, "row_id", "slot", F.pmod(F.xxhash64(F.lit(p.seed), F.lit("q"), F.lit(epoch), *_CLUSTER, "row_id", "slot"), F.col("n")).alias("at"))
            negatives = drawn.join(target, [*_CLUSTER, "at"]).select(*_CLUSTER, "row_id", F.lit(0).alias("role"), "slot", "other")
            pairs, pairs_at = written(positives.join(own.select(*_CLUSTER, "row_id"), [*_CLUSTER, "row_id"], "left_semi").union(negatives))
            new, new_at = bucketed(adagrad_step(tiles, state, pairs, p, shape), places)
            emptied(state, at)
            emptied(pairs, pairs_at)
            state, at = new, new_at
    emb = projected(tiles, state, p.emb_size, shape).select(*_CLUSTER, "row_id", unit(F.col("z")).alias("emb"))
    return state.select(*_CLUSTER, "fid", "w"), checkpointed(emb)


def local_precision(neighbours: DataFrame, labels: DataFrame, by: tuple[str, ...] = (), depth: int = 5) -> DataFrame:
    """``(by, k, precision)`` of the labels that each row's neighbours ``(by, row_id, neighbor)`` vote for, ties to the lesser label."""
    neighbours = checkpointed(neighbours.select(*by, "row_id", "neighbor"))  # read twice, and dear to find
    votes = neighbours.join(labels.withColumnRenamed("row_id", "neighbor"), "neighbor").groupBy(*by, "row_id", "label").agg(F.count("*").alias("votes"))
    ranked = top(votes, (*by, "row_id"), F.col("votes"), "label", depth)
    hit = ranked.join(labels.select("row_id", "label").distinct().withColumn("hit", F.lit(1)), ["row_id", "label"], "left")
    per_rank = hit.groupBy(*by, "rank").agg(F.count("hit").alias("hits"))
    rows = neighbours.select(*by, "row_id").distinct()
    n = rows.groupBy(*by).agg(F.count("*").alias("n")) if by else rows.agg(F.count("*").alias("n"))
    ks = neighbours.sparkSession.range(1, depth + 1).select(F.col("id").alias("k"))
    frame = n.join(F.broadcast(ks))  # depth rows
    got = frame.join(per_rank, list(by), "left") if by else frame.join(per_rank, F.lit(True), "left")
    return got.groupBy(*by, "k", "n").agg(F.coalesce(F.sum(F.when(F.col("rank") <= F.col("k"), F.col("hits"))), F.lit(0)).alias("h")).select(*by, "k", (F.col("h") / (F.col("n") * F.col("k"))).alias("precision"), "n")


def weighted_precision(per_cluster: DataFrame) -> DataFrame:
    """``(k, precision)`` over clusters, each weighted by its rows."""
    return per_cluster.groupBy("k").agg((F.sum(F.col("precision") * F.col("n")) / F.sum("n")).alias("precision"))


