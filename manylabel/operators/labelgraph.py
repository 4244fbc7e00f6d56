"""Neighbours in label space: an inverted index whose buckets give each row its best neighbours, with head labels pruned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def frequencies(labels: DataFrame) -> DataFrame:
    """How often each label occurs; repeats in a row count."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def head_threshold(freq: DataFrame, budget: Column | int) -> DataFrame:
    """One row ``threshold``: the largest frequency whose self-join pairs, with those of all rarer labels, fit the budget.

    The running sum goes over distinct frequencies, of which there are at most the square root
    of twice the number of entries, instead of over labels.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    hist = freq.groupBy("n").agg(F.count("*").alias("c")).withColumn("pairs", F.col("n") * F.col("n") - F.col("n"))
    before = F.coalesce(F.sum(F.col("c") * F.col("pairs")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hist.withColumn("run", before + F.col("pairs")).agg(F.coalesce(F.max(F.when(F.col("run") <= budget, F.col("n"))), F.lit(0)).cast("bigint").alias("threshold"))


def prune_heads(labels: DataFrame, freq: DataFrame, threshold: DataFrame) -> DataFrame:
    rare = freq.join(F.broadcast(threshold)).where(F.col("n") <= F.col("threshold")).select("label")
    return labels.join(rare, "label", "left_semi")


def top(scored: DataFrame, by: tuple[str, ...], score: Column, tie: str, m: int) -> DataFrame:
    """The best ``m`` of each group by descending score, ties by ascending id, with ``rank`` from 1."""
    w = Window.partitionBy(*by).orderBy(score.desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


#: A label held by more rows than this is not joined with itself row by row.
HOT = 4096
#: Entries of the inverted index in one bucket of labels, and the cells of a tile of scores in a task.
BUCKET, CELLS = 50_000, 1 << 20


def label_knn(labels: DataFrame, m: int, normalize: bool = True, within: tuple[str, ...] = (), pruned: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """``(within, row_id, rank, neighbor, score)``: the lists of :func:`label_lists`, a line for each neighbour."""
    d = label_lists(labels, m, normalize, within, pruned, hot).select(*within, "row_id", F.posexplode(F.arrays_zip("near", "scores")).alias("at", "x"))
    return d.select(*within, "row_id", (F.col("at") + 1).alias("rank"), F.col("x.near").alias("neighbor"), F.col("x.scores").alias("score"))


def label_lists(labels: DataFrame, m: int, normalize: bool = True, within: tuple[str, ...] = (), pruned: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """``(within, row_id, near, scores)``: rows that share most labels, best first, each shared label counting 1 / the neighbour's number of labels.

    Exact for labels of any frequency. Each row goes with all of its labels to the bucket of each label of at most ``hot`` rows;
    there the whole scores of all rows of the label are known, and only a row's best ``m`` of each of its labels leave the
    bucket. So what is shuffled grows with entries (times labels of a row, and times ``m``), never with pairs of rows.
    What rows share by hotter labels alone depends on their sets of hot labels and on the neighbour's size, so
    such neighbours come from :func:`_hot_neighbors`, which joins sets instead of rows. Rows without neighbours have no list.
    """
    by = list(within)
    size = labels.groupBy(*by, "row_id").agg(F.count("*").alias("size"), F.collect_list("label").alias("held"))
    if pruned is not None:
        size = size.drop("held").join(pruned.groupBy(*by, "row_id").agg(F.collect_list("label").alias("held")), [*by, "row_id"])
    profiles = checkpointed(size.dropna(subset=[*by, "row_id"]).where(F.size("held") > 0))
    n = profiles.agg(F.sum(F.size("held"))).first()[0] or 0
    dealt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(max(1, -(-n // BUCKET)))).alias("bucket")
    entries = profiles.select("*", F.explode(F.array_distinct("held")).alias("label"))
    heads = checkpointed(profiles.select(*by, F.explode("held").alias("label")).groupBy(*by, "label").agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*by, "label"))
    has_heads = bool(heads.take(1))
    rare = entries.join(heads, [*by, "label"], "left_anti") if has_heads else entries
    kinds = {f.name: f.dataType.simpleString() for f in profiles.schema.fields}
    own = ", ".join(f"{c} {kinds[c]}" for c in (*by, "row_id"))
    lists = f"{own}, near array<{kinds['row_id']}>, scores array<double>"
    near = rare.select("*", dealt(*by, "label")).groupBy("bucket").applyInArrow(lambda t: _near_by_label(t, by, m, normalize), lists)
    if has_heads:  # a pair that shares rare labels too has a smaller score in the second list
        sets = entries.drop("held").join(heads, [*by, "label"], "left_semi").select(*by, "row_id", "label").distinct()
        sets = sets.groupBy(*by, "row_id").agg(F.collect_set("label").alias("hots"))
        hots = F.sort_array(F.filter("held", lambda x: F.array_contains("hots", x))).alias("hots")  # repeats included
        near = near.unionByName(_hot_neighbors(profiles.join(sets, [*by, "row_id"]).select(*by, "row_id", "size", hots), m, normalize, by))
    return near.select("*", dealt(*by, "row_id")).groupBy("bucket").applyInArrow(lambda t: _best_of_lists(t, by, m, has_heads), lists)


def _column(t: pa.Table, name: str) -> pa.Array:
    return t[name].combine_chunks() if t[name].num_chunks != 1 else t[name].chunk(0)


def _codes(*columns: pa.Array) -> np.ndarray:
    """Equal numbers for rows that are equal in all columns."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = c.dictionary_encode().indices.to_numpy().astype(np.int64)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return code


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and the length of the run of equal keys that each place is in."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.r_[first, len(keys)])
    return np.repeat(first, length), np.repeat(length, length)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for each run, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _near_by_label(t: pa.Table, by: list[str], m: int, normalize: bool) -> pa.Table:
    """Each row's best ``m`` others among the rows of a label, for the labels of one bucket, by all labels that both hold."""
    held, n = _column(t, "held"), t.num_rows
    at = np.repeat(np.arange(n), held.value_lengths().to_numpy())
    codes = pa.concat_arrays([_column(t, "label"), held.flatten()]).dictionary_encode().indices.to_numpy().astype(np.int64)
    own, has = codes[:n], codes[n:]
    group = _codes(*[_column(t, c) for c in by], pa.array(own))
    count = np.bincount(group)[group]
    ids = _column(t, "row_id").to_numpy(zero_copy_only=False)
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], group, count))  # groups of like size side by side, rows by id
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ids, size, (start, count) = ids[order], _column(t, "size").to_numpy()[order], _runs(group[order])
    is_own = has == own[at]
    weight = np.bincount(place[at[is_own]], minlength=n)  # how often the row repeats the label
    # what rows of a label share beside it: items (row, how often) in runs of one other label
    key, row = (group[at] * (codes.max() + 1) + has)[~is_own], place[at[~is_own]]
    o = np.lexsort((row, key))
    key, row = key[o], row[o]
    first = np.flatnonzero(_first(key, row))
    key, row, times = key[first], row[first], np.diff(np.r_[first, len(key)])
    run, length = _runs(key)
    items = np.flatnonzero(length > 1)
    items = items[np.argsort(row[items], kind="stable")]
    rows_of_items = row[items]
    lists, i, out = [], int(np.searchsorted(count, 2)), []
    while i < n:
        j = min(n, i + max(1, CELLS // count[i]))
        j = min(j, i + max(1, CELLS // count[j - 1]))
        width = int(count[j - 1])
        other = start[i:j, None] + np.arange(width)
        real = (np.arange(width) < count[i:j, None]) & (other != np.arange(i, j)[:, None])
        other = np.minimum(other, n - 1)
        common = weight[i:j, None] * weight[other]
        mine = items[np.searchsorted(rows_of_items, i) : np.searchsorted(rows_of_items, j)]
        cuts = np.flatnonzero(np.diff(np.cumsum(length[mine]) // CELLS)) + 1
        for part in np.split(mine, cuts):
            theirs, a = _spread(run[part], length[part]), np.repeat(part, length[part])
            np.add.at(common, (row[a] - i, row[theirs] - start[row[a]]), times[a] * times[theirs])
        score = np.where(real, common / size[other] if normalize else common.astype(float), -1.0)
        best = np.argsort(-score, axis=1, kind="stable")[:, :m]
        score = np.take_along_axis(score, best, 1)
        found = score > 0
        lists.append((found.sum(1), ids[np.take_along_axis(other, best, 1)[found]], score[found]))
        out.append(np.arange(i, j))
        i = j
    take = pa.array(order[np.concatenate(out)] if out else np.zeros(0, np.int64))
    lengths, near, scores = [np.concatenate(x) for x in zip(*lists)] if lists else (np.zeros(0, np.int64), ids[:0], np.zeros(0))
    offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    columns = {c: _column(t, c).take(take) for c in (*by, "row_id")}
    near = pa.ListArray.from_arrays(offsets, pa.array(near, type=_column(t, "row_id").type))
    return pa.table(columns | {"near": near, "scores": pa.ListArray.from_arrays(offsets, pa.array(scores, type=pa.float64()))})


def _first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a run of equal pairs begins."""
    return np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)


def _best_of_lists(t: pa.Table, by: list[str], m: int, bounds: bool) -> pa.Table:
    """The best ``m`` of each row's lists together; a neighbour that stands in several counts once, with ``bounds`` (scores of a pair may differ) by its best score."""
    near = _column(t, "near")
    at = np.repeat(np.arange(t.num_rows), near.value_lengths().to_numpy())
    row, flat = _codes(*[_column(t, c) for c in (*by, "row_id")])[at], near.flatten()
    score, ids = _column(t, "scores").flatten().to_numpy(), flat.to_numpy(zero_copy_only=False)
    rank = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
    order = np.flatnonzero(ids != _column(t, "row_id").to_numpy(zero_copy_only=False)[at])
    if bounds:  # the best score of a pair first
        order = order[np.lexsort((-score[order], rank[order], row[order]))]
        order = order[_first(row[order], rank[order])]
    order = order[np.lexsort((rank[order], -score[order], row[order]))]
    order = order[_first(row[order], rank[order])]
    order = order[np.arange(len(order)) - _runs(row[order])[0] < m]
    first = np.flatnonzero(_first(row[order], row[order]))
    offsets = pa.array(np.r_[first, len(order)].astype(np.int32))
    columns = {c: _column(t, c).take(pa.array(at[order[first]])) for c in (*by, "row_id")}
    return pa.table(columns | {"near": pa.ListArray.from_arrays(offsets, flat.take(pa.array(order))), "scores": pa.ListArray.from_arrays(offsets, pa.array(score[order], type=pa.float64()))})


def _hot_neighbors(profiles: DataFrame, m: int, normalize: bool, by: list[str]) -> DataFrame:
    """``(by, row_id, near, scores)`` by the hot labels alone: for each row at least its best ``m``, ties by id, and maybe itself.

    ``profiles`` is (by, row_id, size, hots). Rows of equal ``hots`` and ``size`` score alike as neighbours, so only the
    ``m + 1`` least ids of each such profile can be among anybody's best ``m`` (one may be the row itself); and rows of
    equal ``hots`` have the same list. Profiles are joined by label, so the work follows the number of
    different sets, not that of the rows; a row only meets the list of its set.
    """
    first = Window.partitionBy(*by, "hots", "size").orderBy("row_id")
    members = profiles.withColumn("at", F.row_number().over(first)).where(F.col("at") <= m + 1).select(*by, F.col("hots").alias("theirs"), "size", F.col("row_id").alias("neighbor"))
    mine = profiles.select(*by, "hots").distinct()
    theirs = profiles.select(*by, F.col("hots").alias("theirs"), "size").distinct()
    pairs = mine.withColumn("label", F.explode("hots")).join(theirs.withColumn("label", F.explode("theirs")), [*by, "label"])
    pairs = pairs.groupBy(*by, "hots", "theirs", "size").agg(F.count("*").alias("common"))
    score = F.col("common") / F.col("size") if normalize else F.col("common").cast("double")
    best = pairs.select(*by, "hots", "theirs", "size", score.alias("score")).join(members, [*by, "theirs", "size"])
    best = top(best, (*by, "hots"), F.col("score"), "neighbor", m + 1).groupBy(*by, "hots").agg(F.collect_list(F.struct("neighbor", "score")).alias("x"))
    rows = profiles.select(*[F.col(c).alias(c) for c in (*by, "hots", "row_id")])
    return rows.join(best, [*by, "hots"]).select(*by, "row_id", F.col("x.neighbor").alias("near"), F.col("x.score").alias("scores"))


def amplify(ranked: DataFrame, m: int, by: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Lists shorter than ``m`` repeat in order to ``m`` entries, ``slot`` 0 to m - 1; empty lists stay empty."""
    d = ranked.withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    copies = F.floor((F.lit(m) - F.col("rank")) / F.col("__n")).cast("int")
    d = d.where(F.col("rank") <= m).withColumn("__c", F.explode(F.sequence(F.lit(0), copies)))
    return d.withColumn("slot", (F.col("rank") - 1 + F.col("__c") * F.col("__n")).cast("bigint")).drop("__n", "__c", "rank")


def amplified(lists: DataFrame, m: int, by: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``(by, slot, neighbor)`` as by :func:`amplify`, from the lists of :func:`label_lists`: made where a list is, nothing is shuffled."""
    d = lists.select(*by, F.posexplode(repeated("near", m)).alias("slot", "neighbor"))
    return d.select(*by, F.col("slot").cast("bigint").alias("slot"), "neighbor")


def repeated(near: str, m: int) -> Column:
    """A list's first ``m``, a shorter one repeated to ``m``; an empty one stays empty."""
    return F.when(F.size(near) > 0, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.get(near, i % F.size(near)))).otherwise(F.col(near))


def negative_list(row_id: Column, m: int, n: int, epoch: int = 0) -> Column:
    """A row's ``m`` row numbers below ``n``, drawn with replacement by integer arithmetic, the same on any cluster."""
    wide = F.lit(1103515245).cast("decimal(10,0)") * row_id.cast("decimal(19,0)")  # 64 bits do not hold it for large ids
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint")), lambda slot: ((wide + F.lit(12345) * slot + F.lit(7 * epoch)) % F.lit(n)).cast("bigint"))


def negatives(rows: DataFrame, m: int, n: int, epoch: int = 0) -> DataFrame:
    """``(row_id, slot, negative)``: the draws of :func:`negative_list`."""
    d = rows.select("row_id", F.posexplode(negative_list(F.col("row_id"), m, n, epoch)).alias("slot", "negative"))
    return d.select("row_id", F.col("slot").cast("bigint").alias("slot"), "negative")
