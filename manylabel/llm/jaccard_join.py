"""N-gram Jaccard join by set-relation skipping, exact, for sets of word shingles.

Two relations between sets let work be skipped.

*Index level.* Shingles have one global order, rare ones first, and a set enters the lists of its
first shingles only, so many that two sets of a link share a list. An entry holds the set's size
and the shingle's position in it. What stands behind two positions bounds what the sets can still have in
common, so whole blocks of a list are skipped: a list without early entries goes where it
meets, later pairs are formed by blocks of sizes, and in a block only where the positions leave
enough. Lists of one set, nearly all, go too. The order comes from a count sketch of fixed size over all
sets; it decides how long lists get (a passage that many documents share comes last and is no
list), never what links.

*Answer level.* Each list is answered first for one set, its hub: how much every member differs from it. It is
the set in which the list's shingle stands first, as edits put rare shingles before it, so that edited copies
get the text that they were made from. The others' answers
are derived from the hub's. A member that links to the hub takes over the hub's class. Only members
that do not are compared with the list's others, and of these a linked one is left out if
the two differ from the hub by so different amounts that they cannot link. What is left is compared by a
bit sketch that cannot lose a link, and then by its shingles.

*Counts.* How many documents each one links with is derived from the hubs' answers, too: what two sets of one hub
differ in is what only one of them differs from the hub in, a small set that was kept with the hub's answer. Such sets meet in
tiles where they are counted; only links between sets without a common hub are rows.

Copies (equal sets) are one set from the start. No task gathers a group: lists enter a shuffle
once for each task, further members of a list are dealt by their own hash, hubs come from
partial aggregates, joins on lists are plain joins that adaptive execution splits, and comparisons
are dealt in blocks of 256 by 256 sets of a list. There are no caps: whatever the group's size, every pair of
different sets that could link is either of one class already or compared.

Sets and shingles are known by 64-bit hashes of their words.

Defined results: a null text or one without words has no set and links with nothing; fewer words
than a shingle make one shingle; a null id stays null and is nobody's class id unless all are, but
its text links others; repeated rows are copies; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, flagged, stored, table, unused
from .components import components
from .shingles import mix, sets_of

_U = np.uint64
#: Rows that a task of the index stage holds before it looks for lists of its own.
BUFFER_ROWS = 1_500_000
#: Ids that are broadcast to fetch sets; beyond, a bitmap picks the texts that a join then confirms.
MAX_BROADCAST_IDS = 1_000_000
#: The count sketch has 2**20 buckets, dealt in blocks; a task packs its counts.
COUNT_BITS, COUNT_BLOCK = 20, 1 << 16
SKETCH_BITS, MAX_SKETCH_BITS, BLOCK, CHUNK = 1024, 1 << 17, 256, 1 << 14


@dataclass(frozen=True)
class Threshold:
    """Links have ``den * intersection >= num * union``."""

    num: int
    den: int

    def most_differing(self, sizes):
        """Elements that are in one set only, at most, if two sets of this total size link."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)


def _bucket(u: np.ndarray) -> np.ndarray:
    return (u >> _U(64 - COUNT_BITS)).astype(np.int64)


def _list_keys(u: np.ndarray, t: Threshold, rank: np.ndarray | None = None) -> np.ndarray:
    """The index lists that a set belongs to: its first shingles in the order of ``rank`` (of sketch buckets) and hash.

    Two sets of a link have ``ceil(num * n / den)`` shingles of either in common, so one that
    leaves out fewer than that many of its last shingles cannot leave out all that are common.
    """
    n = len(u)
    if t.most_differing(n + n * t.den // t.num) < 1:  # only copies link
        return np.empty(0, _U)
    order = np.argsort(u if rank is None else (rank[_bucket(u)].astype(_U) << _U(48)) | (mix(u) >> _U(16)), kind="stable")
    return u[order[: n - -(-t.num * n // t.den) + 1]]


def _late(n: np.ndarray, at: np.ndarray, t: Threshold) -> np.ndarray:
    """Which entries are late: what precedes two of them is more than a link can differ in."""
    return at * (t.den + t.num) > n * (t.den - t.num)


def _packed_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.int64).tobytes())


def _unpacked_counts(payload: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.int64)


def _count_sets(n: int):
    """Texts to one task's counts of shingles by sketch bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_bucket(np.concatenate([*sets_of(batch.column(0), n), np.empty(0, _U)])), minlength=len(total))
        for at in range(0, len(total), COUNT_BLOCK):
            part = total[at : at + COUNT_BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // COUNT_BLOCK], pa.int32()), pa.array([_packed_counts(part)], pa.binary())], ["block", "counts"])

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one for each; one sum is held, however many tasks counted."""

    def out(block: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_packed_counts(total)], pa.binary())], ["block", "counts"])

    block, total = None, None
    for batch in batches:
        for b, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block:
                if block is not None:
                    yield out(block, total)
                block, total = b, np.zeros(COUNT_BLOCK, np.int64)
            total += _unpacked_counts(counts)
    if block is not None:
        yield out(block, total)


def _ranks(docs: DataFrame, n: int, text: str = "text") -> np.ndarray:
    """The place of each sketch bucket in the global order, rare first; the sketch's size is fixed whatever the corpus."""
    schema, parts = "block int, counts binary", (1 << COUNT_BITS) // COUNT_BLOCK
    blocks = docs.select(text).mapInArrow(_count_sets(n), schema).repartition(parts, "block").sortWithinPartitions("block")
    total = np.zeros(1 << COUNT_BITS, np.int64)
    for row in blocks.mapInArrow(_add_counts, schema).collect():  # 8 MB before packing
        total[row["block"] * COUNT_BLOCK :][:COUNT_BLOCK] = _unpacked_counts(row["counts"])
    return (np.log2(total + 1.0) * 256).astype(np.uint16)


def _set_id(u: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


_ALONE, _SHARED, _DEALT, _MEMBER = 0, 1, 2, 3
#: ``n`` is the set's size; in list entries the shingle's position stands above its 32 bits.
_INDEX = pa.schema([("route", pa.int64()), ("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("flag", pa.int8())])
_INDEX_DDL = "route long, key long, sid long, n long, flag byte"


def _index(n: int, t: Threshold, ranks: Broadcast):
    """Texts to list entries (dealt by list, but only one for each list and buffer) and to one member row each."""

    def entries(keys: list[np.ndarray], sizes: list[int], sids: list[int]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([*keys, np.empty(0, _U)]).view(np.int64)
        many = [len(k) for k in keys]
        sid, size = np.repeat(np.array(sids, np.int64), many), np.repeat(np.array(sizes, np.int64), many)
        at = np.concatenate([*map(np.arange, many), np.empty(0, np.int64)])
        order = np.lexsort((_late(size, at, t), key))  # an early entry stands for a list of this buffer if there is one
        sorted_ = key[order]
        first = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[: len(key)]
        flag = np.empty(len(key), np.int8)  # back in the order of sets, whose repeated ids pack well
        flag[order] = np.where(first, np.where(np.concatenate([first[1:], [True]])[: len(key)], _ALONE, _SHARED), _DEALT)
        route = np.where(flag == _DEALT, sid, key)
        for a in range(0, len(key), 50_000):
            cut = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (route, key, sid, at << 32 | size, flag)], schema=_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, sids, seen, held = [], [], [], set(), 0
        for batch in batches:
            ids = batch.column(0)
            own = sets_of(batch.column(1), n)
            sid = [_set_id(u) if len(u) else None for u in own]
            size = np.array([len(u) for u in own], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own)) * 7919 + len(sids)), ids, pa.array(sid, pa.int64()), pa.array(size), pa.array(np.full(len(own), _MEMBER, np.int8))], schema=_INDEX)
            for u, s in zip(own, sid):
                if s is not None and s not in seen:
                    seen.add(s)
                    k = _list_keys(u, t, ranks.value)
                    keys.append(k)
                    sizes.append(len(u))
                    sids.append(s)
                    held += len(k)
                    if held >= BUFFER_ROWS:
                        yield from entries(keys, sizes, sids)
                        keys, sizes, sids, seen, held = [], [], [], set(), 0
        yield from entries(keys, sizes, sids)

    return run


def _drop_lone(t: Threshold):
    """Of rows sorted by key, the entries of lists with at least two sets, one of them early; member rows as they are."""

    def lists(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, sid, n, flag = (rows.column(k).to_numpy() for k in (1, 2, 3, 4))
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(sid, start) != np.maximum.reduceat(sid, start)
        shared = np.maximum.reduceat(flag, start) == _SHARED
        late = np.logical_and.reduceat(_late(n & 0xFFFFFFFF, n >> 32, t), start)
        keep = np.repeat((several | shared) & ~late, np.diff(np.append(start, len(key))))
        yield from rows.filter(pa.array(keep)).to_batches(max_chunksize=50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _INDEX.empty_table()  # the rows of the last key
        for b in batches:
            listed = b.column(4).to_numpy() <= _SHARED
            if not listed.all():
                yield b.filter(pa.array(~listed))
            rows = pa.concat_tables([held, pa.Table.from_batches([b.filter(pa.array(listed))]).cast(_INDEX)])
            if rows.num_rows:
                key = rows.column(1).to_numpy()
                cut = int(np.argmax(key == key[-1]))
                if cut:
                    yield from lists(rows.slice(0, cut))
                held = rows.slice(cut)
        if held.num_rows:
            yield from lists(held)

    return run


def _sketch(u: np.ndarray) -> bytes:
    """The parity of the elements on each of 1,024 bits, or as many as a larger set needs: two sets' sketches differ in no more bits than the sets in elements."""
    bits = max(SKETCH_BITS, min(1 << len(u).bit_length(), MAX_SKETCH_BITS))
    bit = (mix(u + _U(0x51ED270B)) % _U(bits)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=bits) & 1).tobytes()


def _differing_bits(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """Of each pair of sketches; the longer is folded to the other's length, which gives the sketch of that length."""
    width = np.array([(len(x), len(y)) for x, y in zip(xs, ys)]).reshape(-1, 2)
    out = np.zeros(len(xs), np.int64)
    for wide in np.unique(width, axis=0):
        at = np.flatnonzero((width == wide).all(axis=1))
        x, y = (np.frombuffer(b"".join([s[k] for k in at]), _U).reshape(len(at), -1) for s in (xs, ys))
        while x.shape[1] != y.shape[1]:
            x, y = (z[:, : z.shape[1] // 2] ^ z[:, z.shape[1] // 2 :] if z.shape[1] > other.shape[1] else z for z, other in ((x, y), (y, x)))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _fetch(n: int, full: bool):
    """Texts to their sets: sizes and sketches, or the elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                own = sets_of(whole.column(0).slice(at, 500), n)
                sid = pa.array([_set_id(u) for u in own], pa.int64())
                if full:
                    yield pa.RecordBatch.from_arrays([sid, pa.array([u.tobytes() for u in own], pa.binary())], ["sid", "elements"])
                else:
                    yield pa.RecordBatch.from_arrays([sid, pa.array([len(u) for u in own], pa.int32()), pa.array([_sketch(u) for u in own], pa.binary())], ["sid", "n", "sketch"])

    return run


_SCORED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("low", pa.int64()), ("near", pa.bool_())])


def _score(t: Threshold):
    """Pairs with sizes and sketches to the least number of elements that they differ in, and whether that leaves room for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy().astype(np.int64)
            low = np.maximum(_differing_bits(b.column(4).to_pylist(), b.column(5).to_pylist()), abs(na - nb))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low), pa.array((low <= t.most_differing(na + nb)) & t.sizes_fit(na, nb))], schema=_SCORED)

    return run


def _linked(t: Threshold):
    """Pairs with their elements to the links among them, with the elements that each differs in and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, differ, delta = [], [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                u, v = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = np.concatenate([u, v])
                both.sort()
                same = both[1:] == both[:-1]
                common = int(np.count_nonzero(same))
                keep.append(t.den * common >= t.num * (len(both) - common))
                differ.append(len(both) - 2 * common)
                alone = ~(np.append(same, False) | np.insert(same, 0, False)) if keep[-1] else np.zeros(len(both), bool)
                delta.append(both[alone].tobytes())
            links = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(differ, pa.int64()), pa.array(delta, pa.binary())], ["a", "b", "differ", "delta"])
            yield links.filter(pa.array(keep, pa.bool_()))

    return run


def _verified(near: DataFrame, fetch: Callable[[DataFrame, bool], DataFrame], t: Threshold) -> DataFrame:
    """``(a, b, differ, delta)`` of the pairs that link by their elements; only the sets of these pairs are read again."""
    near = checkpointed(near)
    full = stored(fetch(near.select("a").union(near.select("b")).toDF("sid"), True))
    p = near.join(full.toDF("a", "ea"), "a").join(full.toDF("b", "eb"), "b").select("a", "b", "ea", "eb")
    return p.mapInArrow(_linked(t), "a long, b long, differ long, delta binary")


def _common(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``xs`` has in common with each of ``ys``: a product of 0-1 matrices, made in blocks of 4,096 elements."""
    out = np.zeros((len(xs), len(ys)), np.int64)
    shared = np.intersect1d(np.concatenate(xs), np.concatenate(ys))
    places = []
    for side in (xs, ys):
        of, element = np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side)
        at = np.searchsorted(shared, element)
        met = shared[np.minimum(at, len(shared) - 1)] == element if len(shared) else np.zeros(len(at), bool)
        places.append((of[met], at[met]))
    for first in range(0, len(shared), 4096):
        blocks = []
        for side, (of, at) in zip((xs, ys), places):
            here = (at >= first) & (at < first + 4096)
            block = np.zeros((len(side), min(4096, len(shared) - first)), np.float32)
            block[of[here], at[here] - first] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def _tiles(answer: Callable[[list[tuple]], Iterator[pa.RecordBatch]]):
    """Rows sorted by their first column, the tile, to the answers of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != tile:
                    yield from answer(rows)
                    tile, rows = r[0], []
                rows.append(r)
        yield from answer(rows)

    return run


def _count_links(t: Threshold):
    """Rows ``(tile, side, sid, n, times, hub, hubs, delta)`` of sets that link to ``hub`` to ``(sid, linked)``: the documents of the right side that each set of the left links to.

    What two sets differ in is what only one of them differs from the hub in. A pair counts with the least hub that both link to.
    """

    def count(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        left, right = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
        if not left or not right:
            return
        (sa, na, _), (sb, nb, times) = ([np.array([r[k] for r in side], np.int64) for k in (2, 3, 4)] for side in (left, right))
        xs, ys = ([np.frombuffer(r[7], _U) for r in side] for side in (left, right))
        earlier = [[np.array([h for h in r[6] if h < r[5]], np.int64) for r in side] for side in (left, right)]
        differ = np.array([len(x) for x in xs])[:, None] + np.array([len(y) for y in ys]) - 2 * _common(xs, ys)
        hub = [np.array([r[5] for r in side], np.int64) for side in (left, right)]
        link = (hub[0][:, None] == hub[1]) & (sa[:, None] != sb) & (differ <= t.most_differing(na[:, None] + nb)) & (_common(*earlier) == 0)
        yield pa.RecordBatch.from_arrays([pa.array(sa), pa.array(link.astype(np.int64) @ times)], ["sid", "linked"])

    return _tiles(count)


def _compare_blocks(t: Threshold, within: bool):
    """Rows ``(group, side, sid, class, n, at, low, differ, hubs, sketch)`` sorted by group to the pairs of the two sides that may link.

    Pairs of one class are left out; with ``within``, only those that link to one hub are (``hubs``: those that the set links to).

    ``low`` and ``differ`` are what is known of the set and its hub: at least, and exactly (null for a set that does not link to it).
    """

    def compare(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        left, right = [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
        if not left or not right:
            return
        (sa, ca, na, ia, la), (sb, cb, nb, ib, _) = ([np.array([r[k] for r in side], np.int64) for k in (2, 3, 4, 5, 6)] for side in (left, right))
        upper = np.array([2**40 if r[7] is None else r[7] for r in right], np.int64)
        sizes = na[:, None] + nb
        if within:
            own = [[np.array(r[8] or [], np.int64) for r in side] for side in (left, right)]
            may = (sa[:, None] != sb) & (_common(*own) == 0) & t.sizes_fit(na[:, None], nb)
        else:
            may = (ca[:, None] != cb) & t.sizes_fit(na[:, None], nb)
        may &= np.minimum((na - ia)[:, None], nb - ib) * (t.num + t.den) >= t.num * sizes  # what stands at the positions and behind
        may &= la[:, None] - upper <= t.most_differing(sizes)  # what the hub's answers say
        i, j = np.nonzero(may)
        one_width = len({len(r[9]) for r in rows}) == 1
        wide = [np.frombuffer(b"".join([r[9] for r in side]), _U).reshape(len(side), -1) for side in (left, right)] if one_width else None
        for at in range(0, len(i), CHUNK):
            x, y = i[at : at + CHUNK], j[at : at + CHUNK]
            if wide:
                bits = np.bitwise_count(wide[0][x] ^ wide[1][y]).sum(axis=1, dtype=np.int64)
            else:
                bits = _differing_bits([left[k][9] for k in x], [right[k][9] for k in y])
            near = bits <= t.most_differing(na[x] + nb[y])
            x, y = x[near], y[near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sa[x], sb[y])), pa.array(np.maximum(sa[x], sb[y]))], ["a", "b"])

    return _tiles(compare)


def _counted(links: DataFrame, hubs_of: DataFrame, more: DataFrame, sizes: DataFrame, t: Threshold) -> DataFrame:
    """``(sid, linked)``: with how many documents of other sets (``sizes``: ``sid, n, times``) each set links.

    ``links`` are those to hubs, with what the two differ in; ``more`` are the links of sets without a common hub. Sets of one hub meet in tiles and are counted there, so no row is made for a pair.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = links.select("a").distinct().select(F.col("a").alias("hub"), F.col("a").alias("sid"), F.expr("X''").alias("delta"))
    star = links.select(F.col("a").alias("hub"), F.col("b").alias("sid"), "delta").union(own).join(hubs_of, "sid").join(sizes, "sid")
    many = star.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))
    star = stored(star.join(many, "hub").withColumn("i", F.pmod(F.xxhash64("sid"), F.col("many")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("many") - 1))))
    side = lambda k, i, j: star.select(F.xxhash64("hub", i, j).alias("g"), F.lit(k).alias("side"), "sid", "n", "times", "hub", "hubs", "delta")
    tiles = side(0, "i", "j").union(side(1, "j", "i")).repartition(parts, "g").sortWithinPartitions("g", "hub")
    one_hub = tiles.mapInArrow(_count_links(t), "sid long, linked long")
    both = more.select("a", "b").union(more.select("b", "a")).toDF("other", "sid").join(sizes.select(F.col("sid").alias("other"), "times"), "other").select("sid", F.col("times").alias("linked"))
    return one_hub.union(both).groupBy("sid").agg(F.sum("linked").alias("linked"))


def _placed(docs: DataFrame, words: int, t: Threshold, id_column: str, text: str, count: bool = False) -> DataFrame:
    """One row for each document: ``id``, ``sid`` (its set), ``n``, ``root`` (its class), ``class_id`` and, if asked for, ``n_links``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    ranks = spark.sparkContext.broadcast(_ranks(d, words))
    rows = d.mapInArrow(_index(words, t, ranks), _INDEX_DDL).repartition(parts, "route").sortWithinPartitions("key")
    rows = stored(rows.mapInArrow(_drop_lone(t), _INDEX_DDL).drop("route"))
    members = rows.where(F.col("flag") == _MEMBER).select(F.col("key").alias("id"), "sid", "n")
    lists = rows.where(F.col("flag") < _MEMBER).groupBy("key", "sid").agg(F.min("n").alias("entry"))
    lists = lists.select("key", "sid", F.expr("entry & 4294967295").alias("n"), F.shiftright("entry", 32).alias("at"))

    # each list's hub and what its members differ from it
    early = F.min(F.col("at") * (t.den + t.num) - F.col("n") * (t.den - t.num)) <= 0
    hubs = lists.groupBy("key").agg(F.min(F.struct("at", "sid")).alias("h"), F.count("*").alias("many"), early.alias("early")).where("early AND many > 1")
    hubs = hubs.select("key", F.col("h.sid").alias("hub"), "many")
    entries = stored(lists.join(hubs, "key").where("sid <> hub").select("key", "hub", "sid", "n", "at", (F.col("many") > 2).alias("more")))
    stars = entries.select("hub", "sid").distinct()

    def fetch(wanted: DataFrame, full: bool) -> DataFrame:
        """Each wanted set, from the text of the least id that has it, or from the texts without id."""
        wanted = checkpointed(wanted.distinct())
        reps = checkpointed(members.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("id").alias("id")))
        ids, many = reps.where("id IS NOT NULL").select("id").distinct(), reps.count()
        few = many <= MAX_BROADCAST_IDS
        found = (d if few else flagged(d, F.col("id"), ids, many, "may").where("may")).join(F.broadcast(ids) if few else ids, "id", "left_semi").select("text")
        if reps.where("id IS NULL").take(1):
            found = found.union(d.where("id IS NULL").select("text"))
        schema = "sid long, elements binary" if full else "sid long, n int, sketch binary"
        return found.mapInArrow(_fetch(words, full), schema).join(wanted, "sid", "left_semi").dropDuplicates(["sid"])

    sketches = stored(fetch(entries.select("sid").union(entries.select("hub")), False))
    pairs = stars.toDF("a", "b").join(sketches.toDF("a", "na", "xa"), "a").join(sketches.toDF("b", "nb", "xb"), "b")
    scored = checkpointed(pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(_score(t), "a long, b long, low long, near boolean"))
    links = checkpointed(_verified(scored.where("near").select("a", "b"), fetch, t))
    roots = checkpointed(components(links.select("a", "b")))
    to_hubs = links.select(F.col("b").alias("sid"), F.col("a").alias("hub")).union(links.select("a", "a")).groupBy("sid").agg(F.collect_set("hub").alias("hubs"))

    # what hubs do not account for: members of another class (for counts, members that do not link to the hub) against the list's others, by bands of sizes
    told = scored.select(F.col("a").alias("hub"), F.col("b").alias("sid"), "low").join(links.select("a", "b", "differ").toDF("hub", "sid", "differ"), ["hub", "sid"], "left")
    told = told.join(roots.toDF("sid", "class"), "sid", "left").join(roots.toDF("hub", "hub_class"), "hub", "left")
    open_ = F.col("differ").isNull() if count else F.coalesce("class", "sid") != F.coalesce("hub_class", "hub")
    told = told.select("hub", "sid", "low", "differ", F.coalesce("class", "sid").alias("class"), open_.alias("open"))
    others = stored(entries.where("more").join(told, ["hub", "sid"]).drop("hub", "more").withColumn("band", F.floor(F.log("n") / (1.001 * math.log(t.den / t.num))).cast("int")))
    left = others.where("open")
    right = others.withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    size = left.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("lefts"))
    size = size.join(right.groupBy("key", "band").agg(F.count("*").alias("all")).where("all > 1"), ["key", "band"])
    size = checkpointed(size.select("key", "band", "lefts", F.ceil(F.col("all") / BLOCK).cast("int").alias("rights")))
    block = lambda of: F.pmod(F.xxhash64("sid"), F.col(of)).cast("int")
    left = left.join(size, ["key", "band"]).select("*", F.lit(0).alias("side"), block("lefts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"))
    right = right.join(size, ["key", "band"]).select("*", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), block("rights").alias("j"))
    tiles = left.union(right.select(*left.columns)).withColumn("g", F.xxhash64("key", "band", "i", "j"))
    tiles = tiles.join(to_hubs, "sid", "left") if count else tiles.withColumn("hubs", F.lit(None).cast("array<long>"))
    tiles = tiles.join(sketches.select("sid", "sketch"), "sid").select("g", "side", "sid", "class", "n", "at", "low", "differ", "hubs", "sketch")
    tiles = tiles.repartition(parts, "g").sortWithinPartitions("g")
    more = _verified(tiles.mapInArrow(_compare_blocks(t, count), "a long, b long").distinct(), fetch, t)
    if count:
        more = checkpointed(more.select("a", "b"))  # has two readers
    roots = components(roots.toDF("a", "b").union(more.select("a", "b")))

    sizes = members.where("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("least"), F.min("n").alias("n"), F.count("*").alias("times"))
    least = sizes.select("sid", "least", "times")
    least = least.join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    ids = least.groupBy("root").agg(F.min("least").alias("class_id"))
    named = least.join(ids, "root").select("sid", "root", "class_id", "times")
    if count:
        linked = _counted(links, to_hubs, more, sizes.select("sid", "n", "times"), t)
        named = named.join(linked, "sid", "left").withColumn("n_links", F.col("times") - 1 + F.coalesce("linked", F.lit(0))).drop("linked")
        members = members.join(named.drop("times"), "sid", "left").fillna(0, ["n_links"])
        return members.withColumn("class_id", F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("class_id")))
    named = named.drop("times")
    return members.join(named, "sid", "left").withColumn("class_id", F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("class_id")))


def classes(docs: DataFrame, words: int = 3, num: int = 9, den: int = 10, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``id``, ``n_shingles`` (size of its set), ``class_id`` (least id that links reach) and ``n_links`` (other documents that it links with, copies included)."""
    return _placed(docs, words, Threshold(num, den), id_column, text, count=True).select("id", F.col("n").alias("n_shingles"), "class_id", "n_links")


def _with_set_id(n: int, text: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid = [_set_id(u) if len(u) else None for u in sets_of(b.column(text), n)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sid, pa.int64())], [*b.schema.names, name])

    return run


def one_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, of the class's id; documents without words all stay.

    Of rows with one id (or none) that are copies one stays. Such rows are rare in a table with a key; only they are hashed again.
    """
    rows = checkpointed(_placed(docs, words, Threshold(num, den), id_column, text))
    (own_id,) = unused(docs.columns, "id")
    again = checkpointed(rows.groupBy("id").agg(F.count("*").alias("times")).where("times > 1 OR id IS NULL").select(F.col("id").alias(own_id)))
    of_class = rows.where(F.col("id").eqNullSafe(F.col("class_id")))
    single = of_class.where("id IS NOT NULL").join(again, F.col("id") == F.col(own_id), "left_anti").select(F.col("id").alias(own_id))
    number = F.col(id_column).cast("long")
    out = docs.join(single, number == F.col(own_id), "left_semi")
    if not again.take(1):
        return out
    names = [f"c{k}" for k in range(len(docs.columns))]
    d = docs.toDF(*names)
    number = F.col(names[docs.columns.index(id_column)]).cast("long")
    place = docs.columns.index(text)
    repeated = d.join(again.toDF("own"), number.eqNullSafe(F.col("own")), "left_semi")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields), "sid long"])
    repeated = repeated.mapInArrow(_with_set_id(words, place, "sid"), schema)
    empty = repeated.where("sid IS NULL").drop("sid")
    kept = of_class.where("sid IS NOT NULL").select(F.col("sid").alias("of"), "root", F.col("id").alias("own")).distinct()
    kept = repeated.join(kept, (F.col("sid") == F.col("of")) & number.eqNullSafe(F.col("own")))
    one = kept.groupBy("root").agg(F.min_by(F.struct(*names), F.col("sid")).alias("row")).select("row.*")
    return out.union(empty.union(one).toDF(*docs.columns))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = classes(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_shingles", F.col("class_id").alias("component_id"), "n_links")


SQL: dict[str, str] = {}
QUERIES = {"op6_jaccard_join": op6_jaccard_join}
