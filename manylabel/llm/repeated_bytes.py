"""Removal of long repeated byte strings over a prefix-free parsing of the corpus.

*Blocks.* Documents are packed into compressed blocks of some 8 MB, written once, so that a block
is the same bytes whatever task reads it again. A longer document is a block of its own.

*Parse.* Rolling-hash triggers cut every document into phrases: the trigger of a string that
starts at s is the least hash of 12 bytes among its first 64, so it depends on the string's own
bytes, every string of 100 bytes has one, and equal strings have it at one offset. A phrase is the
bytes from its first start to its trigger, and the parse goes on with the bytes from the trigger.

*Shared triggers.* Each block sends, for each trigger, 48 bits of the hash of the 37 bytes that
all strings of a trigger have behind it, sorted and packed by hash range. What comes back are the
triggers that occur twice; the others, most of a corpus, cannot begin a repeat.

*Dictionary and parse order.* Phrases of shared triggers go, with what follows them, to the place of
their trigger, once for each block and distinct bytes. There the dictionary's suffixes are
sorted (read back from the trigger) and so are the parse's suffixes (read on from it), both with
their common prefix lengths. A start d bytes before its trigger is equal to another one if they
stand together in the dictionary's order for d bytes and in the parse's order for 100 - d: the two orders
combine into the corpus order of all starts of the trigger. Of equal starts the first one stays.
All comparisons are of bytes; a hash only says what meets where.

*Hot triggers.* Later places of a phrase in its own block never leave it. A trigger that still has
more than ``MANY`` phrases is dealt string by string, and of each string a task sends its least place only.
So no task gathers a passage's documents: a place gets one row for each block (or, if crowded, each task)
that holds the string.

Defined results: the place of a string is (id, start), so rows of one id do not repeat each other at one
start, and do so at different ones; a null or empty text has no bytes; texts under the length lose
nothing; a null id stays null and counts as an id made from the text's hash; ties of hash go
to the left; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count as counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .shingles import mix

_U = np.uint64
LENGTH = 100
#: Bytes of a rolling hash, and starts that one trigger can serve.
GRAM, SPAN = 12, 64
#: A block ends at either bound; hashing goes in windows.
BLOCK_BYTES, BLOCK_ROWS, WINDOW_BYTES = 8 << 20, 20_000, 1 << 20
#: Phrases of one trigger that are compared in one place.
MANY = 1 << 15
#: Phrases that a task sorts at once, and crowded strings that it holds.
GROUP_ROWS, CROWDED_ROWS = 50_000, 500_000
_KEY_BITS = 48

#: The rolling hash is a polynomial modulo 2**64: it only brings candidates together, bytes decide.
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(n, _U)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = _U(_BASE), _U(pow(_BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_BLOCK_DDL = "block long, ids array<long>, uids array<long>, sizes array<long>, payload binary"
_PACKED = pa.schema([("to", pa.int64()), ("of", pa.int64()), ("payload", pa.binary())])
_PACKED_DDL = "to long, of long, payload binary"
_PIECE = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("row", pa.int32()), ("uid", pa.int64()), ("start", pa.int64()), ("lead", pa.int32()), ("count", pa.int32()), ("content", pa.binary())])
_PIECE_DDL = "route long, block long, row int, uid long, start long, lead int, count int, content binary"
_RUN = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("count", pa.int32())])
_RUN_DDL = "block long, row int, start long, count int"
_LEFT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_LEFT_DDL = "id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks; the number of a block is its task's and its own."""
    numbers = counter(TaskContext.get().partitionId() << 32)

    def block(ids: list, uids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        payload = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, uids, [len(t) for t in texts])]
        return pa.RecordBatch.from_arrays([pa.array([next(numbers)]), *lists, pa.array([payload], pa.binary())], ["block", "ids", "uids", "sizes", "payload"])

    ids, uids, texts, held = [], [], [], 0
    for batch in batches:
        for i, u, text in zip(*(batch.column(k) for k in range(3))):
            text = text.as_py()
            if texts and held + len(text) > BLOCK_BYTES:
                yield block(ids, uids, texts)
                ids, uids, texts, held = [], [], [], 0
            ids.append(i.as_py())
            uids.append(u.as_py())
            texts.append(text)
            held += len(text)
            if len(texts) >= BLOCK_ROWS:
                yield block(ids, uids, texts)
                ids, uids, texts, held = [], [], [], 0
    if texts:
        yield block(ids, uids, texts)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Block by block: number, ids, uids, offsets of the documents, their bytes, and further columns."""
    for batch in batches:
        for k in range(batch.num_rows):
            number, ids, uids, sizes, payload, *more = (c[k] for c in batch.columns)
            edges = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int64)
            data = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload.as_py()), np.uint8)
            yield number.as_py(), ids.values, uids.values.to_numpy(), edges, data, *more


def _windows(edges: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """First row, start in it, and place and offsets of stretches of a block; those of a long document overlap by what a string needs."""
    row, rows = 0, len(edges) - 1
    while row < rows:
        if edges[row + 1] - edges[row] > WINDOW_BYTES:
            for a in range(0, int(edges[row + 1] - edges[row]) - length + 1, WINDOW_BYTES - length + 1):
                at = int(edges[row]) + a
                yield row, a, at, np.array([0, min(WINDOW_BYTES, int(edges[row + 1]) - at)])
            row += 1
        else:
            to = max(row + 1, int(np.searchsorted(edges, edges[row] + WINDOW_BYTES, side="right")) - 1)
            yield row, 0, int(edges[row]), edges[row : to + 1] - edges[row]
            row = to


class _Hashed:
    """Bytes with the hash of any stretch of them."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(1 << max(len(data), 1 << 20).bit_length())
        self.run = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=self.run[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.run[stop] - self.run[start]) * self.down[start])


def _phrases(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each phrase of a block: row, first start, starts, bytes from it to the trigger, hash behind the trigger, hash of the phrase with what follows."""
    out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)] + [[np.empty(0, _U)] for _ in range(2)]
    for row, first, at, offsets in _windows(edges, length):
        n = np.diff(offsets)
        long = n >= length
        if not long.any():
            continue
        part = data[at : at + offsets[-1]]
        h = _Hashed(part)
        place = np.arange(len(part) - GRAM + 1)
        best = h.of(place, place + GRAM) >> _U(32) << _U(32) | place.astype(_U)
        step = 1
        while step < SPAN:
            best = np.minimum(best[:-step], best[step:])
            step *= 2
        usable = np.zeros(len(part) + 1, np.int64)
        np.add.at(usable, offsets[:-1][long], 1)
        np.add.at(usable, offsets[1:][long] - length + 1, -1)
        start = np.flatnonzero(np.cumsum(usable)[:-1])
        trigger = (best[start] & _U(0xFFFFFFFF)).astype(np.int64)
        doc = np.searchsorted(offsets, start, side="right") - 1
        new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])]))
        lo, count = start[new], np.diff(np.append(new, len(start)))
        trigger, doc = trigger[new], doc[new]
        lead = trigger - lo
        entry = mix(h.of(lo, lo + count - 1 + length) + lead.astype(_U) * _U(0xA24BAED4963EE407) + count.astype(_U))
        for column, x in zip(out, (row + doc, first + lo - offsets[doc], count, lead, h.of(trigger, trigger + length + 1 - SPAN), entry)):
            column.append(x)
    return tuple(np.concatenate(x) for x in out)


def _pack(keys: np.ndarray, marks: np.ndarray) -> bytes:
    """Sorted numbers as the bytes of their differences, each byte place by itself, with 16-bit marks."""
    step = np.diff(keys, prepend=_U(0))
    planes = [(step >> _U(s) & _U(255)).astype(np.uint8).tobytes() for s in range(0, _KEY_BITS, 8)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*planes, marks.astype(np.uint16).tobytes()]))


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    n, planes = len(raw) // (_KEY_BITS // 8 + 2), _KEY_BITS // 8
    step = sum((raw[k * n : (k + 1) * n].astype(_U) << _U(8 * k) for k in range(planes)), np.zeros(n, _U))
    return np.cumsum(step, dtype=_U), raw[planes * n :].copy().view(np.uint16)


def _packed_rows(to: int, of: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([of], pa.int64()), pa.array([payload], pa.binary())], schema=_PACKED)


def _triggers(length: int, buckets: int):
    """Blocks to their triggers by hash range: 0 for one that the block has once, else its distinct phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, edges, data in _opened(batches):
            *_, key, entry = _phrases(data, edges, length)
            if not len(key):
                continue
            key = key >> _U(64 - _KEY_BITS)
            order = np.lexsort((entry, key))
            key, entry = key[order], entry[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            distinct = np.add.reduceat((new | np.concatenate([[True], entry[1:] != entry[:-1]])).astype(np.int64), first)
            marks = np.where(np.diff(np.append(first, len(key))) > 1, np.minimum(distinct, 65_535), 0)
            key = key[first]
            bound = np.searchsorted(key, np.array([(b << _KEY_BITS) // buckets for b in range(buckets + 1)], _U))
            for b in np.flatnonzero(np.diff(bound)):
                own = slice(bound[b], bound[b + 1])
                yield _packed_rows(int(b), number, _pack(key[own], marks[own]))

    return run


def _shared(many: int):
    """Rows of triggers sorted by hash range to each block's triggers that occur twice; marked 1 if they are crowded."""

    def answer(blocks: list[int], payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, marks = zip(*map(_unpack, payloads))
        owner = np.repeat(np.arange(len(blocks)), [len(k) for k in keys])
        key, mark = np.concatenate(keys), np.concatenate(marks).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, mark, owner = key[order], mark[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        twice = np.repeat((size > 1) | (mark[first] > 0), size)
        crowded = np.repeat(np.add.reduceat(np.maximum(mark, 1), first) > many, size)
        key, crowded, owner = key[twice], crowded[twice], owner[twice]
        order = np.argsort(owner, kind="stable")
        bound = np.searchsorted(owner[order], np.arange(len(blocks) + 1))
        for k, block in enumerate(blocks):
            own = order[bound[k] : bound[k + 1]]
            if len(own):
                yield _packed_rows(block, 0, _pack(key[own], crowded[own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blocks, payloads = None, [], []
        for batch in batches:
            for b, block, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket and blocks:
                    yield from answer(blocks, payloads)
                    blocks, payloads = [], []
                bucket = b
                blocks.append(block)
                payloads.append(payload)
        if blocks:
            yield from answer(blocks, payloads)

    return run


def _pieces(length: int):
    """Blocks with their shared triggers to the phrases of these: with their bytes, or (``count`` 0) as starts known to repeat."""

    def batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _PIECE.types)], schema=_PIECE)

    def known(block: int, rows: list, starts: list, counts: list) -> Iterator[pa.RecordBatch]:
        """Runs already found, which go by block; ``lead`` holds the number of starts."""
        rows, starts, counts = np.array(rows, np.int64), np.array(starts, np.int64), np.array(counts, np.int64)
        order = np.lexsort((starts, rows))
        own = np.full(len(order), block)
        own, rows, starts, counts = _joined(own, rows[order], starts[order], counts[order])
        zero = np.zeros(len(rows), np.int64)
        columns = [mix(own.view(_U) + _U(1)).view(np.int64), own, rows, zero, starts, counts, zero]
        yield pa.RecordBatch.from_arrays([*(pa.array(x).cast(t) for x, t in zip(columns, _PIECE.types)), pa.nulls(len(rows), pa.binary())], schema=_PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[bytes, list] = {}  # crowded strings of the task's blocks with their least places
        again: dict[int, tuple[list, list]] = {}  # later starts of these by block

        def flush() -> Iterator[pa.RecordBatch]:
            if least:
                strings = list(least)
                route = np.fromiter(map(xxhash.xxh3_64_intdigest, strings), _U, len(strings)).view(np.int64)
                for a in range(0, len(strings), GROUP_ROWS):
                    part = slice(a, a + GROUP_ROWS)
                    places = [p for s in strings[part] for p in least[s]]
                    many = [len(least[s]) for s in strings[part]]
                    uid, start, block, row = zip(*places)
                    yield batch([np.repeat(route[part], many), block, row, uid, start, [0] * len(places), [1] * len(places), [s for s, n in zip(strings[part], many) for _ in range(n)]])
            for block, (rows, starts) in again.items():
                yield from known(block, rows, starts, [1] * len(rows))
            least.clear()
            again.clear()

        for number, _, uids, edges, data, shared in _opened(batches):
            if shared.as_py() is None:
                continue
            keys, marks = (np.concatenate(x) for x in zip(*(_unpack(p.as_py()) for p in shared.values)))
            order = np.argsort(keys, kind="stable")
            keys, marks = keys[order], marks[order]
            row, lo, count, lead, key, _ = _phrases(data, edges, length)
            short = key >> _U(64 - _KEY_BITS)
            where = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            wanted = np.flatnonzero(keys[where] == short)
            wanted = wanted[np.lexsort((lo[wanted], uids[row[wanted]]))]  # by place
            crowded = marks[where[wanted]] > 0
            raw = data.tobytes()
            begin = edges[row[wanted]] + lo[wanted]
            seen: dict[tuple[int, bytes], tuple[int, int]] = {}
            out: list[list] = [[] for _ in _PIECE]
            known_runs: tuple[list, list, list] = ([], [], [])
            fields = zip(key.view(np.int64)[wanted].tolist(), row[wanted].tolist(), uids[row[wanted]].tolist(), lo[wanted].tolist(), lead[wanted].tolist(), count[wanted].tolist(), begin.tolist(), crowded.tolist())
            for k, r, u, s, before, n, a, hot in fields:
                content = raw[a : a + n - 1 + length]
                if seen.setdefault((before, content), (u, s)) != (u, s):
                    for column, x in zip(known_runs, (r, s, n)):
                        column.append(x)
                elif hot:
                    for j in range(n):
                        place = (u, s + j, number, r)
                        held = least.setdefault(content[j : j + length], [place])
                        if held[0] is place:
                            continue
                        if place[:2] > held[0][:2]:
                            late = [place]
                        elif place[:2] < held[0][:2]:
                            late, held[:] = held[:], [place]
                        else:  # another row of the same id
                            late = []
                            held.append(place)
                        for _, start, block, own in late:
                            rows, starts = again.setdefault(block, ([], []))
                            rows.append(own)
                            starts.append(start)
                else:
                    for column, x in zip(out, (k, number, r, u, s, before, n, content)):
                        column.append(x)
            if out[0]:
                yield batch(out)
            if known_runs[0]:
                yield from known(number, *known_runs)
            if len(least) + sum(len(rows) for rows, _ in again.values()) >= CROWDED_ROWS:
                yield from flush()
        yield from flush()

    return run


def _joined(block: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring starts joined; the rows are sorted by block, row and start."""
    if not len(row):
        return block, row, start, count
    new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1])]))
    return block[new], row[new], start[new], np.add.reduceat(count, new)


def _suffixes(group: np.ndarray, data: np.ndarray, first: np.ndarray, size: np.ndarray, step: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes of each group, read from ``first`` on (or back), and the bytes that each has in common with the one before it; -1 at a group's start."""
    at = np.arange(width)
    inside = at < size[:, None]
    text = np.zeros((len(first), -(-width // 8) * 8), np.uint8)
    text[:, :width] = np.where(inside, data[np.where(inside, first[:, None] + step * at, 0)], 0)
    words = text.view(">u8")
    order = np.lexsort((*words.T[::-1], group))
    text, group = text[order], group[order]
    differ = text[1:] != text[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate([[-1], np.where(group[1:] == group[:-1], common, -1)])


def _repeats(length: int, route: np.ndarray, block: np.ndarray, row: np.ndarray, uid: np.ndarray, start: np.ndarray, lead: np.ndarray, count: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, ...]:
    """The starts of phrases, of several triggers, that another start with the same string precedes."""
    order = np.lexsort((start + lead, uid))  # by place: all starts at one distance from their triggers are in this order
    route, block, row, uid, start, lead, count = (x[order] for x in (route, block, row, uid, start, lead, count))
    contents = [contents[k] for k in order]
    size = np.array([len(c) for c in contents])
    data = np.frombuffer(b"".join(contents), np.uint8)
    trigger = np.cumsum(size) - size + lead
    dictionary, back = _suffixes(route, data, trigger - 1, lead, -1, SPAN - 1)
    parse, on = _suffixes(route, data, trigger, np.minimum(size - lead, length), 1, length)
    blocks, rows, starts = [], [], []
    phrase, follow = np.empty(len(route), np.int64), np.empty(len(route), np.int64)
    for d in range(int(lead.max()) + 1):
        own = np.flatnonzero((lead >= d) & (lead - count < d))
        if len(own) < 2:
            continue
        phrase[dictionary] = np.cumsum(back < d)
        follow[parse] = np.cumsum(on < length - d)
        _, first, member = np.unique(phrase[own] * (len(route) + 1) + follow[own], return_index=True, return_inverse=True)
        head = own[first[member]]
        late = (uid[own] != uid[head]) | (start[own] + lead[own] != start[head] + lead[head])
        own = own[late]
        blocks.append(block[own])
        rows.append(row[own])
        starts.append(start[own] + lead[own] - d)
    if not blocks:
        none = np.empty(0, np.int64)
        return none, none, none, none
    block, row, start = np.concatenate(blocks), np.concatenate(rows), np.concatenate(starts)
    order = np.lexsort((start, row, block))
    return _joined(block[order], row[order], start[order], np.ones(len(order), np.int64))


def _corpus_order(length: int):
    """Phrases sorted by route to runs of repeated starts; a batch of work ends where a route does."""

    def compared(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        number = [rows.column(k).to_numpy().astype(np.int64) for k in range(7)]
        done = number[6] == 0
        _, member, size = np.unique(number[0], return_inverse=True, return_counts=True)
        met = np.flatnonzero(~done & (size[member] > 1))
        found = [number[1][done], number[2][done], number[4][done], number[5][done]]
        if len(met):
            contents = rows.column(7).take(pa.array(met)).to_pylist()
            found = [np.concatenate(x) for x in zip(found, _repeats(length, *(x[met] for x in number), contents))]
        yield pa.RecordBatch.from_arrays([pa.array(x).cast(t) for x, t in zip(found, _RUN.types)], schema=_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for b in batches:
            route = b.column(0).to_numpy()
            edges = np.append(np.flatnonzero(route[1:] != route[:-1]) + 1, b.num_rows)
            at = 0
            while at < b.num_rows:
                if n >= GROUP_ROWS and route[at] != last:
                    yield from compared(held)
                    held, n = [], 0
                to = int(edges[min(np.searchsorted(edges, at + max(1, GROUP_ROWS - n)), len(edges) - 1)])
                held.append(b.slice(at, to - at))
                n, last, at = n + to - at, route[to - 1], to
        if held:
            yield from compared(held)

    return run


def _remove(length: int):
    """Blocks with their repeated starts to what is left of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, _, edges, data, runs in _opened(batches):
            change = np.zeros(len(data) + 1, np.int32)
            if runs.as_py():
                row, start, count = (runs.values.field(k).to_numpy() for k in range(3))
                begin = edges[row] + start
                np.add.at(change, begin, 1)
                np.add.at(change, begin + count - 1 + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            new = gone.copy()
            new[1:] &= ~gone[:-1]
            new[edges[:-1][edges[:-1] < len(data)]] |= gone[edges[:-1][edges[:-1] < len(data)]]
            total = lambda x: np.concatenate([[0], np.cumsum(x)])[edges]
            removed, spans = np.diff(total(gone)), np.diff(total(new))
            ends = edges - total(gone)
            kept = data[~gone].tobytes()
            texts = [kept[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            for at in range(0, len(texts), 1000):
                part = slice(at, at + 1000)
                columns = [ids[part], *(pa.array(x[part], pa.int64()) for x in (np.diff(edges), removed, spans)), pa.array(texts[part], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_LEFT)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` and the remaining bytes as ``kept``."""
    if length < SPAN + GRAM - 1:
        raise ValueError(f"the length must be at least {SPAN + GRAM - 1}")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    number = F.col(id_column).cast("long")
    d = docs.select(number.alias("id"), F.coalesce(number, F.xxhash64(body)).alias("uid"), body.alias("text"))
    blocks = checkpointed(d.mapInArrow(_blocks, _BLOCK_DDL))

    triggers = blocks.mapInArrow(_triggers(length, parts), _PACKED_DDL).repartition(parts, "to").sortWithinPartitions("to")
    shared = triggers.mapInArrow(_shared(MANY), _PACKED_DDL).groupBy(F.col("to").alias("__block")).agg(F.collect_list("payload").alias("shared"))
    by_number = blocks.repartition(parts, "block")  # the joins of both uses read this one shuffle
    pieces = by_number.join(shared, F.col("block") == F.col("__block"), "left").drop("__block").mapInArrow(_pieces(length), _PIECE_DDL)
    found = pieces.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(_corpus_order(length), _RUN_DDL)
    runs = found.groupBy(F.col("block").alias("__block")).agg(F.collect_list(F.struct("row", "start", "count")).alias("runs"))
    return by_number.join(runs, F.col("block") == F.col("__block"), "left").drop("__block").mapInArrow(_remove(length), _LEFT_DDL)


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL: dict[str, str] = {}
QUERIES = {"op10_repeated_bytes": op10_repeated_bytes}
