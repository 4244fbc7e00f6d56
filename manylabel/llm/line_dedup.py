"""Line dedup with two Bloom filters: once seen and twice seen.

1. Each task sets a line's bits in its once-seen filter, and in its twice-seen filter if the
   once-seen filter had them all. The tasks' filters meet bit by bit: a bit is twice seen if
   any task says so or if two tasks have it once. No line that two documents hold is missed.
2. The merged twice-seen filter goes to all tasks. Its size is a parameter with a fixed bound
   (``filter_bits``), whatever the corpus: a fuller filter lets more unique lines through, it
   never changes a result.
3. Only suspected lines are shuffled, with their document's id, and counted exactly by their key.
4. Lines of confirmed keys go, except in the largest document id that holds the key. Documents
   that lose nothing stay where they were read; the texts of the others meet their keys in a join on the id. Who loses is told by the broadcast
   ids, and beyond a million by a bitmap of their hashes of at most 32 MB, which sends a few texts too many through the join.

A line that a third of all documents hold is first made distinct by (key, document), which
spreads it over all tasks, and then counted from partial sums. The filters of all tasks are merged
block by block, one after the other, so that a task holds one block whatever the number of tasks.
Dropping takes time in proportion to a text's lines and its dropped keys.

Defined results: a null or empty text is one empty line; each row with a null ``doc_id`` is a document of
its own that never is the largest, and a key that only such rows hold stays; repeated rows of one ``doc_id`` count once; ties cannot
occur as one id is the largest; an empty table gives an empty table. All columns of the
input are kept; a column named like one of the results is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, flagged, table, unused

MIN_CHARS, MIN_DOCS = 20, 3
#: 2**26 bits are 8 MB; both filters of a task are twice that.
FILTER_BITS, PROBES, BLOCK_BYTES = 1 << 26, 3, 1 << 16
#: Ids of documents that lose lines are broadcast up to this many; beyond, a bitmap of them is.
MAX_BROADCAST_IDS = 1_000_000

_STRIP = b" \t\n\x0b\x0c\r"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _long(key: bytes, min_chars: int) -> bool:
    """Whether UTF-8 bytes hold that many code points."""
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def keys_of(text: bytes | None, min_chars: int = MIN_CHARS) -> list[bytes]:
    """The distinct keys of a text's UTF-8 bytes that are long enough, in order of first occurrence."""
    if not text:
        return []
    keys = dict.fromkeys([x.strip(_STRIP) for x in text.translate(_FOLD).split(b"\n") if len(x) >= min_chars])
    return [k for k in keys if _long(k, min_chars)]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _bits(h: np.ndarray, n_bits: int) -> np.ndarray:
    """The filter positions of each hash, one row for each."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(n_bits)).astype(np.int64)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def _put(bits: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def _seen(n_bits: int, min_chars: int):
    """Texts to the blocks of one task's two filters; empty blocks stay out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(n_bits // 8, np.uint8), np.zeros(n_bits // 8, np.uint8)
        for batch in batches:
            pending: list[str] = []
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for k, text in enumerate(texts):
                pending += keys_of(text, min_chars)
                if len(pending) >= 50_000 or k == len(texts) - 1 and pending:
                    h, n = np.unique(_hashes(pending), return_counts=True)
                    _put(twice, _bits(h[n > 1], n_bits))
                    first = _bits(h, n_bits)
                    _put(twice, first[_has(once, first)])
                    _put(once, first)
                    pending = []
        rows = [(i // BLOCK_BYTES, once[i : i + BLOCK_BYTES].tobytes(), twice[i : i + BLOCK_BYTES].tobytes()) for i in range(0, len(once), BLOCK_BYTES) if once[i : i + BLOCK_BYTES].any()]
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int32()), pa.array([r[1]], pa.binary()), pa.array([r[2]], pa.binary())], ["block", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block to one for each with its bits that are seen twice; one block is held at a time."""

    def out(block: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["block", "twice"])

    block, once, twice = None, None, None
    for batch in batches:
        for number, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if number != block:
                if block is not None:
                    yield out(block, twice)
                block, once, twice = number, a, b
            else:
                twice = twice | b | (once & a)
                once = once | a
    if block is not None:
        yield out(block, twice)


def twice_seen(docs: DataFrame, text: str = "text", n_bits: int = FILTER_BITS, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The merged twice-seen filter, ``n_bits / 8`` bytes."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select(text).mapInArrow(_seen(n_bits, min_chars), "block int, once binary, twice binary")
    out = np.zeros(n_bits // 8, np.uint8)
    for row in blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_merge, "block int, twice binary").collect():  # at most n_bits / 8 bytes
        at = row["block"] * BLOCK_BYTES
        out[at : at + len(row["twice"])] = np.frombuffer(row["twice"], np.uint8)
    return out


def repeated_keys(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_bits: int = FILTER_BITS) -> DataFrame:
    """``(id, key, holder)``: each document's keys that at least ``min_docs`` documents hold, with the largest id that holds them."""
    found = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, text, n_bits, min_chars))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, first = found.value, 1 + (TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), [keys_of(t, min_chars) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            flat = [k for own in keys for k in own]
            if not flat:
                first += len(ids)
                continue
            hit = _has(bits, _bits(_hashes(flat), n_bits))
            owner = np.repeat(np.arange(len(ids)), [len(k) for k in keys])[hit]
            rows = [0 if ids[i] is not None else first + int(i) for i in owner]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in owner], pa.int64()), pa.array(rows, pa.int64()), pa.array([flat[i] for i in np.flatnonzero(hit)], pa.binary()).cast(pa.string())], ["id", "row", "key"])
            first += len(ids)

    suspected = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(suspects, "id long, row long, key string")
    suspected = suspected.distinct()  # both uses below read this one shuffle; rows without id differ by their number
    holders = suspected.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("holder")).where(F.col("n") >= min_docs)
    return suspected.join(holders.select("key", "holder"), "key").select("id", "key", "holder")


def _drop(min_chars: int, place: int, names: list[str]):
    """Rows with their text and, last, their dropped keys to rows with the text that is left, its lines before and the lines dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, dropped = b.column(place).cast(pa.binary()).to_pylist(), [], []
            drops = b.column(b.num_columns - 1)
            for k, gone in enumerate(drops.cast(pa.list_(pa.binary())).to_pylist()):
                every = (texts[k] or b"").split(b"\n")
                gone = set(gone or ())
                kept = [x for x in every if len(x) < min_chars or x.strip(_STRIP).translate(_FOLD) not in gone] if gone else every
                texts[k] = b"\n".join(kept)
                lines.append(len(every))
                dropped.append(len(every) - len(kept))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == place else c for k, c in enumerate(b.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names)

    return run


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_bits: int = FILTER_BITS) -> DataFrame:
    """All input columns with ``text`` less its repeated lines, ``n_lines`` and ``n_dropped``."""
    drops = repeated_keys(docs, id_column, text, min_chars, min_docs, n_bits)
    d = docs.drop("n_lines", "n_dropped")
    id_, drop, loses = unused(d.columns, "id", "drop", "loses")
    drops = drops.where(~F.col("id").eqNullSafe(F.col("holder"))).groupBy(F.col("id").alias(id_)).agg(F.collect_set("key").alias(drop))
    drops = checkpointed(drops)
    d = d.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == text else F.col(c) for c in d.columns])
    same, many = d[id_column].cast("long").eqNullSafe(F.col(id_)), drops.count()
    if many <= MAX_BROADCAST_IDS:
        ids = F.broadcast(drops.select(id_))
        whole, parted = d.join(ids, same, "left_anti"), d.join(ids, same, "left_semi").join(drops, same)
    else:
        told = flagged(d, d[id_column], drops.select(id_), many, loses)
        whole, parted = told.where(~F.col(loses)).drop(loses), told.where(loses).drop(loses).join(drops, F.col(id_column).cast("long").eqNullSafe(F.col(id_)), "left")
    names = [*d.columns, "n_lines", "n_dropped"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields), "n_lines long", "n_dropped long"])
    parted = parted.select(*d.columns, drop).mapInArrow(_drop(min_chars, d.columns.index(text), names), ddl)
    n_lines = (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")
    return whole.select("*", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).union(parted)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, k, p, lines[p] AS line,
             translate(regexp_replace(lines[p], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, k, lines, unnest(range(1, len(lines) + 1)) AS p
                 FROM (SELECT doc_id, row_number() OVER () AS k, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
h AS (SELECT key, max(doc_id) AS holder FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT k) FILTER (doc_id IS NULL) >= 3)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (holder <> doc_id)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN h USING (key) GROUP BY k"""
}
QUERIES = {"op4_line_dedup": op4_line_dedup}
