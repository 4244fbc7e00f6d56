"""BPE encoding and decoding through a table of distinct words.

1. :func:`_split` cuts each text into the tokenizer's words, inside the task that reads it. A block
   of documents becomes one row with the block's documents as positions in the block's list
   of distinct words, and one row for each word bucket with the distinct words that hash there.
2. The word rows are shuffled by bucket. The task that gets a bucket holds every word of
   the corpus that hashes there, and encodes each distinct word once.
3. The ids go back to their blocks by block number, and each document's ids are read off by position.
4. Decoding looks every id up in the id-to-piece table, again once for each distinct word of a block.

What moves is each block's distinct words and 1 to 4 bytes for each word of a text, instead of one
row for each word. A word that a third of all texts consist of costs one entry for each block.
Blocks are bounded by rows and characters, buckets grow in number with the shuffle partitions.

The vocabulary file is a parameter and is read by name on each executor; its table of pieces
is as large as the vocabulary (49,408 entries) whatever the corpus.

Defined results: a null text counts as empty; no words give no ids and an empty decoded
text; a null ``id`` stays null; repeated rows each get their result; an empty table gives an
empty table; columns of other names are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A block ends at either bound.
BLOCK_ROWS, BLOCK_CHARS = 10_000, 32_000_000
#: Documents of one Arrow batch of results, and characters of their texts.
OUT_ROWS, OUT_CHARS = 500, 4_000_000

_DOCS, _WORDS = -1, 0
_ROW = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
_ROW_DDL = "route long, block long, kind int, payload binary"
_OUT_DDL = "id long, n_tokens long, ids array<int>, decoded string"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[str]:
    """The id-to-piece table."""
    tok = _tokenizer(path)
    vocab = tok.get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


@lru_cache(maxsize=2)
def _splitter(path: str):
    """The function from a text to the tokenizer's words, from the rules in its file."""
    spec = json.load(open(path, encoding="utf-8"))
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    steps = spec["pre_tokenizer"]["pretokenizers"]
    if kinds != ["NFC", "Replace", "Lowercase"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"]:
        raise ValueError("this vocabulary splits words in a way that is not supported")
    find = regex.compile(steps[0]["pattern"]["Regex"]).findall
    added = [t["content"] for t in spec["added_tokens"]]
    special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def lower(s: str) -> str:
        # letter by letter where the whole-string rule differs (a final sigma)
        return "".join(map(str.lower, s)) if "Σ" in s else s.lower()

    def plain(s: str) -> list[str]:
        return find(lower(s if s.isascii() else unicodedata.normalize("NFC", s)))

    def words(s: str) -> list[str]:
        if special is None or not special.search(s):
            return plain(s)
        out: list[str] = []
        for k, part in enumerate(special.split(s)):
            out += [part] if k % 2 else plain(part)
        return out

    return words


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    raw = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(raw))


def _unpack(payload: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (n + 1), []
    for size in np.frombuffer(raw, np.int64, n, 8):
        out.append(raw[at : at + size])
        at += size
    return out


def _planes(numbers: np.ndarray, largest: int) -> list[np.ndarray]:
    """Each byte of the numbers by itself, as many as the largest needs."""
    return [(numbers >> shift & 255).astype(np.uint8) for shift in range(0, largest.bit_length(), 8)]


def _pack_words(words: list[str]) -> bytes:
    """UTF-8 bytes and their lengths: a word may hold any character, so none can separate them."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    return _pack(b"".join(raw), *_planes(lengths, int(lengths.max(initial=0))))


def _unpack_words(payload: bytes) -> list[str]:
    blob, *planes = _unpack(payload)
    ends = np.cumsum(sum(np.frombuffer(x, np.uint8).astype(np.int64) << 8 * k for k, x in enumerate(planes))).tolist() if planes else []
    return [blob[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]


def _split(path: str, buckets: int):
    """Documents to rows: one for the documents of each block, one for each bucket of its distinct words."""

    def block_rows(number: int, ids: list, lengths: list[int], positions: list[np.ndarray], seen: dict[str, int]):
        words, flat = list(seen), np.concatenate([*positions, np.empty(0, np.uint32)])
        # frequent words get small numbers, and each byte of the numbers is packed by itself
        by_use = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[by_use] = np.arange(len(words))
        words, flat = [words[i] for i in by_use], rank[flat]
        planes = _planes(flat, len(words))
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int32, len(words))
        order = np.argsort(bucket, kind="stable")
        null = np.array([i is None for i in ids], np.uint8)
        key = np.array([0 if i is None else i for i in ids], np.int64)
        rows = [(number, number, _DOCS, _pack(key, null, np.array(lengths, np.int64), bucket, *planes))]
        at = 0
        for b, n in zip(*np.unique(bucket, return_counts=True)):
            rows.append((int(b), number, int(b), _pack_words([words[i] for i in order[at : at + n]])))
            at += n
        for r in rows:  # one row for a batch: a block's documents may be large
            yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r))], schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = _splitter(path), count(TaskContext.get().partitionId() << 32)
        ids, lengths, positions, chars = [], [], [], 0
        seen: defaultdict[str, int] = defaultdict(count().__next__)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text) if text else []
                ids.append(i)
                lengths.append(len(found))
                positions.append(np.fromiter(map(seen.__getitem__, found), np.uint32, len(found)))
                chars += len(text or "")
                if len(ids) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield from block_rows(next(numbers), ids, lengths, positions, seen)
                    ids, lengths, positions, chars = [], [], [], 0
                    seen = defaultdict(count().__next__)
        if ids:
            yield from block_rows(next(numbers), ids, lengths, positions, seen)

    return run


def _encode_words(path: str):
    """Rows of words become rows of ids; a word is encoded when its bucket's task first meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, known = _tokenizer(path), {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] != _DOCS:
                    words = _unpack_words(row["payload"])
                    new = [w for w in words if w not in known]
                    for at in range(0, len(new), 10_000):
                        part = new[at : at + 10_000]
                        for w, e in zip(part, tok.encode_batch(part, add_special_tokens=False)):
                            known[w] = np.array(e.ids, np.uint32).tobytes()
                    found = [known[w] for w in words]
                    row["payload"] = _pack(np.fromiter(map(len, found), np.uint32, len(found)) // 4, b"".join(found))
                row["route"] = row["block"]
                yield pa.RecordBatch.from_pylist([row], schema=_ROW)

    return run


def _join_back(path: str):
    """The rows of a block, documents last, to one row for each document."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def documents(payload: bytes, lens: np.ndarray, flat: np.ndarray):
        pieces = _pieces(path)
        ends = np.cumsum(lens)
        starts = ends - lens
        every = list(map(pieces.__getitem__, flat.tolist()))  # id to piece
        text = [" ".join(every[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        key, null, lengths, bucket, *planes = _unpack(payload)
        key, null, lengths = np.frombuffer(key, np.int64), np.frombuffer(null, np.uint8), np.frombuffer(lengths, np.int64)
        order = np.argsort(np.frombuffer(bucket, np.int32), kind="stable")
        place = np.empty(len(order), np.int32)  # a word's position when the buckets' words stand in a row
        place[order] = np.arange(len(order))
        rank = sum((np.frombuffer(x, np.uint8).astype(np.int32) << 8 * k for k, x in enumerate(planes)), np.zeros(int(lengths.sum()), np.int32))
        positions = place[rank]
        first = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        while at < len(key):
            to, chars = at, 0
            while to < len(key) and to - at < OUT_ROWS and chars < OUT_CHARS:
                chars += 6 * int(lengths[to])
                to += 1
            own = positions[first[at] : first[to]]
            n = lens[own]
            # the ids of each word in turn: start of the word in flat, plus 0, 1, ...
            run_end = np.cumsum(n)
            ids = flat[np.repeat(starts[own] - (run_end - n), n) + np.arange(run_end[-1] if len(n) else 0)].astype(np.int32)
            edges = np.concatenate([[0], run_end])[first[at : to + 1] - first[at]]
            decoded = []
            for d in range(at, to):
                decoded.append(" ".join([text[p] for p in positions[first[d] : first[d + 1]].tolist()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at:to], mask=null[at:to].astype(bool)), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids)), pa.array(decoded, pa.string())],
                schema=schema,
            )
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lens, flat = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, lens, flat = row["block"], [], []
                if row["kind"] != _DOCS:
                    a, b = _unpack(row["payload"])
                    lens.append(np.frombuffer(a, np.uint32).astype(np.int64))
                    flat.append(np.frombuffer(b, np.uint32))
                else:
                    yield from documents(row["payload"], np.concatenate([*lens, np.empty(0, np.int64)]), np.concatenate([*flat, np.empty(0, np.uint32)]))

    return run


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``id``, ``n_tokens``, ``ids`` and ``decoded`` (the pieces joined as the vocabulary's library does)."""
    path = vocabulary or default_vocabulary()
    buckets = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_split(path, buckets), _ROW_DDL)
    coded = rows.repartition(buckets, "route").mapInArrow(_encode_words(path), _ROW_DDL)
    # a block's words stand before its documents, in the order of the buckets
    last = F.when(F.col("kind") == _DOCS, F.lit(2**31 - 1)).otherwise(F.col("kind"))
    return coded.repartition(buckets, "route").sortWithinPartitions("block", last).mapInArrow(_join_back(path), _OUT_DDL)


def decode(coded: DataFrame, vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` to rows of ids by a join with the id-to-piece table, whose size the vocabulary bounds.

    Ids outside the vocabulary give no piece; a null or empty list gives an empty text.
    """
    spark, path = coded.sparkSession, vocabulary or default_vocabulary()
    pieces = spark.createDataFrame(list(enumerate(_pieces(path))), "__id int, __piece string")
    d = coded.drop("decoded").withColumn("__row", F.monotonically_increasing_id())
    long = d.select("__row", F.posexplode(ids).alias("__at", "__id")).join(F.broadcast(pieces), "__id")
    text = long.groupBy("__row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__piece"))), lambda x: x["__piece"]), " ").alias("decoded"))
    return d.join(text, "__row", "left").withColumn("decoded", F.coalesce("decoded", F.lit(""))).drop("__row")


def op9_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = encode_decode(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op9_bpe_words": op9_bpe_words}
SQL: dict[str, str] = {}
