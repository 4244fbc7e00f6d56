"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the words' halves.

1. Words are counted in Spark: letter runs, folded, exploded and summed.
2. A word is cut in two segments. If one edit turns it into another word, the segment without the edit stands
   unchanged at the same end of the other. Segments are dealt by hash to shards of about ``SHARD`` segments, as many as the
   vocabulary asks for. Every word is scanned by the shards that can hold a segment of it: its
   heads and tails of the lengths that words of its length, or one more or less, have (six at most).
3. A shard builds one automaton of its segments and runs it over its words. A hit counts if the segment stands at
   its end of the word and the lengths differ by one at most. The pairs left are verified as arrays: what
   stands beside the segment must differ by exactly one edit. A pair that both halves find counts for the head.
   Each shard sends one row for each word: how many near words, and the best of them.
4. The best near word is a word's form if it is frequent enough. Roots come from doubling: each round joins
   a word's present root with that one's own, so a chain of n forms takes log n rounds; n is at most log2 of the largest count.

A segment that very many words share would make one shard large: its words are cut in tiles by hash, patterns by
words, each a shard of its own. Nothing is dropped; no pair of words meets twice.

Defined results: a null text has no words; a null id is written as an empty string; repeated rows are counted each; very long
texts and runs are as any other (a run of a million letters is one word); ties go to the word first in code-point order; other columns
are ignored; an empty table gives an empty table. Words given to :func:`near_words` are distinct, of two letters at least, all below U+0100.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, stored, table

#: Segments in a shard, and words that it scans at most for one segment.
SHARD, SCANNED = 20_000, 60_000
MIN_CHARS, MIN_COUNT = 5, 3
#: One of so many runs loses a letter, as a keyed hash of document and run says.
TYPO_EVERY = 97
#: Hot segments up to here are broadcast; beyond, they are joined.
MAX_BROADCAST_SEGMENTS = 50_000
#: Pairs, and bytes of their letters, that are verified at once.
PAIRS, PAIR_BYTES = 1 << 18, 1 << 24


def typos(run: Column, id_column: Column) -> Column:
    """The run, or for one hash in ``TYPO_EVERY`` the run without the letter that the hash names."""
    h = F.crc32(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % TYPO_EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: words of enough letters and occurrences over all documents."""
    runs = F.explode(F.split(ascii_lower(F.col(text)), r"[^A-Za-zÀ-ÿ]+"))
    d = docs.select(F.col(id_column).alias("i"), runs.alias("run")).where(F.length("run") >= min_chars)  # a run loses a letter, but gains none
    d = d.select(typos(F.col("run"), F.col("i")).alias("word")).where(F.length("word") >= min_chars)
    return d.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _segments(length: Column, word: Column, tail: Column) -> Column:
    """The key of the head or tail that a word of ``length`` letters would share with ``word``."""
    head = F.floor(length / 2).cast("int")
    piece = F.when(tail == 0, F.substring(word, F.lit(1), head)).otherwise(F.substring(word, F.length(word) - (length - head) + 1, length - head))
    return F.xxhash64(tail, length, piece)


def _dealt(words: DataFrame, shard: int, scanned: int) -> tuple[DataFrame, DataFrame]:
    """Patterns ``(s, i, j, tail, word, n)`` and scans ``(s, i, j, word)`` of each shard."""
    two = F.explode(F.array(F.lit(0), F.lit(1))).alias("tail")
    patterns = words.select("word", "n", two).withColumn("key", _segments(F.length("word"), F.col("word"), F.col("tail")))
    near = F.explode(F.array(*[F.length("word") + x for x in (-1, 0, 1)])).alias("length")
    scans = words.select("word", near).select("word", "length", two).withColumn("key", _segments(F.col("length"), F.col("word"), F.col("tail"))).select("word", "key")
    counts = patterns.select("key", F.lit(1).alias("p"), F.lit(0).alias("q")).union(scans.select("key", F.lit(0), F.lit(1))).groupBy("key").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    hot = counts.where((F.col("p") > shard) | ((F.col("q") > scanned) & (F.col("p") > 0)))
    hot = checkpointed(hot.select("key", F.ceil(F.col("p") / shard).cast("int").alias("ps"), F.ceil(F.col("q") / scanned).cast("int").alias("qs")))
    if hot.count() <= MAX_BROADCAST_SEGMENTS:
        hot = F.broadcast(hot)
    n = max(1, -(-2 * words.count() // shard))
    cold = F.pmod(F.col("key"), F.lit(n))
    to = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
    own = lambda c, salt: F.pmod(F.xxhash64(F.lit(salt), "word"), F.coalesce(F.col(c), F.lit(1))).cast("int")
    at = F.when(F.col("ps").isNull(), cold).otherwise(F.col("key")).alias("s")
    hot_shard = F.col("ps").isNotNull().alias("hot")
    p = patterns.join(hot, "key", "left").select(at, hot_shard, own("ps", 1).alias("i"), to("qs").alias("j"), "tail", "word", "n")
    q = scans.join(hot, "key", "left").select(at, hot_shard, to("ps").alias("i"), own("qs", 2).alias("j"), F.col("word").alias("word"))  # both sides stem from one table: columns of their own
    return p, q


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one edit; the rows of ``b`` are as long as those of ``a``, or longer by one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    if not n:
        return np.ones(len(a), bool)
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def _hits(words: list[str], groups: dict[tuple[int, int, str], list[int]]) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
    """For each (tail, length of the pattern, length of the word), the hits (word, group): one automaton over all segments, run over every word."""
    automaton, of = ahocorasick.Automaton(), {}
    for g, (tail, length, piece) in enumerate(groups):
        of.setdefault(piece, []).append((tail, length, g))
    for piece, held in of.items():
        automaton.add_word(piece, (len(piece), held))
    out: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    if of:
        automaton.make_automaton()
        for w, word in enumerate(words):
            n = len(word)
            for end, (size, held) in automaton.iter(word):
                head, last = end + 1 == size, end + 1 == n
                if head or last:
                    for tail, length, g in held:
                        if (last if tail else head) and -2 < n - length < 2:
                            out.setdefault((tail, length, n), []).append((w, g))
    return out


def _verified(words: list[str], patterns: list[str], groups: dict[tuple[int, int, str], list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (word, pattern) of the pairs that one edit parts and whose common segment is one of ``groups``."""
    members = list(groups.values())
    for (tail, length, n), hits in _hits(words, groups).items():
        w, g = np.array(hits).T
        mine = sorted(set(g.tolist()))
        flat = np.concatenate([members[x] for x in mine])
        count = np.array([len(members[x]) for x in mine])
        at = np.searchsorted(mine, g)
        first = np.concatenate(([0], np.cumsum(count)))[at]
        count = count[at]
        own, back = np.unique(w, return_inverse=True)
        left, back_flat = np.unique(flat, return_inverse=True)
        letters, others = _matrix([words[x].encode("latin-1") for x in own], n), _matrix([patterns[x].encode("latin-1") for x in left], length)
        head = length // 2
        total, most = np.cumsum(count), max(1, min(PAIRS, PAIR_BYTES // (length + n)))
        start = 0
        while start < len(w):
            # whole hits up to the bound, or a single one cut in slices
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
            span = int(total[stop - 1] - (total[start - 1] if start else 0))
            for low in range(0, span, most):
                k = np.arange(low, min(span, low + most))
                before = np.concatenate(([0], np.cumsum(count[start:stop])))
                h = np.searchsorted(before, k, side="right") - 1
                x, y = back[start + h], back_flat[first[start + h] + (k - before[h])]
                a, b = letters[x], others[y]
                if tail:
                    again = (a[:, :head] == b[:, :head]).all(axis=1) if n >= head else np.zeros(len(a), bool)
                    rest = length - head
                    a, b = a[:, : n - rest], b[:, :head]
                else:
                    again = np.zeros(len(a), bool)
                    a, b = a[:, head:], b[:, head:]
                good = (_one_edit(a, b) if a.shape[1] <= b.shape[1] else _one_edit(b, a)) & ~again
                if good.any():
                    yield own[x[good]], left[y[good]]
            start = stop


def near_in_shard(patterns: pd.DataFrame, words: list[str]) -> pd.DataFrame:
    """``(word, n_near, near, near_n)``: for each word with near patterns, how many there are and the most frequent one."""
    patterns = patterns.sort_values("word")  # by code points
    names, n = patterns["word"].tolist(), patterns["n"].to_numpy()
    groups: dict[tuple[int, int, str], list[int]] = {}
    for p, (word, tail) in enumerate(zip(names, patterns["tail"])):
        head = len(word) // 2
        groups.setdefault((tail, len(word), word[head:] if tail else word[:head]), []).append(p)
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    for w, p in _verified(words, names, groups):
        np.add.at(count, w, 1)
        order = np.lexsort((p, -n[p], w))  # the first of each word is its best here
        w, p = w[order], p[order]
        first = np.concatenate(([True], w[1:] != w[:-1]))
        w, p = w[first], p[first]
        old = best[w]
        wins = (old < 0) | (n[p] > n[old]) | ((n[p] == n[old]) & (p < old))
        best[w[wins]] = p[wins]
    found = np.flatnonzero(count)
    text = lambda x: pd.Series(x, dtype=object)
    return pd.DataFrame({"word": text([words[x] for x in found]), "n_near": count[found], "near": text([names[x] for x in best[found]]), "near_n": n[best[found]]})


def near_words(words: DataFrame, shard: int = SHARD, scanned: int = SCANNED) -> DataFrame:
    """``(word, n_near, near, near_n)`` of words ``(word, n)`` that have near words."""
    p, q = _dealt(words, shard, scanned)
    keys = ["hot", "s", "i", "j"]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return near_in_shard(x, list(dict.fromkeys(y["word"])))  # several segments of a word may be here

    found = p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(run, "word string, n_near long, near string, near_n long")
    d = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    return d.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: forms followed to the last, by doubling."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = checkpointed(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").take(1):
            return now.select("word", "root")
        now = now.drop("moved")


def variants(words: DataFrame, ratio: int = 2, shard: int = SHARD, scanned: int = SCANNED) -> DataFrame:
    """``(word, n, form, root, n_near, form_n)`` of words ``(word, n)``: the form is a word's most frequent near word, if ``ratio`` times as frequent."""
    near = near_words(words, shard, scanned)
    won = F.col("near_n") >= ratio * F.col("n")
    d = words.join(near, "word", "left").select("word", "n", F.when(won, F.col("near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(won, F.col("near_n")).alias("form_n"))
    d = stored(d)
    r = roots(d.where("form IS NOT NULL"))
    return d.join(r, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stored(count_words(table(spark, sf_dir, "documents")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The corpus is split, hashed by crc32 and joined with its own one-letter neighbours: tests hold it against brute force.
SQL: dict[str, str] = {}
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
