from collections import Counter, defaultdict

import numpy as np
import pytest

from manylabel.llm import jaccard_join as j
from manylabel.llm.shingles import sets_of

from .helpers import SCHEMA, documents, texts, words


def brute(rows, n, num, den):
    own = []
    for i, t in rows:
        w = words(t)
        own.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(own):
        for o, c in Counter(o for x in s for o in where[x]).items():
            if den * c >= num * (len(s) + len(own[o]) - c):
                a, b = sorted((find(k), find(o)))
                root[b] = a
                links.update((k, o))
        for x in s:
            where[x].append(k)
    least = {}
    for k in range(len(rows)):
        ids = [rows[o][0] for o in range(len(rows)) if find(o) == find(k) and rows[o][0] is not None]
        least[k] = min(ids, default=None)
    return Counter((rows[k][0], len(own[k]), least[k], links[k]) for k in range(len(rows)))


@pytest.mark.parametrize("n, num, den", [(3, 9, 10), (5, 4, 5)])
def test_equals_brute_force(spark, sf, n, num, den):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    got = Counter(tuple(r) for r in j.classes(d.repartition(3), n, num, den).collect())
    assert got == brute(rows, n, num, den)


def test_odd_texts_and_edited_copies(spark):
    """Chains of edits: neighbours link, ends do not; the hub of a list need not link with all of it."""
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in rng.integers(0, 10**6, 300)]
    rows = texts()
    for c in range(60):
        w = list(base)
        for p in rng.integers(0, 300, rng.integers(0, 14)):
            w[p] = f"e{rng.integers(0, 40)}"
        rows.append((1000 + c, " ".join(w)))
    chain = [f"c{i}" for i in range(220)]
    for c in range(12):
        chain = chain[4:] + [f"d{c}-{k}" for k in range(4)]
        rows.append((2000 + c, " ".join(chain)))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id")
    got = Counter(tuple(r) for r in j.classes(d, id_column="id").collect())
    assert got == brute(rows, 3, 9, 10)


def test_words_that_collide_modulo_powers_of_two(spark):
    """Thue and Morse's word and its complement have nothing in common."""
    one = "a"
    while len(one) < 4096:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, " ".join(f"{k}{one}" for k in "cdefg")), (4, " ".join(f"{k}{two}" for k in "cdefg")), (5, one.upper())]
    got = {tuple(r) for r in j.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1, 1), (2, 1, 2, 0), (3, 3, 3, 0), (4, 3, 4, 0), (5, 1, 1, 1)}


def test_hash_of_a_word_is_the_same_anywhere():
    import pyarrow as pa

    long = "x" * 50 + "yz" * (5 << 20)  # alone it is beyond the bound of unreduced sums
    texts = [f"{pad} same words here" for pad in ("", "q" * 777, "ä " * 3000, long)]
    sets = [set(u.tolist()) for u in sets_of(pa.array(texts), 3)]
    assert len(set.intersection(*sets)) == 1


def test_index_meets_every_link():
    """Sets at and around the threshold always share a list."""
    rng = np.random.default_rng(5)
    for t in (j.Threshold(9, 10), j.Threshold(4, 5)):
        for size in (5, 10, 11, 19, 20, 50, 300):
            for _ in range(60):
                x = rng.integers(0, 2**63, size, dtype=np.uint64)
                differ = int(t.most_differing(2 * size))
                gone = rng.integers(0, differ + 1)
                y = np.concatenate([x[gone:], rng.integers(0, 2**63, rng.integers(0, differ + 1), dtype=np.uint64)])
                x, y = np.unique(x), np.unique(y)
                both = len(np.intersect1d(x, y))
                if len(y) and t.den * both >= t.num * (len(x) + len(y) - both) and not np.array_equal(x, y):
                    assert np.intersect1d(j._list_keys(x, t), j._list_keys(y, t)).size


def test_links_share_a_list_with_an_early_entry():
    """Under any order of shingles, also one with many ties, a link's first common list has an early entry."""
    rng = np.random.default_rng(7)
    ranks = (None, rng.integers(0, 16000, 1 << j.COUNT_BITS).astype(np.uint64), rng.integers(0, 2, 1 << j.COUNT_BITS).astype(np.uint64))
    links = 0
    for t in (j.Threshold(9, 10), j.Threshold(4, 5)):
        for size in (4, 5, 9, 10, 19, 40, 200):
            for rank in ranks * 30:
                x = rng.integers(0, 2**64, size, dtype=np.uint64)
                differ = int(t.most_differing(2 * size))
                y = np.concatenate([x[rng.integers(0, differ + 1) :], rng.integers(0, 2**64, rng.integers(0, differ + 1), dtype=np.uint64)])
                x, y = np.unique(x), np.unique(y)
                both = len(np.intersect1d(x, y))
                if t.den * both >= t.num * (len(x) + len(y) - both) and not np.array_equal(x, y):
                    links += 1
                    early = [dict(zip(k.tolist(), (~j._late(np.int64(len(u)), np.arange(len(k)), t)).tolist())) for u in (x, y) for k in [j._list_keys(u, t, rank)]]
                    assert any(early[0][k] or early[1][k] for k in early[0].keys() & early[1].keys())
    assert links > 200


def test_hot_lists(spark, monkeypatch):
    """Groups that fill several blocks of a list, with members that the hub does not account for, between small buffers."""
    monkeypatch.setattr(j, "BLOCK", 4)
    monkeypatch.setattr(j, "BUFFER_ROWS", 50)
    monkeypatch.setattr(j, "MAX_BROADCAST_IDS", 3)
    rng = np.random.default_rng(11)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(120)]
        for c in range(50):
            w = list(base[: 120 - int(rng.integers(0, 40))])
            for p in rng.integers(0, len(w), rng.integers(0, 4)):
                w[p] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in j.classes(d, 5, 4, 5).collect()) == brute(rows, 5, 4, 5)


def test_counts_without_rows_for_pairs():
    """Tiles count what sets have in common, also over several blocks of elements."""
    rng = np.random.default_rng(2)
    xs, ys = ([np.unique(rng.integers(0, 20_000, rng.integers(0, 9000))).astype(np.uint64) for _ in range(5)] for _ in range(2))
    assert j._common(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert j._common(xs, [np.empty(0, np.uint64)]).tolist() == [[0]] * 5


def test_null_ids_link_others(spark):
    """Two texts that link through a third one only, whatever the third's id."""
    w = [f"w{i}" for i in range(200)]
    a, b, c = " ".join(w), " ".join(["x"] * 5 + w[5:]), " ".join(["x"] * 5 + w[5:-6])
    for rows in ([(1, a), (2, c), (None, b)], [(None, a), (None, c), (None, b), (3, "else"), (1, "else")]):
        d = spark.createDataFrame(rows, "doc_id long, text string")
        assert Counter(tuple(r) for r in j.classes(d, 3, 95, 100).collect()) == brute(rows, 3, 95, 100)


def test_one_of_each_and_empty(spark):
    kept = {r["doc_id"] for r in j.one_of_each(documents(spark)).collect()}
    assert {1, 2, 6, 9, 12, None} <= kept and not {7, 8, 10} & kept
    assert j.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert j.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_with_repeated_ids(spark):
    long, other = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(None, long, 1), (None, long, 2), (None, other, 3), (None, None, 4), (None, "", 5), (4, long + " end", 6), (4, other + " end", 7), (4, other + " end", 8), (5, "", 9), (6, other, 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, root long")
    assert sorted(r["root"] for r in j.one_of_each(d).collect() if r["root"] not in (7, 8)) == [4, 5, 6, 9]
    assert sum(r["root"] in (7, 8) for r in j.one_of_each(d).collect()) == 1
    nulls = spark.createDataFrame([r for r in rows if r[0] is None], "doc_id long, text string, root long")
    assert Counter(r["text"] for r in j.one_of_each(nulls).collect()) == Counter([long, other, None, ""])


def test_chunks_do_not_change_sets():
    import pyarrow as pa

    from manylabel.llm import shingles

    t = pa.array([(x or "").encode() for _, x in texts()])
    whole = [a.tolist() for a in sets_of(t, 3)]
    old, shingles.CHUNK_BYTES = shingles.CHUNK_BYTES, 64
    try:
        assert [a.tolist() for a in sets_of(t, 3)] == whole
        assert [a.tolist() for a in sets_of(t.slice(3, 9), 3)] == whole[3:12]
    finally:
        shingles.CHUNK_BYTES = old
