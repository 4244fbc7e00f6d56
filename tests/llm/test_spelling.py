import random
import re
import zlib
from collections import Counter

import pytest

from manylabel.llm import spelling as s

from .helpers import FOLD, documents, texts, write


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, min_count=3):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += len(w) >= 5
    return {w: n for w, n in c.items() if n >= min_count}


def brute(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return out


def made(seed, n=400, alphabet="abé"):
    """Words over few letters, so that many are near, many share a half, and forms make chains."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice((5, 5, 6, 7, 8)))): rng.choice((3, 3, 5, 7, 16, 40, 100, 300)) for _ in range(n)}
    return words | {"x" * k: 3 for k in (5, 6, 7, 300, 301)} | {"chain": 3, "chains": 6, "chainss": 12, "chainsss": 24, "chainssss": 48, "chainsssss": 96}


def rows(d):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in d.collect()}


@pytest.mark.parametrize("size", [{}, {"shard": 40, "scanned": 25}, {"shard": 3, "scanned": 2}])
def test_equals_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(s, "PAIRS", 50)
    words = made(1)
    d = s.variants(spark.createDataFrame(list(words.items()), "word string, n long"), **size)
    assert rows(d) == brute(words)
    assert d.count() == len(words)


@pytest.mark.parametrize("pairs", [1, 7, 1 << 18])
def test_shard_in_slices(monkeypatch, pairs):
    import pandas as pd

    monkeypatch.setattr(s, "PAIRS", pairs)
    words = made(2, 150)
    patterns = pd.DataFrame([(w, n, t) for w, n in words.items() for t in (0, 1)], columns=["word", "n", "tail"])
    got = {(r.word, r.n_near, r.near, r.near_n) for r in s.near_in_shard(patterns, list(words)).itertuples()}
    near = {w: sorted((-words[x], x) for x in words if one_edit(w, x)) for w in words}
    assert got == {(w, len(x), x[0][1], -x[0][0]) for w, x in near.items() if x}


def test_query_over_documents(spark, tmp_path):
    odd = "Die Häuser Hauser häuser HÄUSER hauser Häusr straße strasse Straße ×÷× naïve naive Naïve naïf"
    more = [(100 + i, odd) for i in range(400)] + [(None, odd), (7, "y" * 50_000)] + [(500, None)]
    given = texts() + more
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in given], "doc_id long, text string, n int, word string")
    got = s.op13_spelling_variants(spark, write(d, tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    words = brute_words(given)
    whole = {w.translate(FOLD) for _, t in given for w in re.findall("[A-Za-zÀ-ÿ]+", t or "")}
    assert words.keys() - whole  # some runs have lost a letter
    assert rows(got) == brute(words)


def test_no_rows(spark, tmp_path):
    assert s.op13_spelling_variants(spark, write(documents(spark).limit(0), tmp_path)).count() == 0


def test_query_over_the_small_table(spark, sf):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    words = brute_words(given)
    by = {}
    for w in words:  # brute force by deletions, as pairs would be too many
        for k in {w[:i] + "?" + w[i + 1 :] for i in range(len(w))} | {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}:
            by.setdefault(k, []).append(w)
    near = {w: set() for w in words}
    for held in by.values():
        for a in held:
            near[a] |= {b for b in held if one_edit(a, b)}
    got = {(r["word"], r["n"], r["n_near"]) for r in s.op13_spelling_variants(spark, sf).collect()}
    assert got == {(w, n, len(near[w])) for w, n in words.items()}
