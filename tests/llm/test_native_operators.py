"""URL filters, WARC derivatives, license scans and mixing: SQL on real tables, and odd rows by hand."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from manylabel.llm import components, license_scans, poisson_mixing, url_filters, warc_derivatives

from ..compare import check
from .helpers import SCHEMA, documents, texts


def test_equal_sql(spark, sf):
    for m in (url_filters, warc_derivatives, license_scans, poisson_mixing):
        for name, sql in m.SQL.items():
            check(spark, sf, m.QUERIES[name], sql)


def test_components_are_least_reachable(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (200, 200), (None, 5), (7, 3), (7, 3)] + [(500, 600 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 300: 100, **{600 + i: 500 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_verdicts(spark):
    rows = [
        (1, "http://a.net/x", "k"), (2, None, None), (3, "no scheme", ""), (4, "https://WWW.Example.NET/en/1?q#f", None), (5, "https://example.net/en", None),
        (6, "https://other.org/1", '<link rel="canonical" href="http://a.net/x">'), (7, "https://b.org/fr/2", "<link rel=canonical href='http://a.net/x'>"),
        (8, "https://c.org/3", '<meta http-equiv="refresh" content="0; url=https://other.org/1">'), (9, "ftp://d.org", None), (1, "http://a.net/x", "k"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash")).withColumn("path", F.lit("clash"))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages).collect())
    assert got == Counter(
        [
            (1, "a.net", "/x", "net/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.net", "/en/1", "example.net/en/", "allow"),
            (5, "example.net", "/en", "net/", "block"), (6, "other.org", "/1", None, "block"), (7, "b.org", "/fr/2", "org/fr/", "allow"), (8, "c.org", "/3", None, "block"),
            (9, "d.org", "", None, "allow"), (1, "a.net", "/x", "net/", "block"),
        ]
    )
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_warc_records(spark):
    html = "<html><title> A\n B </title><script>x</script><p>One &amp; two<br>three</p><a href=\"/l\">link</a></html>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (1, "http://a/", html), (3, "http://b/é", "é\r\n\r\nmore")], "page_id long, url string, html string")
    r = warc_derivatives.responses(pages)
    d = warc_derivatives.derive(r.withColumn("block_digest", F.lit("clash")))
    rows = d.collect()
    assert len(rows) == 8 and len({x["record_id"] for x in rows}) == 6
    text = {x["page_id"]: x["block"] for x in rows if x["record_type"] == "conversion"}
    assert text[1] == "A\nB\nOne & two\nthree\nlink" and text[2] == "" and text[3] == "é\n\nmore".replace("\n\n", "\n")
    meta = next(x["block"] for x in rows if x["record_type"] == "metadata" and x["page_id"] == 1)
    assert "outlink: /l\r\n" in meta and "title:  A B \r\n" in meta and "header: Content-Type: text/html; charset=utf-8\r\n" in meta
    source = {x["page_id"]: x["record_id"] for x in r.collect()}
    assert all(x["refers_to"] == source[x["page_id"]] for x in rows)
    fields = ["record_id", "record_type", "target_uri", "date", "refers_to", "content_type", "block"]
    back = warc_derivatives.from_warc(warc_derivatives.to_warc(r.select(*fields).union(d.select(*fields))).select("record"))
    key = lambda x: tuple(str(x[f]) for f in fields)
    assert sorted(map(key, back.collect())) == sorted(map(key, r.select(*fields).union(d.select(*fields)).collect()))
    assert warc_derivatives.derive(r.limit(0)).count() == 0


def test_a_long_header_before_code_is_one_notice(spark):
    """A header of twelve comment lines and code right below: the licence is that of the header alone."""
    text = next(t for n, t in license_scans.TEMPLATES if n == "GPL-3.0" and len(t) > 300).split()
    step = len(text) // 12 + 1
    for mark in ("#", "//", " *"):
        head = "\n".join(f"{mark} {' '.join(text[k : k + step])}" for k in range(0, len(text), step))
        code = "import os\nfor x in os.listdir():\n    print(x)"
        rows = [(1, head, "/a/x"), (2, f"{head}\n{code}", "/b/x"), (3, f"{code}\n{head}\n{code}", "/c/x")]
        got = {r["doc_id"]: (r["own_license"], r["own_score"]) for r in license_scans.inherit(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
        assert all(name == "GPL-3.0" and score > 0.85 for name, score in got.values()), got


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0"
    rows = [
        (1, mit, "/a/LICENSE"), (2, "code", "/a/b/c.txt"), (3, f"x\n{apache}\ny", "/a/b/d.txt"), (4, f"{apache}\ncode", "/a/b/e/f.txt"), (5, "more", "/a/b/e/g.txt"),
        (6, None, "/a/z/h.txt"), (7, "code", "/q/r.txt"), (8, "text", None), (None, mit, None), (9, "a licence of no known kind", "/a/i.txt"), (1, mit, "/a/LICENSE"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, path string").withColumn("license", F.lit("clash"))
    got = Counter((r["doc_id"], r["own_license"], r["license"], r["granted_by"]) for r in license_scans.inherit(d).collect())
    a = "Apache-2.0"
    assert got == Counter(
        [
            (1, "MIT", "MIT", None), (2, None, "MIT", "/a"), (3, a, a, None), (4, a, a, None), (5, None, a, "/a/b/e"), (6, None, "MIT", "/a"),
            (7, None, None, None), (8, None, None, None), (None, "MIT", "MIT", None), (9, None, "MIT", "/a"), (1, "MIT", "MIT", None),
        ]
    )
    assert license_scans.inherit(d.limit(0)).count() == 0


def test_wrapped_and_wordy_notices_count(spark):
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    mit = "# Permission is\n# hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files to deal"
    rows = [
        (1, mpl, "/m/a.txt"), (2, "code", "/m/b/c.txt"), (3, "This file and all of its parts are released under the MIT License.", "/w/a.txt"),
        (4, "code", "/w/c.txt"), (5, f"x = 1\n{mpl}\ny = 2", "/n/a.txt"), (6, "code", "/n/c.txt"), (7, mit, "/p/a.txt"),
    ]
    common = "this and all of its parts are in the file that we read under the lamp with a copy at one if not was terms form you can"
    rows += [(100 + i, f"{common} {i}", f"/z/{i}") for i in range(200)]
    got = {r["doc_id"]: (r["own_license"], r["license"]) for r in license_scans.inherit(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert [got[i] for i in range(1, 8)] == [("MPL-2.0",) * 2, (None, "MPL-2.0"), ("MIT",) * 2, (None, "MIT"), ("MPL-2.0",) * 2, (None, None), ("MIT",) * 2]
    assert all(got[100 + i] == (None, None) for i in range(200))


def test_rare_terms_are_joined_only_where_they_decide(spark, sf, monkeypatch):
    """With few frequent terms most weights come from the join; results do not change."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").withColumn("path", F.lit("/x/y"))
    d = d.withColumn("given", F.lit(1)).withColumn("granting", F.lit(2)).withColumn("unit", F.lit(3)).withColumn("term", F.lit(4))
    whole = " ".join(t for n, t in license_scans.TEMPLATES if n == "ISC")
    d = d.union(d.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit(f"Copyright 2020 Nobody\n\n{whole}")))
    out = []
    for frequent in (1000, 3):
        monkeypatch.setattr(license_scans, "FREQUENT", frequent)
        out.append(Counter((r["doc_id"], r["own_license"], r["own_score"], r["license"], r["given"], r["granting"]) for r in license_scans.inherit(d).collect()))
    assert out[0] == out[1] and next(x for x in out[0] if x[0] == -1)[1] == "ISC"


def test_warc_records_without_length(spark):
    d = spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\n\r\nbody é",), ("no blank line",), ("",), (None,), ("WARC/1.1\r\nContent-Length: 99999999999\r\n\r\nlong",)], "record string")
    assert [r["block"] for r in warc_derivatives.from_warc(d).collect()] == ["body é", "", "", None, "long"]


def test_mixing_checks_targets_and_keeps_columns(spark):
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(7).alias("cdf"), F.lit(8).alias("draws"), F.lit(9).alias("n"))
    rows = poisson_mixing.mix(d, {}, epochs=2.0).collect()
    assert rows and all((r["cdf"], r["draws"], r["n"]) == (7, 8, 9) for r in rows)
    for bad in ({"a": 0.7, "b": 0.6}, {"a": -0.1}):
        with pytest.raises(ValueError):
            poisson_mixing.mix(d, bad)


def test_mixing_meets_its_targets(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "big").when(F.col("id") < 4050, "rare").otherwise("mid").alias("source"))
    targets = {"big": 0.2, "rare": 0.5}
    got = {r["source"]: r["count"] for r in poisson_mixing.mix(d, targets).groupBy("source").count().collect()}
    for source, weight in {**targets, "mid": 0.3}.items():
        assert abs(got[source] - weight * 6000) < 6 * math.sqrt(weight * 6000)
    many = poisson_mixing.mix(d.where("source = 'rare'"), {"rare": 1.0}, epochs=100.0)  # rates above one draw
    n = [r["count"] for r in many.groupBy("doc_id").count().collect()]
    assert abs(sum(n) - 5000) < 6 * math.sqrt(5000) and 100 < sum((x - 100) ** 2 for x in n) / 50 * 2 < 400


def test_mixing_odd_rows(spark, monkeypatch):
    d = documents(spark).withColumnRenamed("n_chars", "copy")
    rows = poisson_mixing.mix(d, {}, epochs=3.0).collect()
    assert {r["source"] for r in rows} == {"src0", "src1", "src2", None}
    ids = {i for i, _ in texts()}
    assert {r["doc_id"] for r in rows} <= ids and len(rows) > len(texts())
    monkeypatch.setattr(poisson_mixing, "MAX_BROADCAST_SOURCES", 1)  # the way beyond the broadcast
    assert Counter(r["shuffle_key"] for r in poisson_mixing.mix(d, {}, epochs=3.0).collect()) == Counter(r["shuffle_key"] for r in rows)
    assert poisson_mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
