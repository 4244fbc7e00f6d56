"""License scans: TF-IDF cosine of notices to templates, then inheritance from directories.

1. A document's notices are its windows of one to five lines that hold a licence cue (headers, also
   wrapped ones), its paragraphs that do, its lines with a cue together and its whole text (a
   licence file). Of documents without a cue only term counts move.
2. Document frequencies are counted over all documents, summed before the shuffle. Notices and templates
   are sparse TF-IDF vectors; term by term they meet in an equi-join with the templates' terms, a
   table that the template list bounds. Weights of frequent terms (in a thousandth of the documents or
   more, so at most a thousand times a document's mean number of terms) are broadcast. All other terms weigh
   more than a known least weight, which gives each cosine an upper bound; only notices that
   may reach the threshold get their rare terms' weights by a join on the term. The best
   cosine of a document is its own licence if it reaches the threshold.
3. A document that opens or closes with a notice (its first or last line has a cue, or its best
   notice stands there) is a licence file and grants to its directory. Directories' ancestors meet
   granting directories in a path join; the nearest wins.

Directories are joined as distinct paths, so one that holds a third of all documents is a
single row until the last join, which only carries ids and which adaptive execution can split.

Defined results: a null text has no notice; a null path inherits nothing; documents of equal id and
text share their result, also when the id is null; ties go to the licence name that sorts first
and, between grants of one directory, to the path that sorts first; an empty table gives an
empty table. All input columns stay; those named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed, table, unused

#: (licence, notice); short public notices, headers and whole licence texts, fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions "
        "of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
        "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should "
        "have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright: CC0 1.0 Universal."),
)
CUE = r"(?i)licen[sc]e|copyright|permission is hereby|redistribut|waived"
#: The same where a line break may stand inside.
_WRAPPED = CUE.replace(" ", r"\s+(?:[#*/;-]+\s+)?")
#: Lines of the largest window; a longer run of comment lines is a notice of its own.
WINDOW = 5
_COMMENT = r"^[ \t]*(#|//|/?\*|--|;|%)"
THRESHOLD = 0.6
#: A term is frequent if one in so many documents has it.
FREQUENT = 1000
_SPLIT = r"[^a-z0-9.-]+"


def _terms(c: Column) -> Column:
    """Lower-case runs of letters, digits, dots and hyphens, without dots at their ends."""
    return F.filter(F.transform(F.split(ascii_lower(c), _SPLIT), lambda x: F.regexp_replace(x, r"^[.-]+|[.-]+$", "")), lambda x: x != "")


def _counts(c: Column) -> Column:
    """The distinct terms of a text with their numbers, as structs ``term, tf``: runs of its sorted terms, so nothing is shuffled to count them."""
    once = lambda x, f: F.flatten(F.transform(F.array(x), f))  # noqa: E731  # a lambda's argument is evaluated once, an expression at each use

    def runs(terms: Column) -> Column:
        places = F.when(F.size(terms) > 0, F.sequence(F.lit(1), F.size(terms))).otherwise(F.array().cast("array<int>"))
        return once(F.filter(places, lambda i: (i == F.size(terms)) | (F.get(terms, i) != F.get(terms, i - 1))), lambda ends: counted(terms, ends))

    def counted(terms: Column, ends: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), F.size(ends))
        return F.zip_with(ends, before, lambda e, b: F.struct(F.get(terms, e - 1).alias("term"), (e - b).cast("long").alias("tf")))

    return once(F.array_sort(_terms(c)), runs)


def _trimmed(text: str) -> Column:
    return F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n"))


def _units(text: str) -> Column:
    """The notices of a text, each with its number of lines and whether it opens or closes the text."""
    whole = _trimmed(text)
    lines, paragraphs = F.split(whole, "\n"), F.split(whole, r"\n[ \t\r]*\n")
    unit = lambda line, n, edge: F.struct(line.alias("line"), n.cast("int").alias("n"), edge.alias("edge"))
    places = lambda parts: F.sequence(F.lit(1), F.size(parts))
    many = F.lit(2**31 - 1)

    def from_line(i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.size(lines) - i + 1))
        return F.transform(lengths, lambda n: unit(F.array_join(F.slice(lines, i, n), "\n"), n, (i == 1) | (i + n - 1 == F.size(lines))))

    windows = F.flatten(F.transform(places(lines), from_line))
    blocks = F.transform(places(paragraphs), lambda i: unit(F.element_at(paragraphs, i), many, (i == 1) | (i == F.size(paragraphs))))
    # runs of comment lines stand between marks, of which there is one for each other line
    runs = F.split(F.array_join(F.transform(lines, lambda x: F.when(x.rlike(_COMMENT), x).otherwise(F.lit("\x01"))), "\n"), "\x01")
    comments = F.transform(places(runs), lambda i: unit(F.btrim(F.element_at(runs, i), F.lit("\n")), many, (i == 1) | (i == F.size(runs))))
    comments = F.filter(comments, lambda u: F.size(F.split(u["line"], "\n")) > WINDOW)
    cues = F.array_join(F.filter(lines, lambda x: x.rlike(CUE)), "\n")
    rest = F.array(unit(cues, many, F.lit(False)), unit(whole, many, F.lit(False)))
    return F.concat(F.filter(F.concat(windows, blocks, comments), lambda u: u["line"].rlike(_WRAPPED)), rest)


def _document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """``(term, df)`` over all documents."""
    tokens = F.array_distinct(F.split(ascii_lower(F.col(text)), _SPLIT))  # most repeats go before the dots are looked at
    terms = F.array_distinct(F.transform(tokens, lambda x: F.regexp_replace(x, r"^[.-]+|[.-]+$", "")))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def _vectors(templates: Sequence[tuple[str, str]], df: DataFrame, idf: Callable[[Column], Column]) -> DataFrame:
    """``(term, idf, t, license, tw)``: a term's weight in each template, as a share of the template's norm; a term of no document has the largest weight."""
    t = df.sparkSession.createDataFrame([(i, name, notice) for i, (name, notice) in enumerate(templates)], "t int, license string, notice string")
    t = t.select("t", "license", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("t", "license", "term").agg(F.count("*").alias("tf"))
    t = t.join(df, "term", "left").withColumn("idf", idf(F.coalesce("df", F.lit(0)))).withColumn("tw", F.col("tf") * F.col("idf"))
    norm = t.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    return t.join(F.broadcast(norm), "t").select("term", "idf", "t", "license", (F.col("tw") / F.col("tn")).alias("tw"))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text", key: str = "__key") -> DataFrame:
    """``(key, own_license, own_score, own_edge)`` for the documents whose best notice reaches the threshold; ``own_edge``: it opens or closes the text."""
    many = docs.count()
    df = checkpointed(_document_frequencies(docs, text))
    idf = lambda c: F.log((1.0 + many) / (1.0 + c)) + 1.0
    least = math.log((1.0 + many) / (1.0 + many / FREQUENT)) + 1.0  # all terms that are not frequent weigh more
    vectors = checkpointed(_vectors(templates, df, idf))
    # what is known of a term: its weight, and its part in each template
    known = df.where(F.col("df") * FREQUENT >= many).select("term", idf(F.col("df")).alias("idf")).union(vectors.select("term", "idf")).distinct()
    known = known.join(vectors.groupBy("term").agg(F.collect_list(F.struct("t", "license", "tw")).alias("parts")), "term", "left")
    square = F.col("tf") * F.col("tf")

    def counts(d: DataFrame) -> DataFrame:
        """``(key, unit, term, tf)`` of the notices; a unit's number holds its place, its lines (7: not a window) and whether it stands at an edge."""
        u = d.select(key, F.posexplode(_units(text)).alias("at", "u"))
        number = F.col("at").cast("long") * 16 + F.least(F.col("u.n"), F.lit(7)) * 2 + F.when(F.col("u.edge"), 1).otherwise(0)
        return u.select(key, number.alias("unit"), F.explode(_counts(F.col("u.line"))).alias("c")).select(key, "unit", "c.term", "c.tf")

    units = counts(docs.where(F.col(text).rlike(_WRAPPED))).join(F.broadcast(known), "term", "left").groupBy(key, "unit").agg(
        F.coalesce(F.sum(square * F.col("idf") * F.col("idf")), F.lit(0.0)).alias("norm"),
        F.coalesce(F.sum(F.when(F.col("idf").isNull(), square)), F.lit(0)).alias("rare"),
        F.collect_list(F.when(F.col("parts").isNotNull(), F.struct((F.col("tf") * F.col("idf")).alias("w"), "parts"))).alias("met"),
    )
    met = units.select(key, "unit", "norm", "rare", F.explode("met").alias("m")).select(key, "unit", "norm", "rare", "m.w", F.explode("m.parts").alias("p"))
    dot = met.groupBy(key, "unit", F.col("p.license").alias("license"), F.col("p.t").alias("t"))
    dot = dot.agg(F.sum(F.col("w") * F.col("p.tw")).alias("dot"), F.first("norm").alias("norm"), F.first("rare").alias("rare"))
    bound = F.col("dot") / F.sqrt(F.col("norm") + F.col("rare") * least * least)
    may = checkpointed(dot.where(bound >= threshold - 1e-6))
    open_ = may.where("rare > 0").select(key, "unit").distinct()
    rest = counts(docs.join(open_.select(key).distinct(), key, "left_semi")).join(open_, [key, "unit"], "left_semi")
    rest = rest.join(F.broadcast(known.select("term")), "term", "left_anti").join(df, "term")
    rest = rest.groupBy(key, "unit").agg(F.sum(square * idf(F.col("df")) * idf(F.col("df"))).alias("more"))
    score = F.round(F.col("dot") / F.sqrt(F.col("norm") + F.coalesce("more", F.lit(0.0))), 6)
    found = may.join(rest, [key, "unit"], "left").select(key, "license", "unit", score.alias("score")).where(F.col("score") >= threshold)
    lines, inside = F.expr("shiftright(unit, 1) & 7"), F.expr("unit & 1") == 0
    best = found.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "license", lines.alias("n"), inside.alias("inside"))).alias("b"))
    return best.select(key, F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score"), (~F.col("b.inside")).alias("own_edge"))


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text", path: str = "path") -> DataFrame:
    """All input columns, ``own_license``, ``own_score``, ``license`` and ``granted_by`` (the directory that a licence is inherited from)."""
    made = ("own_license", "own_score", "license", "granted_by")
    key, dir_, granting, given = unused(docs.columns, "key", "dir", "granting", "given")
    d = docs.drop(*made).withColumn(key, F.xxhash64(F.col(id_column).cast("string"), F.col(text)))
    found = checkpointed(scan(d, templates, threshold, text, key))  # has two readers
    own = found.drop("own_edge")
    ends = F.split(_trimmed(text), "\n")
    ends_on_cue = F.element_at(ends, 1).rlike(CUE) | F.element_at(ends, -1).rlike(CUE)
    files = d.select(key, F.col(path).alias("__path"), ends_on_cue.alias("__ends")).join(found, key).where("__path IS NOT NULL AND (__ends OR own_edge)")
    grants = files.groupBy(directory_of(F.col("__path")).alias(granting)).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "__path", "own_license")).alias("g"))
    grants = grants.select(granting, F.col("g.own_license").alias(given))
    dirs = d.where(F.col(path).isNotNull()).select(directory_of(F.col(path)).alias(dir_)).distinct()
    parts = F.split(dir_, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    near = dirs.select(dir_, F.explode(above).alias(granting)).join(grants, granting)
    near = near.groupBy(dir_).agg(F.max(F.struct(F.length(granting).alias("n"), granting, given)).alias("g")).select(dir_, F.col("g").getField(granting).alias(granting), F.col("g").getField(given).alias(given))
    out = d.withColumn(dir_, directory_of(F.col(path))).join(own, key, "left").join(near, dir_, "left")
    return out.withColumns({"license": F.coalesce("own_license", given), "granted_by": F.when(F.col("own_license").isNull(), F.col(granting))}).drop(key, dir_, granting, given)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in a tree of source, language and thousand; those under 300 characters stand at their source's top."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    deep = F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), name)
    path = F.when(F.length("text") < 300, F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("none")), name)).otherwise(deep)
    return inherit(d.withColumn("path", path)).select("doc_id", "path", "own_license", "own_score", "license", "granted_by")


def _sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{notice.replace(chr(39), chr(39) * 2)}')" for i, (name, notice) in enumerate(TEMPLATES))
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = f"list_filter(list_transform(string_split_regex({low}, '{_SPLIT}'), lambda x: regexp_replace(x, '^[.-]+|[.-]+$', '', 'g')), lambda x: x <> '')"
    deep = "'/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || floor(doc_id / 1000)::BIGINT || '/' || doc_id || '.txt'"
    space = "' ' || chr(9) || chr(10) || chr(13)"
    return rf"""
WITH t0(t, license, notice) AS (VALUES {rows}),
t1 AS (SELECT t, license, term, count(*) AS tf FROM (SELECT t, license, unnest({terms.format("notice")}) AS term FROM t0) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS k, doc_id, text, CASE WHEN length(text) < 300 THEN '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' ELSE {deep} END AS path FROM documents),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({terms.format("text")})) AS term FROM d) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
tw AS (SELECT t, license, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY t)) AS tn
       FROM (SELECT t1.*, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1.0 AS idf FROM t1 LEFT JOIN df USING (term), n)),
l AS (SELECT k, w, string_split(w, chr(10)) AS lines, string_split_regex(w, '\n[ \t\r]*\n') AS parts FROM (SELECT k, trim(text, {space}) AS w FROM d WHERE regexp_matches(text, '{_WRAPPED}'))),
wi AS (SELECT k, array_to_string(lines[i:i + m - 1], chr(10)) AS line, m, i = 1 OR i + m - 1 = len(lines) AS edge
       FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l), range(1, {WINDOW} + 1) x(m) WHERE i + m - 1 <= len(lines)),
pa AS (SELECT k, parts[i] AS line, 7 AS m, i = 1 OR i = len(parts) AS edge FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM l)),
ru AS (SELECT k, string_split(array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '{_COMMENT}') THEN x ELSE chr(1) END), chr(10)), chr(1)) AS runs FROM l),
cm AS (SELECT k, trim(runs[i], chr(10)) AS line, 7 AS m, i = 1 OR i = len(runs) AS edge FROM (SELECT *, unnest(range(1, len(runs) + 1)) AS i FROM ru)
       WHERE len(string_split(trim(runs[i], chr(10)), chr(10))) > {WINDOW}),
u AS (SELECT * FROM (SELECT * FROM wi UNION ALL SELECT * FROM pa UNION ALL SELECT * FROM cm) WHERE regexp_matches(line, '{_WRAPPED}')
      UNION ALL SELECT k, array_to_string(list_filter(lines, lambda x: regexp_matches(x, '{CUE}')), chr(10)), 7, false FROM l UNION ALL SELECT k, w, 7, false FROM l),
un AS (SELECT row_number() OVER () AS unit, * FROM u),
c AS (SELECT unit, term, count(*) AS tf FROM (SELECT unit, unnest({terms.format("line")}) AS term FROM un) GROUP BY ALL),
uw AS (SELECT unit, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w FROM c JOIN df USING (term), n),
nm AS (SELECT unit, sqrt(sum(w * w)) AS un FROM uw GROUP BY unit),
dt AS (SELECT unit, t, license, sum(uw.w * tw.w) / max(tn) AS dot FROM uw JOIN tw USING (term) GROUP BY ALL),
sc AS (SELECT k, license, m, edge, round(dot / un, 6) AS score FROM dt JOIN nm USING (unit) JOIN un USING (unit)),
own AS (SELECT k, license AS own_license, score AS own_score, edge FROM sc WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, license, m, edge DESC) = 1),
dd AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, string_split(trim(text, {space}), chr(10)) AS ends FROM d),
f AS (SELECT dir, own_license, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, path) AS r FROM dd JOIN own USING (k)
      WHERE edge OR regexp_matches(ends[1], '{CUE}') OR regexp_matches(ends[-1], '{CUE}')),
nr AS (SELECT a.dir, f.dir AS granting, f.own_license AS given FROM (SELECT DISTINCT dir FROM dd) a JOIN f ON f.r = 1 AND (a.dir = f.dir OR starts_with(a.dir, f.dir || '/'))
       QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(f.dir) DESC) = 1)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, given) AS license, CASE WHEN own_license IS NULL THEN granting END AS granted_by
FROM dd LEFT JOIN own USING (k) LEFT JOIN nr USING (dir)"""


SQL = {"op5_license_scans": _sql()}
QUERIES = {"op5_license_scans": op5_license_scans}
