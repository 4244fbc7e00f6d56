"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is an expression over the text, and every rule is a row ``(measure, low,
high)``; :func:`apply_rules` turns the table into columns, so that a change of rules is a
change of data. There is no user function, no shuffle and no state: one narrow pass.

Defined results: a null text counts as empty and has no words, no lines with words and
fails the base rule; a null ``doc_id`` stays null; repeated rows are judged one by one;
an empty table gives an empty table. Columns of the input are kept, and a column whose
name the operator also produces is replaced. Ratios over no words or no lines are 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, table, unused

#: Common short words of the four languages; a running text in any of them has several.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "was", "by", "at", "it", "be", "or", "an", "are", "from", "this",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "pour", "dans", "en", "au", "aux", "par", "sur", "pas", "ne",
    "der", "die", "das", "und", "den", "dem", "ein", "eine", "ist", "von", "mit", "zu", "im", "auf", "nicht", "als", "auch", "es", "für", "sich",
    "el", "los", "las", "del", "y", "una", "con", "por", "se", "no", "su", "lo", "para", "como", "más", "al", "o", "a",
)


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The production table. Bounds are wide: each is meant for text that no reader would call prose.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("same_lines", "dup_line_ratio", None, 0.5),
    Rule("letters", "letter_word_ratio", 0.6, None),
    Rule("ellipsis", "ellipsis_line_ratio", None, 0.5),
)
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 50, 50

_POSITION = 31  # bits for a word's position beside 32 bits of hash


def _neighbours_agree(items: Column, part) -> Column:
    """The items whose ``part`` equals that of the item before or after; items are sorted by it."""
    return F.filter(
        items,
        lambda x, j: F.coalesce(part(x) == part(F.get(items, j - 1)), F.lit(False)) | F.coalesce(part(x) == part(F.get(items, j + 1)), F.lit(False)),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ratios that rules can name.

    The words inside a repeated 3-word window are found without grouping rows: windows are
    sorted by a 32-bit hash with their position in the low bits, neighbours with one hash
    are suspects, and only suspects are compared word for word.
    """
    words, lines, packed, suspects, n_lines, ellipsis, letter_words, nearest = unused(docs.columns, "words", "lines", "packed", "suspects", "n_lines", "ellipsis", "letter_words", "near")
    body = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c not in MEASURES]
    d = docs.select(
        *keep,
        F.filter(F.split(body, SPACE), lambda w: w != "").alias(words),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        F.length(F.regexp_replace(body, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    w = F.col(words)
    last = F.size(w) - 3
    d = d.select(
        *[c for c in d.columns],
        F.size(w).cast("long").alias("n_words"),
        F.size(lines).cast("long").alias(n_lines),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).alias(ellipsis),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias(letter_words),
        F.size(F.filter(w, lambda x: ascii_lower(x).isin(*STOP_WORDS))).cast("long").alias("stop_words"),
        F.when(
            last >= 1,
            F.sort_array(F.transform(F.slice(w, 1, F.greatest(last + 1, F.lit(0))), lambda x, i: F.shiftleft(F.hash(x, F.get(w, i + 1), F.get(w, i + 2)).cast("long"), _POSITION).bitwiseOR(i.cast("long")))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias(packed),
    ).drop(lines)
    hashed = F.col(packed)
    near = F.transform(_neighbours_agree(hashed, lambda x: F.shiftright(x, _POSITION)), lambda x: x.bitwiseAND((1 << _POSITION) - 1).cast("int"))
    d = d.withColumn(nearest, near)
    d = d.withColumn(suspects, F.sort_array(F.transform(nearest, lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("g"), p.alias("p")))))
    windows = F.transform(_neighbours_agree(F.col(suspects), lambda x: x["g"]), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))
    n, held = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col(n_lines), F.lit(1))
    return d.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.size(F.array_distinct(F.flatten(windows))).cast("long").alias("n_repeat_words"),
        "stop_words",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("stop_words") / n).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / held).alias("dup_line_ratio"),
        (F.col(letter_words) / n).alias("letter_word_ratio"),
        (F.col(ellipsis) / held).alias("ellipsis_line_ratio"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stop_words", "mean_word_chars", "symbols_per_word", "stop_word_ratio", "dup_line_ratio", "letter_word_ratio", "ellipsis_line_ratio")


def passes(rule: Rule) -> Column:
    value = F.col(rule.measure)
    bounds = [value >= F.lit(rule.low)] * (rule.low is not None) + [value <= F.lit(rule.high)] * (rule.high is not None)
    out = F.lit(True)
    for b in bounds:
        out = out & b
    return out


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """All input columns, the measures, ``base_failed``, ``failed_rules`` (names, in the table's order) and ``kept``."""
    own = {"base_failed", "failed_rules", "kept"}
    d = measure(docs.select(*[c for c in docs.columns if c not in own]), text)
    base = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]).cast("array<string>"), lambda x: x.isNotNull())
    # the partition's number is never negative, but it is no deterministic value: a filter on the
    # verdict then stays above this projection, where the optimizer would else copy the measures into it
    d = d.withColumns({"base_failed": base & (F.spark_partition_id() >= 0), "failed_rules": failed})
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def _sql() -> str:
    def quote(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    measures = {
        "mean_word_chars": "word_chars / n", "symbols_per_word": "n_symbols / n", "stop_word_ratio": "stop_words / n", "dup_line_ratio": "n_dup_lines / nl",
        "letter_word_ratio": "letter_words / n", "ellipsis_line_ratio": "ellipsis / nl", "n_words": "n_words",
    }
    fails = []
    for r in RULES:
        m = measures[r.measure]
        bad = [f"{m} < {r.low}"] * (r.low is not None) + [f"{m} > {r.high}"] * (r.high is not None)
        fails.append(f"CASE WHEN {' OR '.join(bad)} THEN {quote(r.name)} END")
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT k, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
g2 AS (SELECT k, p, count(*) OVER (PARTITION BY k, words[p], words[p + 1], words[p + 2]) AS c FROM g),
r AS (SELECT k, count(DISTINCT q) AS n_repeat_words FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM g2 WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({', '.join(map(quote, STOP_WORDS))}))) AS stop_words,
        len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS letter_words,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipsis,
        greatest(len(words), 1)::DOUBLE AS n, greatest(len(lines), 1)::DOUBLE AS nl FROM w LEFT JOIN r USING (k)),
v AS (SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEAT_PERCENT} * n_words AS base_failed,
        concat_ws(',', {', '.join(fails)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v"""


SQL = {"op7_quality_rules": _sql()}
QUERIES = {"op7_quality_rules": op7_quality_rules}
