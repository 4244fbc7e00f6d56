"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

1. Thirteen statistics of a document's whole text, each a Spark expression, transformed to be nearly normal (logarithms
   of counts, square roots of shares). A share's denominator gets ``PRIOR`` more units, so that a text of
   three words has no extreme share. Texts are read once; only the statistics are stored.
2. One aggregate gives each class's count, sums and products of pairs of statistics: rows of a fixed
   number of doubles, whatever the size of the corpus. All labelled rows count, none is sampled.
3. Class means and covariances follow, in units of the pooled deviation. A covariance is shrunk towards the pooled one, and
   that sum towards a multiple of the identity, so that statistics that never vary in a class do no harm.
4. Each covariance is factored once (Cholesky); the inverse factor is kept as constants of a projection. A document's
   score is the sigmoid of the difference of the class log densities: Mahalanobis distances ``|L^-1 (x - m)|^2``,
   log determinants, and log shares of the classes.

Defined results: a null text is an empty one, whose statistics are those of no characters; a null id is never held
out and has no label; an id with labels of both classes has none; repeated documents are each a row and each an
example; labels other than 0 and 1 are none; where a class has no examples every score is the smoothed share of class
1; columns of the input that the operator produces are replaced, others are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, stored, table, unused

#: Units that a share's denominator has more, shrinkage towards the pooled covariance and towards the identity.
PRIOR, TO_POOLED, TO_IDENTITY = 20.0, 0.1, 0.05
THRESHOLD, FOLDS = 0.3, 5
#: Log odds beyond this are cut, so that a score stays a number between 0 and 1.
MAX_LOG_ODDS = 500.0

STATISTICS = ("log_words", "word_length", "symbols", "bars", "exclamations", "capitals", "repeated_next", "distinct_words", "digits", "marks", "line_words", "repeated_lines", "capital_words")


def statistics(docs: DataFrame, text: str = "text", to: str = "x") -> DataFrame:
    """All input columns and ``to``, the array of :data:`STATISTICS`."""
    (parts,) = unused([*docs.columns, to], "parts")
    at = lambda name: F.col(parts).getField(name)
    t = F.coalesce(F.col(text), F.lit(""))
    share = lambda part, whole: F.sqrt(part / (whole + PRIOR))
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("double")
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    w, lines = at("w"), at("l")
    n, chars, held = F.size(w).cast("double"), at("c"), F.size(lines).cast("double")
    same = F.size(F.filter(w, lambda x, j: (j > 0) & (x == F.get(w, j - 1)))).cast("double")
    upper = F.size(F.filter(w, lambda x: x.rlike(r"^\p{Lu}{2,}\P{Ll}*$"))).cast("double")
    base = F.struct(
        words.alias("w"), F.split(t, "\n").alias("l"), F.length(t).cast("double").alias("c"), left(r"[^#*$%&<>]+").alias("symbols"), left(r"[^|]+").alias("bars"),
        left(r"[^!]+").alias("exclamations"), left(r"\P{Lu}+").alias("capitals"), left(r"[^0-9]+").alias("digits"), left(r"[^.,;:?]+").alias("marks"),
    )
    values = [
        F.log1p(n), F.log1p(F.greatest(chars - n, F.lit(0.0)) / (n + 1)), share(at("symbols"), chars), share(at("bars"), n), share(at("exclamations"), n), share(at("capitals"), chars),
        share(same, n), F.log1p(F.size(F.array_distinct(w)).cast("double")) - F.log1p(n), share(at("digits"), chars), share(at("marks"), n), F.log1p(n / held), share(held - F.size(F.array_distinct(lines)), held), share(upper, n),
    ]
    # the pieces of a text are made once for each row: an array of one, exploded, is no projection that is merged into the next
    d = docs.drop(to).withColumn(parts, F.explode(F.array(base)))
    return d.withColumn(to, F.array(*[v.cast("double") for v in values])).drop(parts)


def held_out(id_column: str, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """What scoring needs: for each class its mean, the inverse of its covariance's Cholesky factor, and the constant of its log density."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def log_odds(self, x: Column) -> Column:
        """Of class 1 against class 0: constants in one projection."""

        def log_density(c: int) -> Column:
            z = [F.get(x, k) - F.lit(float(m)) for k, m in enumerate(self.means[c])]
            out = F.lit(float(self.constants[c]))
            for row in self.factors[c]:
                y = F.lit(0.0)
                for k in np.flatnonzero(row):
                    y = y + F.lit(float(row[k])) * z[k]
                out = out - F.lit(0.5) * y * y
            return out

        return log_density(1) - log_density(0)


def discriminant(moments: list[tuple[int, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """From each class's number of rows, sums and sums of products."""
    n = np.array([m[0] for m in moments], float)
    means = np.stack([s / c for c, s, _ in moments])
    covariances = np.stack([p / c - np.outer(m, m) for (c, _, p), m in zip(moments, means)])
    pooled = (n[:, None, None] * covariances).sum(0) / n.sum()
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    scaled, pooled = covariances / np.outer(unit, unit), pooled / np.outer(unit, unit)
    factors, constants = [], []
    for share, own in zip(n / n.sum(), scaled):
        s = (1 - to_pooled) * own + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        low = np.linalg.cholesky((s + s.T) / 2)
        factors.append(np.linalg.inv(low) / unit)  # statistics come unscaled
        constants.append(math.log(share) - np.log(np.diag(low)).sum())
    return Discriminant(means, np.stack(factors), np.array(constants))


def class_moments(examples: DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Number, sums and products of ``x`` for ``label`` 0 and 1: two rows of fixed width reach the driver."""
    k = len(STATISTICS)
    x = [F.get("x", i) for i in range(k)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]
    rows = {r["label"]: r for r in examples.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).where("label IN (0, 1)").collect()}
    out = []
    for c in (0, 1):
        r = rows.get(c)
        p = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"] if r else 0.0
        out.append((r["n"] if r else 0, np.array([r[f"s{i}"] if r else 0.0 for i in range(k)]), p))
    return out


def fit(examples: DataFrame) -> tuple[Discriminant | None, float]:
    """The discriminant of rows ``(x, label)``, or none where a class has no rows, and the smoothed share of class 1."""
    moments = class_moments(examples)
    n0, n1 = moments[0][0], moments[1][0]
    return (discriminant(moments) if n0 and n1 else None), (n1 + 1) / (n0 + n1 + 2)


def score(stats: DataFrame, model: Discriminant | None, share: float, threshold: float = THRESHOLD, x: str = "x") -> DataFrame:
    """Adds ``score`` and ``predicted``."""
    if model is None:
        d = stats.withColumn("score", F.lit(share))
    else:
        odds = F.greatest(F.least(model.log_odds(F.col(x)), F.lit(MAX_LOG_ODDS)), F.lit(-MAX_LOG_ODDS))
        d = stats.withColumn("score", 1 / (1 + F.exp(-odds)))
    return d.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def known_labels(labels: DataFrame, id_column: str = "doc_id", label: str = "quality") -> DataFrame:
    """One label of 0 or 1 for each id on which its rows agree."""
    d = labels.select(F.col(id_column).alias("__id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND __id IS NOT NULL")
    return d.groupBy("__id").agg(F.min("label").alias("label"), F.max("label").alias("__m")).where("label = __m").select("__id", "label")


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The columns of ``docs`` without the text, and ``held_out``, ``score`` and ``predicted``; nothing but the statistics of the text is an input of a score."""
    d = docs.drop("held_out", "score", "predicted")
    (x,) = unused(d.columns, "x")
    d = stored(statistics(d, text, x).drop(text).withColumn("held_out", held_out(id_column)))
    examples = d.where(~F.col("held_out")).select(F.col(id_column).alias("__id"), F.col(x).alias("x")).join(known_labels(labels, id_column, label), "__id")
    return score(d, *fit(examples), x=x).drop(x)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "held_out", "score", "predicted")


#: A fitted model: tests hold its parts against numpy and its accuracy on held-out rows.
SQL: dict[str, str] = {}
QUERIES = {"op12_quality_classifier": op12_quality_classifier}
