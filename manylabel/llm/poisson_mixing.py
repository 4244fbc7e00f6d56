"""Mixing sources to target weights by Poisson replication.

A source with weight ``w`` (of all present) and ``n`` documents is repeated at the mean
rate ``w * epochs * N / n``. Each document draws its number of copies by inverting the
Poisson distribution at a uniform number that is a hash of seed and document id: the draw is
the same on any cluster and after any retry. Rates above 32 are sums of equal smaller draws, so
that no probability underflows. Copies are exploded and dealt over all partitions by a
hash of seed, id and copy, and sorted by it within each: a global shuffle in one exchange.

A source that holds a third of all rows costs nothing extra: counts come from partial
aggregates, rates reach documents by a broadcast whose size is checked (another join
beyond it), and copies spread by their own hash.

Defined results: a null source is a source of its own; a null id draws like the id
``null``; repeated rows draw alike; a document may get 0 copies; an empty table gives an
empty table. Sources without a target share what the targets leave of 1, evenly; targets that
sum to 1 leave them none, and larger sums or negative targets are an error. All input columns are
kept; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

#: The production mix: the crawl gets a fifth, the other sources share the rest evenly.
TARGETS = {"src0": 0.2}
SEED = 17
#: Sources whose rates are broadcast; each takes about 1 kB.
MAX_BROADCAST_SOURCES = 10_000
_STEP, _TERMS = 32.0, 100
_KEY = "\x01null"


def uniform(*parts) -> Column:
    """A number in [0, 1) with 52 random bits, from the digest of the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: Mapping[str, float] = TARGETS, epochs: float = 1.0, source: str = "source") -> DataFrame:
    """``(__source, rate, draws, cdf)``: each source's mean repetition rate and the distribution of one of its draws."""
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit(_KEY)).alias("__source")).agg(F.count("*").alias("n"))
    named = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.create_map().cast("map<string,double>")
    counts = counts.withColumn("named", F.try_element_at(named, F.col("__source")))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.when(F.col("named").isNull(), 1)).alias("others"), F.coalesce(F.sum("named"), F.lit(0.0)).alias("given"))
    rest = 1.0 - sum(targets.values())
    w = counts.join(F.broadcast(total))  # one row
    w = w.withColumn("weight", F.coalesce("named", F.lit(rest) / F.col("others")) / (F.col("given") + F.when(F.col("others") > 0, F.lit(rest)).otherwise(F.lit(0.0))))
    w = w.withColumn("rate", F.col("weight") * F.lit(epochs) * F.col("total") / F.col("n"))
    w = w.withColumn("draws", F.greatest(F.ceil(F.col("rate") / _STEP), F.lit(1)).cast("int"))
    each = F.col("rate") / F.col("draws")
    log_factorial = lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + F.log(F.greatest(i, F.lit(1)).cast("double")))
    pmf = F.transform(F.sequence(F.lit(0), F.lit(_TERMS)), lambda k: F.exp(k * F.log(each) - each - log_factorial(k)))
    w = w.withColumn("pmf", pmf)
    cdf = F.transform(F.sequence(F.lit(1), F.lit(_TERMS + 1)), lambda k: F.aggregate(F.slice("pmf", 1, k), F.lit(0.0), lambda a, p: a + p))
    return w.select("__source", "rate", "draws", cdf.alias("cdf"))


def mix(docs: DataFrame, targets: Mapping[str, float] = TARGETS, epochs: float = 1.0, seed: int = SEED, id_column: str = "doc_id", source: str = "source") -> DataFrame:
    """All input columns once for each copy, with ``copy`` (from 1), ``rate`` and ``shuffle_key``, globally shuffled."""
    spark = docs.sparkSession
    if any(w < 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target weights must not be negative nor sum to more than 1")
    held, rate, draws, cdf, n = unused(docs.columns, "source", "rate", "draws", "cdf", "n")
    table_ = rates(docs, targets, epochs, source).toDF(held, rate, draws, cdf)
    few = table_.limit(MAX_BROADCAST_SOURCES + 1).collect()
    if len(few) <= MAX_BROADCAST_SOURCES:
        table_ = F.broadcast(spark.createDataFrame(few, table_.schema))
    d = docs.drop("copy", "rate", "shuffle_key").withColumn(held, F.coalesce(F.col(source), F.lit(_KEY)))
    d = d.join(table_, held).withColumnRenamed(rate, "rate")
    draw = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), F.col(id_column), j)))
    copies = F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda a, j: a + draw(j))
    d = d.withColumn(n, copies).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    d = d.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.col("copy").cast("string"))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return d.drop(held, n, draws, cdf).repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select("doc_id", F.col("copy").cast("long").alias("copy"), "source", F.round("rate", 6).alias("rate"), "shuffle_key", F.sha2("text", 256).alias("text_sha256"))


SQL = {
    "op8_poisson_mixing": f"""
WITH d AS (SELECT doc_id, source, text, coalesce(source, chr(1) || 'null') AS s FROM documents),
c AS (SELECT s, count(*) AS n, CASE s WHEN 'src0' THEN 0.2::DOUBLE END AS named FROM d GROUP BY s),
t AS (SELECT sum(n)::DOUBLE AS total, count(*) FILTER (named IS NULL) AS others, coalesce(sum(named), 0.0) AS given FROM c),
r AS (SELECT s, coalesce(named, 0.8::DOUBLE / others) / (given + CASE WHEN others > 0 THEN 0.8::DOUBLE ELSE 0 END) * total / n AS rate FROM c, t),
k AS (SELECT s, rate, greatest(ceil(rate / 32), 1)::INT AS draws, rate / greatest(ceil(rate / 32), 1) AS l FROM r),
p AS (SELECT s, rate, draws, i, exp(i * ln(l) - l - lgamma(i + 1)) AS pmf FROM k, range(0, 101) x(i)),
f AS (SELECT s, rate, draws, list(cdf ORDER BY i) AS cdf FROM (SELECT *, sum(pmf) OVER (PARTITION BY s ORDER BY i) AS cdf FROM p) GROUP BY ALL),
u AS (SELECT d.*, rate, cdf, unnest(range(1, draws + 1)) AS j FROM d JOIN f USING (s)),
n AS (SELECT doc_id, source, text, rate, sum(len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 13))::BIGINT / {1 << 52}::DOUBLE)))::INT AS copies
      FROM u GROUP BY ALL),
x AS (SELECT *, unnest(range(1, copies + 1))::BIGINT AS copy FROM n)
SELECT doc_id, copy, source, round(rate, 6) AS rate, md5('17/order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS shuffle_key, sha256(text) AS text_sha256 FROM x"""
}
QUERIES = {"op8_poisson_mixing": op8_poisson_mixing}
