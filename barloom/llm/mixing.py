"""Mixing sources to target weights by Poisson replication (native).

Each document of source s is repeated Poisson(rate_s) times, rate_s = weight_s * budget * N / n_s, so that source s makes up
``weight_s`` of the output in expectation. The count is the inverse of the Poisson distribution at a uniform number that md5 of
(seed, doc_id) gives: it does not depend on partitions, retries or other rows. Copies are exploded and dealt out by md5 of
(seed, doc_id, copy), which is a shuffle of the whole output.

Defined results: a null source is a source of its own; a null doc_id hashes as the word null; rows that repeat a doc_id within a
source get the same count; sources missing from given weights get weight 0; an empty table gives an empty result; columns of the
input named copy or order_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import saved

#: A table of rates with at most this many rows is broadcast; a longer one is joined by key, where Spark may split a hot source.
BROADCAST_ROWS = 20_000
#: The largest mean inverted at once; a larger one is the sum of that many independent parts.
PART_MEAN = 32.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of md5 over the parts joined by colons."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5, budget: float = 1.0) -> DataFrame:
    """One row per source: __key, n, rate, and the cumulative probabilities of one part.

    Without ``weights`` the target weight of a source is proportional to n ** temperature.
    """
    n = docs.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)) if temperature != 0.5 else F.sqrt(F.col("n").cast("double")))
    else:
        given = F.lit(0.0)
        for k, v in weights.items():
            given = F.when(F.col("__source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(given)
        n = n.withColumn("w", given)
    n = saved(n, "mix-sources")
    total = n.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    rate = F.col("w") / F.lit(float(total["w"] or 1)) * F.lit(budget * (total["n"] or 0)) / F.col("n")
    n = n.withColumn("rate", rate).withColumn("__parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("__parts")
    terms = F.aggregate(
        F.sequence(F.lit(1), (mean + 12 * F.sqrt(mean) + 40).cast("int")),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / k)).alias("c")),
        lambda acc: acc["c"])
    return saved(n.select("__source", "n", "rate", "__parts", terms.alias("__cdf")), "mix-rates")


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: dict[str | None, float] | None = None, temperature: float = 0.5,
        budget: float = 1.0, seed: int = 13) -> DataFrame:
    """The repeated rows of ``docs`` with copy (from 1) and order_key, dealt out at random and sorted by order_key in each partition."""
    table = rates(docs, source, weights, temperature, budget)
    known = table.count()
    docs = docs.drop("copy", "order_key")
    joined = docs.join(F.broadcast(table) if known <= BROADCAST_ROWS else table, F.col(source).eqNullSafe(F.col("__source")))
    inverse = lambda u: F.size(F.filter("__cdf", lambda c: c <= u))
    count = F.when(F.col("__parts") == 1, inverse(uniform(F.lit(seed), F.col(doc_id)))).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, j: acc + inverse(uniform(F.lit(seed), F.col(doc_id), F.lit("part"), j))))
    out = joined.withColumn("__times", count).filter("__times > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    return out.withColumn("order_key", key).repartition("order_key").sortWithinPartitions("order_key")


SQL = """
WITH n AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM r, range(0, 60) t(k)),
d AS (SELECT doc_id, text, lang, source, n_chars, (('0x' || substr(md5('13:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents),
t AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM p WHERE p.source = d.source AND p.c <= d.u) AS times FROM d)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('13:' || doc_id || ':' || copy) AS order_key
FROM (SELECT *, unnest(range(1, times + 1)) AS copy FROM t WHERE times > 0)
"""
