"""How alike strategies behave, and a set of them that behave differently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations(returns: DataFrame, strategies: Sequence[str], min_signals: int = 30) -> DataFrame:
    """(a, b, correlation, n) for every pair of return columns, all pairs in one aggregate.

    A bar on which a strategy has no signal is null and leaves the pair out; the number of strategies is a
    driver-side list, so the aggregate has a fixed width.
    """
    pairs = [(a, b) for i, a in enumerate(strategies) for b in strategies[i + 1:]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("correlation"),
                      F.sum((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("int")).alias("n")) for a, b in pairs]
    return returns.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").where(F.col("n") >= min_signals)


def diversified(pool: DataFrame, corr: DataFrame, name: str, score: str, limit: float = 0.5) -> DataFrame:
    """Strategies with no better-scored strategy too like them: each is the best of its neighbourhood."""
    both = corr.where(F.abs("correlation") > limit).select("a", "b")
    near = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    s = pool.select(F.col(name).alias("b"), F.col(score).alias("_other"))
    beaten = near.join(s, "b").join(pool.select(F.col(name).alias("a"), F.col(score).alias("_own")), "a").where("_other > _own").select(F.col("a").alias(name)).distinct()
    return pool.join(beaten, name, "left_anti")
