"""Exact quantiles and ranks without collecting a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def counted_values(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value, n): equal values collapse before any ordering."""
    long = df.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value").where("value is not null")
    return long.groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def with_prefix_counts(counts: DataFrame, keys: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Adds ``below`` (rows with a smaller value in the group) and ``total``.

    Each group's values are cut at sketched quantile bounds; counts are accumulated inside a bin and the
    bin totals (at most 257 per group) are accumulated apart, so a huge group spreads over many tasks.
    """
    keys = list(keys)
    bounds = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / BINS for i in range(1, BINS)], 2000).alias("_bounds"))
    binned = counts.join(bounds, keys).withColumn(
        "_bin", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    per_bin = binned.groupBy(*keys, "_bin").agg(F.sum(n).alias("_bn"))
    wb = Window.partitionBy(*keys)
    before = F.sum("_bn").over(wb.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_bin.select(*keys, "_bin", F.coalesce(before, F.lit(0)).alias("_off"), F.sum("_bn").over(wb).alias("total"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        binned.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(offsets, [*keys, "_bin"])
        .withColumn("below", F.col("_in") + F.col("_off"))
        .drop("_bin", "_in", "_off")
    )


def grouped_quantiles(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, metric, prob, value): exact quantiles with linear interpolation between neighbours."""
    keys = list(keys)
    ranked = with_prefix_counts(counted_values(df, keys, metrics), [*keys, "metric"])
    at = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    r = ranked.select(*keys, "metric", "value", "n", "below", "total", at)
    h = F.col("prob") * (F.col("total") - 1)
    lo, hi = F.floor(h), F.ceil(h)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    hit = r.where(holds(lo) | holds(hi))
    return (
        hit.groupBy(*keys, "metric", "prob")
        .agg(F.max(F.when(holds(lo), F.col("value"))).alias("a"), F.max(F.when(holds(hi), F.col("value"))).alias("b"),
             F.max(h - lo).alias("f"))
        .select(*keys, "metric", "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("value"))
    )
