"""Series-level structure: frames with a fallback, price levels and a structure score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.registry import compute
from barloom.operators.blocks import BLOCK_ROWS, SERIES

STRUCTURE = ("higher_highs", "higher_lows", "lower_highs", "lower_lows")
_SHORT = {"higher_highs": "_hh10", "higher_lows": "_hl10", "lower_highs": "_lh10", "lower_lows": "_ll10"}


def price_structure(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Twenty-bar structure flags; a series in which they never fire takes the ten-bar ones."""
    df = compute(bars, [*STRUCTURE, "trend_strength", *_SHORT.values()], block_rows)
    hits = df.groupBy(*SERIES).agg(F.sum(F.col("higher_highs") + F.col("lower_lows")).alias("_hits"))
    df = df.join(hits, list(SERIES))
    cols = [F.when(F.col("_hits") > 0, F.col(c)).otherwise(F.col(_SHORT[c])).alias(c) for c in STRUCTURE]
    return df.select(*SERIES, "ts", *cols, "trend_strength")


def support_resistance(bars: DataFrame, last: int = 5, gap: float = 0.005, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cluster means of the newest pivots of each kind; neighbours within ``gap`` share a cluster."""
    df = compute(bars, ["pa_pivot_high", "pa_pivot_low"], block_rows)
    kinds = F.array_compact(F.array(
        F.when(F.col("pa_pivot_high") == 1, F.struct(F.lit("resistance").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("pa_pivot_low") == 1, F.struct(F.lit("support").alias("kind"), F.col("low").alias("price")))))
    pivots = df.select(*SERIES, "ts", F.explode(kinds).alias("p")).select(*SERIES, "ts", "p.*")
    keys = [*SERIES, "kind"]
    newest = pivots.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))).where(F.col("_k") <= last)
    newest = newest.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n >= 2")
    w = Window.partitionBy(*keys).orderBy("price", "ts")
    before = F.lag("price").over(w)
    # the gap to a level of 0 is infinite
    starts = F.when(F.coalesce(F.try_divide(F.abs(F.col("price") - before), before) > gap, F.lit(True)), 1).otherwise(0)
    cluster = newest.withColumn("_s", starts).withColumn("_g", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cluster.groupBy(*keys, "_g").agg(F.avg("price").alias("level"), F.count(F.lit(1)).alias("touches")).drop("_g")


def structure_score(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """0-100: how close the pivot density is to 10-30 % and how one-sided the newest twenty bars are."""
    df = compute(bars, ["pa_pivot_high", "pa_pivot_low", "trend_strength"], block_rows)
    dens = df.groupBy(*SERIES).agg(
        (F.sum(F.col("pa_pivot_high") + F.col("pa_pivot_low")) / F.count(F.lit(1))).alias("_d"))
    newest = df.withColumn("_k", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("ts")))).where("_k <= 20")
    trend = newest.groupBy(*SERIES).agg(F.avg(F.abs("trend_strength")).alias("_t"))
    d = F.col("_d")
    density = F.when(d.between(0.1, 0.3), 1.0).when(d < 0.1, d / 0.1).otherwise(0.3 / d)
    score = (density * 0.4 + F.least(F.col("_t") * 2, F.lit(1.0)) * 0.6) * 100
    return dens.join(trend, list(SERIES)).select(*SERIES, score.alias("structure_score"))
