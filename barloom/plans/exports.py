"""Derived views of the feature table and a bundle of them on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.candles import CANDLES
from barloom.functions.charts import CHARTS
from barloom.functions.registry import compute
from barloom.operators.blocks import SERIES
from barloom.session import cut_lineage

PULLBACK = ("pullback_from_high_pct", "pullback_from_low_pct", "pullback_depth", "pullback_stage", "pullback_quality_score")
ACTION = ("higher_highs", "lower_lows", "trend_structure", "market_structure", "structure_break_bullish", "structure_break_bearish")


def instance_summary(df: DataFrame, regime: str = "bar_regime") -> DataFrame:
    """Per series and regime: span, first and last price, extremes, volatility, mean volume."""
    return df.groupBy(*SERIES, F.col(regime).alias("regime")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("close", "ts").alias("first_price"), F.max_by("close", "ts").alias("last_price"),
        F.max("high").alias("max_price"), F.min("low").alias("min_price"), F.stddev_samp("_pct1").alias("volatility"), F.avg("volume").alias("avg_volume"), F.count(F.lit(1)).alias("bars"))


def regime_type_stats(df: DataFrame, regime: str, instance: str) -> DataFrame:
    """Per regime type: bars, mean and deviation of price, of volume, and the number of its instances."""
    return df.groupBy(F.col(regime).alias("regime_type")).agg(
        F.count(F.lit(1)).alias("bars"), F.avg("close").alias("close_mean"), F.stddev_samp("close").alias("close_std"), F.avg("volume").alias("volume_mean"),
        F.stddev_samp("volume").alias("volume_std"), F.countDistinct(*SERIES, instance).alias("instances"))


def regime_returns(df: DataFrame, regime: str, horizons: tuple[int, ...] = (24, 72, 168)) -> DataFrame:
    """Per regime type: bars, mean forward return and share of gains at each horizon, from ``future_return_<bars>`` columns."""
    cols = [c for h in horizons for c in (F.avg(f"future_return_{h}").alias(f"return_{h}"), F.avg((F.col(f"future_return_{h}") > 0).cast("int")).alias(f"win_rate_{h}"))]
    return df.groupBy(F.col(regime).alias("regime_type")).agg(F.count(F.lit(1)).alias("bars"), *cols)


def views(features: DataFrame) -> dict[str, DataFrame]:
    key = [*SERIES, "ts"]
    cols = set(features.columns)
    pick = lambda names: features.select(*key, *[c for c in names if c in cols])
    long = features.select(*[F.col(c).cast("double").alias(c) for c, t in features.dtypes if t in ("double", "int", "bigint")])
    reference = long.unpivot([], long.columns, "column_name", "v").groupBy("column_name").agg(
        F.count("v").alias("non_null"), F.sum(F.col("v").isNull().cast("int")).alias("nulls"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return {
        "enriched": features, "indicator_reference": reference, "candles": pick([f"pattern_{c}" for c in CANDLES]), "chart_patterns": pick(CHARTS),
        "pullbacks": pick(PULLBACK), "price_action": pick(ACTION), "regime_states": pick(["bar_regime"]), "instance_summary": instance_summary(features),
        "summary": features.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")),
    }


def write_bundle(bars: DataFrame, path: str) -> DataFrame:
    """Writes every view as CSV (series views partitioned by pair and timeframe); returns the row count of each."""
    names = ["rsi", "adx", "atr", "_pct1", "bar_regime", *[f"pattern_{c}" for c in CANDLES], *CHARTS, *PULLBACK, *ACTION]
    feats = cut_lineage(compute(bars, names))
    counts = None
    for name, df in views(feats).items():
        w = df.write.mode("overwrite").option("header", True)
        (w.partitionBy(*SERIES) if set(SERIES) <= set(df.columns) else w).csv(f"{path}/{name}")
        n = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("view"), "rows")
        counts = n if counts is None else counts.unionByName(n)
    return counts
