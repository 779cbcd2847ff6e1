"""Trend synthesis and structure alignment over three timeframes, at every bar of the fastest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.registry import compute
from barloom.functions.trend_class import LABELS, QUALITY_POINTS, points
from barloom.operators.blocks import BLOCK_ROWS
from barloom.operators.nearest import nearest_join
from barloom.plans.mtf import mtf_table

# Weights of the timeframes and of the parts of an alignment, least scores of its classes.
SHARES = {"h": 5, "t": 3, "l": 2}
PARTS = {"trend": 0.25, "swing": 0.20, "pullback": 0.15, "structure": 0.15, "momentum": 0.15, "volume": 0.10}
CLASSES = {0.8: "perfect", 0.7: "excellent", 0.6: "good", 0.5: "moderate", 0.4: "partial", 0.3: "weak"}
TOLERANCE = {"t": 0.01, "l": 0.005}
TREND_SCORES = {"strong_uptrend": 2, "uptrend": 1, "weak_uptrend": 1, "downtrend": -1, "weak_downtrend": -1, "strong_downtrend": -1}
LOOK = {"h": 3, "t": 5, "l": 8}
MOMENTUM = ("rsi", "macd", "stoch_k", "momentum_continuation")
# ---- end of fixed values ----


def spread(a: Column, b: Column, c: Column) -> Column:
    """Population standard deviation of three values."""
    m = (a + b + c) / 3.0
    return F.sqrt((F.pow(a - m, 2) + F.pow(b - m, 2) + F.pow(c - m, 2)) / 3.0)


def ladder(x: Column, steps: dict, other) -> Column:
    out = F.lit(other)
    for least in sorted(steps):
        out = F.when(x >= least, F.lit(steps[least])).otherwise(out)
    return out


def _agreement(x: Column, values: tuple) -> Column:
    return F.when(x <= 0.5, values[0]).when(x <= 1.0, values[1]).when(x <= 1.5, values[2]).otherwise(values[3])


def synthesis_columns(suffix: str = "") -> dict[str, Column]:
    """From aligned ``h_``, ``t_``, ``l_`` classes of one bar each. A timeframe that has not closed a bar yet is neutral, strength 0."""
    trend = {p: F.coalesce(F.col(f"{p}_primary_trend{suffix}"), F.lit("neutral")) for p in SHARES}
    strength = {p: F.coalesce(F.col(f"{p}_primary_trend_strength{suffix}"), F.lit(0.0)) for p in SHARES}
    quality = {p: points(F.coalesce(F.col(f"{p}_swing_trend_quality"), F.lit("poor")), QUALITY_POINTS) for p in SHARES}
    votes = F.array(*[F.struct(sum((F.when(trend[p] == label, w).otherwise(0) for p, w in SHARES.items()), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(label).alias("label"))
                      for i, label in enumerate(LABELS)])
    h, t, low = (points(trend[p], TREND_SCORES) for p in "htl")
    same = F.when((trend["h"] == trend["t"]) & (trend["t"] == trend["l"]), 3).when(
        (trend["h"] == trend["t"]) | (trend["t"] == trend["l"]) | (trend["h"] == trend["l"]), 2).otherwise(1)
    up, down = (sum((F.when(F.col(f"{p}_oscillator_trend") == side, 1).otherwise(0) for p in SHARES), F.lit(0)) for side in ("bullish", "bearish"))
    return {
        "htf_trend": trend["h"], "ttf_trend": trend["t"], "ltf_trend": trend["l"], "primary_trend": F.array_max(votes)["label"],
        "trend_strength": sum((strength[p] * w for p, w in SHARES.items()), F.lit(0.0)) / 10.0,
        "alignment": _agreement(spread(h, t, low), ("perfect_alignment", "good_alignment", "partial_alignment", "conflicting")),
        "trend_alignment_score": same / 3.0 * 100,
        "structure_quality_score": sum((quality[p] * w for p, w in SHARES.items()), F.lit(0)) / 10.0,
        "momentum_alignment": F.when(up >= 2, "bullish_alignment").when(down >= 2, "bearish_alignment").otherwise("mixed_momentum"),
    }


def trend_synthesis(bars: DataFrame, timeframes: tuple[str, str, str], at: str = "close", averages: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One trend from three, weighted 5, 3 and 2, with how far they agree."""
    suffix = "_averages" if averages else ""
    extra = [f"primary_trend{suffix}", f"primary_trend_strength{suffix}", "swing_trend_quality", "oscillator_trend"]
    df = mtf_table(bars, timeframes, [], extra, None, at, block_rows)
    return df.select("pair", "timeframe", "ts", *[c.alias(n) for n, c in synthesis_columns(suffix).items()])


def nearest_pivots(bars: DataFrame, high_tf: str, low_tf: str, side: str = "high", tolerance: float = 0.01, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each confirmed swing of a slow timeframe with the swing of a faster one nearest in time, and whether their prices agree."""
    flag = f"swing_{side}"
    swings = compute(bars.where(F.col("timeframe").isin(high_tf, low_tf)), [flag], block_rows).where(F.col(flag) == 1)
    picked = swings.select("pair", "timeframe", "ts", F.col(side).alias("price"), F.col("high"))
    slow = picked.where(F.col("timeframe") == high_tf).drop("high")
    fast = picked.where(F.col("timeframe") == low_tf).select("pair", "ts", "high")
    out = nearest_join(slow, fast, ["pair"], prefix="near_")
    apart = F.try_divide(F.col("near_high") - F.col("price"), F.col("price"))
    return out.select("pair", "timeframe", "ts", "price", "near_ts", "near_high", F.col("near_distance").alias("seconds"),
                      apart.alias("price_diff"), F.coalesce(F.abs(apart) < tolerance, F.lit(False)).alias("agrees"))


def _respected(side: str) -> tuple[Column, Column]:
    """(met, asked): of the last three slow swings, how many have a nearest recent swing at about their price in each faster timeframe."""
    slow = F.slice(f"h_{side}_ring", 1, LOOK["h"])

    def met(p: str) -> Column:
        near = F.slice(f"{p}_{side}_ring", 1, LOOK[p])

        def agrees(s: Column) -> Column:
            by_time = F.transform(near, lambda x: F.struct(F.abs(F.unix_micros(x["ts"]) - F.unix_micros(s["ts"])).alias("d"), x["ts"].alias("ts"), x["high"].alias("high")))
            return F.coalesce(F.abs(F.try_divide(F.array_min(by_time)["high"] - s[side], s[side])) < TOLERANCE[p], F.lit(False))

        return F.coalesce(F.size(F.filter(slow, agrees)), F.lit(0))

    return met("t") + met("l"), 2 * F.coalesce(F.size(slow), F.lit(0))


def alignment_columns() -> dict[str, Column]:
    num = lambda p, c: F.coalesce(F.col(f"{p}_{c}"), F.lit(0))
    order = [points(F.coalesce(F.col(f"{p}_swing_order"), F.lit("neutral")), TREND_SCORES) for p in "htl"]
    trend = _agreement(spread(*order), (1.0, 0.75, 0.5, 0.25))
    (mh, ah), (ml, al) = _respected("high"), _respected("low")
    swing = F.when(ah + al > 0, (mh + ml) / (ah + al)).otherwise(0.0)
    backs = [num(p, "pullbacks_so_far") for p in "htl"]
    pullback = F.when(F.least(*backs) > 0, F.least(*backs) / F.greatest(*backs)).otherwise(0.0)
    structure = sum((F.coalesce(F.col(f"{p}_swing_strength"), F.lit(0.0)) for p in "tl"), F.coalesce(F.col("h_swing_strength"), F.lit(0.0))) / 3.0
    state = lambda p, s: F.coalesce(F.col(f"{p}_state_{s}"), F.lit(0))
    momentum = sum((F.when((state("h", s) == state("t", s)) & (state("t", s) == state("l", s)), 1).otherwise(0) for s in MOMENTUM), F.lit(0)) / float(len(MOMENTUM))
    # a third measure has no column and never confirms
    volume = sum((F.when((F.least(*[num(p, c) for p in "htl"]) > 0) | (F.greatest(*[num(p, c) for p in "htl"]) < 0), 1).otherwise(0)
                  for c in ("volume_breakout_confirmation", "volume_divergence")), F.lit(0)) / 3.0
    return {"trend_score": trend, "swing_score": swing, "pullback_score": pullback, "structure_score": structure, "momentum_score": momentum, "volume_score": volume}


def structure_alignment(bars: DataFrame, timeframes: tuple[str, str, str], at: str = "close", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Six agreements of three timeframes, their weighted score and its class, at every bar of the fastest, from what had closed by then."""
    extra = ["swing_order", "high_ring", "low_ring", "pullbacks_so_far", "swing_strength", "volume_breakout_confirmation", "volume_divergence"]
    df = mtf_table(bars, timeframes, list(MOMENTUM), extra, None, at, block_rows)
    parts = alignment_columns()
    out = df.select("pair", "timeframe", "ts", *[c.alias(n) for n, c in parts.items()])
    score = sum((F.col(f"{p}_score") * w for p, w in list(PARTS.items())[1:]), F.col("trend_score") * PARTS["trend"])
    out = out.withColumn("alignment_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))
    # scores are sums of products; a billionth settles those that stand at the edge of a class
    return out.withColumn("alignment_class", ladder(F.col("alignment_score") + 1e-9, CLASSES, "conflicting"))
