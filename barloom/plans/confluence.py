"""Confluence of three timeframes for a set of signals and a direction, at every bar of the fastest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.confluence import SIDES, signal_features
from barloom.functions.registry import REGISTRY
from barloom.operators.blocks import BLOCK_ROWS
from barloom.plans.mtf import mtf_table
from barloom.plans.structure import ladder

# Weights, grades with recommendation and confidence by least score, categories by parts of a signal's name.
WEIGHTS = {"timeframe_alignment": 0.25, "signal_strength": 0.20, "volume_confirmation": 0.15, "momentum_alignment": 0.15, "structure_quality": 0.15,
           "regime_alignment": 0.10}
GRADES = {
    90: ("A+", "high_confidence", "very_high"), 85: ("A", "high_confidence", "high"), 80: ("A-", "good_confidence", "high"),
    75: ("B+", "good_confidence", "medium_high"), 70: ("B", "moderate_confidence", "medium"), 65: ("B-", "moderate_confidence", "medium"),
    60: ("C+", "low_confidence", "medium_low"), 55: ("C", "low_confidence", "low"), 50: ("C-", "very_low_confidence", "low"), 40: ("D", "avoid", "very_low"),
}
LOWEST = ("F", "avoid", "very_low")
STRONG, WEAK = 80, 40
CATEGORIES = {"momentum": ("rsi", "macd", "stoch", "momentum"), "trend": ("ma", "ema", "adx", "trend"), "volatility": ("bb", "atr", "volatility"),
              "volume": ("volume", "obv", "cmf"), "pattern": ("swing", "breakout", "divergence", "pattern")}
FULL_WIDTH = 300
# ---- end of fixed values ----
Config = Mapping[str, Sequence[str]]


def mean(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0]) / float(len(parts))


def categories(config: Config) -> dict[str, tuple[int, float]]:
    """Per category how many of the signals belong to it, and that number over the number of its keywords."""
    names = {s for group in config.values() for s in group}
    counts = {k: sum(any(w in s for w in words) for s in names) for k, words in CATEGORIES.items()}
    return {k: (n, n / len(CATEGORIES[k])) for k, n in counts.items()}


def _frame(bars: DataFrame, timeframes: tuple[str, str, str], config: Config, direction: str, at: str, block_rows: int) -> DataFrame:
    signals = list(dict.fromkeys(s for group in config.values() for s in group))
    extra = [n for s in signals for n in signal_features(s, direction)]
    extra += [f"conf_{p}_{direction}" for p in ("volume", "rsi", "macd", "direction")] + ["conf_structure", "conf_regime", "conf_volatility"]
    return mtf_table(bars, timeframes, signals, extra, None, at, block_rows)


def alignment_share(config: Config, direction: str, states: bool) -> Column:
    """Mean share of agreeing signals per timeframe; a fifth of the score is for 0.8 and more on all, few signals are discounted.

    Without state columns the raw values are compared with the direction's name, which none of them equals.
    """
    d, total = SIDES[direction], sum(len(v) for v in config.values())
    shares = [mean([F.when(F.col(f"{p}_state_{s}") == d, 1.0).otherwise(0.0) if states else F.lit(0.0) for s in group]) for p, group in config.items() if group]
    if not shares:
        return F.lit(0.0)
    perfect = F.when(F.array_min(F.array(*shares)) >= 0.8, 1.0).otherwise(0.0)
    discount = max(0.0, 1 - 10 / total) if total < 10 else 0.0
    return F.least(F.lit(100.0), (mean(shares) * 0.8 + perfect * 0.2) * (1 - discount) * 100)


def components(config: Config, direction: str) -> dict[str, Column]:
    named = [(p, *signal_features(s, direction)) for p, group in config.items() for s in group]
    held = lambda p, c, other: F.coalesce(F.col(f"{p}_{c}"), F.lit(other))
    strength = mean([held(p, n, 0.5) for p, n, _, _ in named]) * 0.6 + mean([held(p, n, 0.3) for p, _, n, _ in named]) * 0.4
    over = lambda c, other: mean([held(p, c, other) for p in "htl"])
    return {
        "timeframe_alignment": alignment_share(config, direction, False),
        "signal_strength": F.least(F.lit(100.0), strength * 100),
        "volume_confirmation": over(f"conf_volume_{direction}", 0.0) * 100,
        "momentum_alignment": mean([over(f"conf_rsi_{direction}", 0.3), over(f"conf_macd_{direction}", 0.3)]) * 100,
        "structure_quality": over("conf_structure", 0.0) * 100,
        "regime_alignment": over("conf_regime", 0.8) * 100,
    }


def confluence_scores(bars: DataFrame, timeframes: tuple[str, str, str], config: Config, direction: str = "bullish", at: str = "close",
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Six parts from 0 to 100, their weighted score, grade, recommendation, confidence, strong and weak parts.

    ``config`` lists numeric signals by timeframe (``h``, ``t``, ``l``). ``state_alignment`` is the first part judged by signal states.
    """
    df = _frame(bars, timeframes, config, direction, at, block_rows)
    parts = components(config, direction)
    out = df.select("pair", "timeframe", "ts", *[c.alias(n) for n, c in parts.items()], alignment_share(config, direction, True).alias("state_alignment"))
    score = sum((F.col(n) * w for n, w in list(WEIGHTS.items())[1:]), F.col("timeframe_alignment") * WEIGHTS["timeframe_alignment"])
    out = out.withColumn("confluence_score", F.least(F.lit(100.0), score))
    # a billionth settles scores that stand at the edge of a grade
    edge = F.col("confluence_score") + 1e-9
    listed = lambda cond: F.array_compact(F.array(*[F.when(cond(F.col(n)), F.lit(n)) for n in WEIGHTS]))
    grade = [ladder(edge, {k: v[i] for k, v in GRADES.items()}, LOWEST[i]).alias(n) for i, n in enumerate(("grade", "recommendation", "confidence_level"))]
    return out.select("*", *grade, listed(lambda c: c + 1e-9 >= STRONG).alias("strengths"), listed(lambda c: c - 1e-9 <= WEAK).alias("weaknesses"))


def confluence_breakdown(bars: DataFrame, timeframes: tuple[str, str, str], config: Config, direction: str = "bullish", at: str = "close",
                         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Active share of each timeframe's signals, category coverage, agreement of price direction, column density, calmness."""
    df = _frame(bars, timeframes, config, direction, at, block_rows)
    cols: list[Column] = []
    for p, group in config.items():
        active = sum((F.coalesce(F.col(f"{p}_{signal_features(s, direction)[2]}"), F.lit(0)) for s in group), F.lit(0))
        cols += [active.alias(f"{p}_active"), (active / F.lit(float(max(1, len(group))))).alias(f"{p}_activation_rate")]
    for name, (n, coverage) in categories(config).items():
        cols += [F.lit(n).alias(f"{name}_signals"), F.lit(coverage).alias(f"{name}_coverage")]
    toward = mean([F.coalesce(F.col(f"{p}_conf_direction_{direction}"), F.lit(0.5)) for p in "htl"])
    seen = [F.col(f"{p}_conf_volatility") for p in "htl"]
    known = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in seen), F.lit(0))
    volatility = F.when(known > 0, sum((F.coalesce(c, F.lit(0.0)) for c in seen), F.lit(0.0)) / known).otherwise(0.02)
    width = sum(not n.startswith("_") for n in REGISTRY)
    cols += [toward.alias("timeframe_confirmation"), F.lit(min(1.0, 3 * width / FULL_WIDTH)).alias("signal_density"), F.greatest(F.lit(0.0), 1 - volatility).alias("risk_adjusted_score")]
    return df.select("pair", "timeframe", "ts", *cols)
