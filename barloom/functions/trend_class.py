"""Trend classification of every bar: swing structure, averages, oscillators and volume vote; strength 0-100."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.frames import div, flag, lag, sma, yes
from barloom.functions.registry import native, ring
from barloom.operators.blocks import span, trailing

G = "trend_class"
LAST = 5
# Trend labels in the order in which ties are settled, and the points of each part.
LABELS = ("strong_uptrend", "uptrend", "neutral", "downtrend", "strong_downtrend")
QUALITY_POINTS = {"excellent": 100, "good": 75, "poor": 25}
ALIGNMENT_POINTS = {"bullish": 100, "bearish": 100, "mixed": 50}
MOMENTUM_POINTS = {"strong": 100, "moderate": 75, "neutral": 50}
VOLUME_POINTS = {"bullish_confirmation": 100, "bearish_confirmation": 100, "neutral": 50, "divergence_warning": 25}
AVERAGES = ("ema_20", "ema_50", "ema_200", "sma_50", "sma_200")
# ---- end of fixed values ----


def points(column: Column | str, table: dict) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(0)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


for _side in ("high", "low"):
    # the last eight confirmed swings of a side: time and prices of the bar that confirmed them
    ring(f"{_side}_ring", [f"swing_{_side}", "high", "low", "ts"],
         lambda s=_side: (F.col(f"swing_{s}") == 1, F.struct("ts", "high", "low")), group=G)


def _rises(side: str) -> Column:
    """Of the last five swings, how many are beyond the one before."""
    parts = [flag(F.get(f"{side}_ring", F.lit(i))[side] > F.get(f"{side}_ring", F.lit(i + 1))[side]) for i in range(LAST - 1)]
    return sum(parts[1:], parts[0])


def _steps(side: str) -> Column:
    return F.greatest(F.least(F.size(f"{side}_ring"), F.lit(LAST)) - 1, F.lit(0))


_KNOWN = ["high_ring", "low_ring"]
native("_three_swings", _KNOWN, lambda: (F.size("high_ring") >= 3) & (F.size("low_ring") >= 3))
for _up, _down, _side in (("higher_highs_count", "lower_highs_count", "high"), ("higher_lows_count", "lower_lows_count", "low")):
    native(_up, [f"{_side}_ring", "_three_swings"], lambda s=_side: F.when(F.col("_three_swings"), _rises(s)).otherwise(0), group=G)
    native(_down, [f"{_side}_ring", "_three_swings", _up],
           lambda s=_side, u=_up: F.when(F.col("_three_swings"), _steps(s) - F.col(u)).otherwise(0), group=G)
_COUNTS = ["_three_swings", "higher_highs_count", "higher_lows_count", "lower_highs_count", "lower_lows_count"]


def _structure() -> Column:
    hh, hl, lh, ll = (F.col(c) for c in _COUNTS[1:])
    return (F.when(~F.col("_three_swings"), "neutral")
            .when((hh >= 3) & (hl >= 3), "strong_uptrend").when((hh >= 2) & (hl >= 2), "uptrend")
            .when((lh >= 3) & (ll >= 3), "strong_downtrend").when((lh >= 2) & (ll >= 2), "downtrend").otherwise("ranging"))


def _structure_quality() -> Column:
    hh, hl, lh, ll = (F.col(c) for c in _COUNTS[1:])
    total, most = hh + hl + lh + ll, F.greatest(hh + hl, lh + ll)
    return F.when((total >= 8) & (most >= 0.8 * total), "excellent").when((total >= 8) & (most >= 0.6 * total), "good").otherwise("poor")


native("swing_trend", _COUNTS, _structure, group=G)
native("swing_trend_quality", _COUNTS, _structure_quality, group=G)


# ---- averages ----
native("_above_averages", ["close", *AVERAGES], lambda: sum((flag(F.col("close") > F.col(a)) for a in AVERAGES[1:]), flag(F.col("close") > F.col(AVERAGES[0]))))
native("average_trend", ["_above_averages"],
       lambda: F.when(F.col("_above_averages") >= 4, "strong_uptrend").when(F.col("_above_averages") == 3, "uptrend")
       .when(F.col("_above_averages") <= 1, "strong_downtrend").otherwise("downtrend"), group=G)
native("average_slope", ["ema_20", "ema_50"],
       lambda: F.when((_slope("ema_20", 5) > 0.001) & (_slope("ema_50", 10) > 0.001), "rising")
       .when((_slope("ema_20", 5) < -0.001) & (_slope("ema_50", 10) < -0.001), "falling").otherwise("flat"), back=10, group=G)
native("average_distance", ["close", "ema_50", "ema_200"],
       lambda: (F.abs(div(F.col("close") - F.col("ema_50"), "ema_50")) + F.abs(div(F.col("close") - F.col("ema_200"), "ema_200"))) / 2, group=G)


def _slope(x: str, n: int) -> Column:
    return div(F.col(x) - lag(x, n - 1), lag(x, n - 1))


# ---- oscillators ----
def _between(x: str, lo: float, hi: float) -> Column:
    return flag((F.col(x) > lo) & (F.col(x) < hi))


native("_half_signals", ["rsi", "macd", "stoch_k", "cci", "adx"],
       lambda: 2 * (_between("rsi", 30, 50) + flag(F.col("macd") > 0) + _between("stoch_k", 20, 50) + _between("cci", -100, 0)) + flag(F.col("adx") > 25))
native("oscillator_trend", ["_half_signals"], lambda: F.when(F.col("_half_signals") >= 5, "bullish").otherwise("bearish"), group=G)
native("oscillator_strength", ["_half_signals"],
       lambda: F.when((F.col("_half_signals") >= 7) | (F.col("_half_signals") <= 3), "strong").otherwise("moderate"), group=G)
native("oscillator_divergence", ["high", "rsi", "_rn"],
       lambda: (F.col("_rn") >= 20) & yes(F.col("high") > F.max("high").over(span(-9, -1))) & yes(F.col("rsi") < F.max("rsi").over(trailing(10)) * 0.95),
       back=10, group=G)


# ---- volume ----
native("volume_level", ["volume"],
       lambda: F.when(div("volume", sma("volume", 20)) > 1.5, "high_volume").when(div("volume", sma("volume", 20)) < 0.7, "low_volume").otherwise("normal"),
       back=20, group=G)


def _money_flow() -> Column:
    """Sign of the change over 20 bars against the value 20 bars ago; from zero any move counts."""
    change, start = F.col("obv") - lag("obv", 19), lag("obv", 19)
    return (F.when((start != 0) & (div(change, start) > 0.05), "accumulation").when((start != 0) & (div(change, start) < -0.05), "distribution")
            .when((start == 0) & (change > 0), "accumulation").when((start == 0) & (change < 0), "distribution").otherwise("neutral"))


native("money_flow", ["obv"], _money_flow, back=19, group=G)


def _volume_trend() -> Column:
    price, volume = (div(F.col(c) - lag(c, 4), lag(c, 4)) for c in ("close", "volume"))
    return (F.when((price > 0.02) & (volume > 0.3), "bullish_confirmation").when((price < -0.02) & (volume > 0.3), "bearish_confirmation")
            .when((price > 0.02) & (volume < -0.2), "divergence_warning").otherwise("neutral"))


native("volume_agreement", ["close", "volume"], _volume_trend, back=4, group=G)


# ---- the vote ----
def _vote(averages: bool) -> Column:
    strong = F.col("oscillator_strength") == "strong"
    side = F.when(F.col("oscillator_trend") == "bullish", "uptrend").otherwise("downtrend")
    momentum = F.when(strong, F.concat(F.lit("strong_"), side)).otherwise(side)
    volume = (F.when(F.col("volume_agreement") == "bullish_confirmation", "uptrend").when(F.col("volume_agreement") == "bearish_confirmation", "downtrend")
              .when(F.col("volume_agreement") == "neutral", "neutral"))
    mean = F.col("average_trend") if averages else F.lit("neutral")
    ballots = [(F.col("swing_trend"), 4), (mean, 3), (momentum, 2), (volume, 1)]
    scores = F.array(*[F.struct(sum((flag(c == label) * w for c, w in ballots[1:]), flag(ballots[0][0] == label) * ballots[0][1]).alias("n"),
                                F.lit(-i).alias("o"), F.lit(label).alias("label")) for i, label in enumerate(LABELS)])
    return F.when(F.col("_rn") < 50, "neutral").otherwise(F.array_max(scores)["label"])


def _strength(averages: bool) -> Column:
    aligned = F.when(F.col("_above_averages") >= 3, "bullish").otherwise("bearish") if averages else F.lit("mixed")
    total = (points("swing_trend_quality", QUALITY_POINTS) * 6 + points(aligned, ALIGNMENT_POINTS) * 5
             + points("oscillator_strength", MOMENTUM_POINTS) * 5 + points("volume_agreement", VOLUME_POINTS) * 4)
    return F.when(F.col("_rn") < 50, 0.0).otherwise(total / 20.0)


_VOTERS = ["_rn", "swing_trend", "swing_trend_quality", "oscillator_trend", "oscillator_strength", "volume_agreement"]
# Without ema_20 in a frame the averages do not vote; the second pair lets them.
native("primary_trend", _VOTERS, lambda: _vote(False), group=G)
native("primary_trend_strength", _VOTERS, lambda: _strength(False), group=G)
native("primary_trend_averages", [*_VOTERS, "average_trend"], lambda: _vote(True), group=G)
native("primary_trend_strength_averages", [*_VOTERS, "_above_averages"], lambda: _strength(True), group=G)
TREND_CLASS = [
    "higher_highs_count", "higher_lows_count", "lower_highs_count", "lower_lows_count", "swing_trend", "swing_trend_quality", "average_trend",
    "average_slope", "average_distance", "oscillator_trend", "oscillator_strength", "oscillator_divergence", "volume_level", "money_flow",
    "volume_agreement", "primary_trend", "primary_trend_strength", "primary_trend_averages", "primary_trend_strength_averages",
]
