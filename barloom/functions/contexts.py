"""Per-bar context of one timeframe: momentum direction, volatility class, regime shares."""

from pyspark.sql import functions as F

from barloom.functions.frames import div
from barloom.functions.registry import native
from barloom.operators.blocks import span, trailing

G = "context"

native("momentum_direction", ["rsi", "_rn"],
       lambda: F.when(F.col("_rn") < 20, "neutral")
       .when((F.avg("rsi").over(trailing(5)) > 55) & (F.avg("rsi").over(trailing(20)) > 50), "bullish")
       .when((F.avg("rsi").over(trailing(5)) < 45) & (F.avg("rsi").over(trailing(20)) < 50), "bearish")
       .otherwise("neutral"), back=20, group=G)
native("_atr_median50", ["atr"], lambda: F.percentile("atr", F.lit(0.5)).over(trailing(50)), back=50)
native("_atr_std50", ["atr"], lambda: F.stddev_samp("atr").over(trailing(50)), back=50)
native("volatility_class", ["atr", "_atr_median50", "_atr_std50", "_rn"],
       lambda: F.when((F.col("_rn") >= 50) & (F.col("atr") > F.col("_atr_median50") + F.col("_atr_std50")), "high_volatility")
       .when((F.col("_rn") >= 50) & (F.col("atr") < F.col("_atr_median50") - F.col("_atr_std50")), "low_volatility")
       .otherwise("normal_volatility"), group=G)
native("volatility_ratio", ["atr", "_atr_median50"], lambda: div("atr", "_atr_median50"), group=G)


def _often(*values):
    parts = [F.sum((F.col("market_structure") == v).cast("int")).over(trailing(20)) > 10 for v in values]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


native("is_trending", ["market_structure"], lambda: _often("strong_trend", "trending"), back=20, group=G)
native("is_ranging", ["market_structure"], lambda: _often("ranging"), back=20, group=G)
native("is_transition", ["trend_structure"],
       lambda: F.size(F.collect_set("trend_structure").over(trailing(20))) >= 3, back=20, group=G)
# Sideways market: average bar range under half a percent of price, or a 20-bar range under one percent.
native("sideways", ["high", "low", "close", "atr_percent_simple"],
       lambda: F.coalesce(F.col("atr_percent_simple") < 0.5, F.lit(False))
       | F.coalesce(div(F.max("high").over(trailing(20)) - F.min("low").over(trailing(20)), "close") * 100 < 1.0, F.lit(False)),
       back=20, group=G)
native("atr_percent_simple", ["tr", "close"],
       lambda: F.when(F.count("tr").over(trailing(14)) == 14, div(F.avg("tr").over(trailing(14)), "close") * 100), back=14, group=G)
native("_bar_range", ["high", "low"], lambda: F.col("high") - F.col("low"))
native("avg_range14", ["_bar_range"],
       lambda: F.when(F.count("_bar_range").over(trailing(14)) == 14, F.avg("_bar_range").over(trailing(14))), back=14, group=G)
_VOL = {"high_volatility": "high_vol", "low_volatility": "low_vol", "normal_volatility": "normal_vol"}


def _bar_regime():
    vol = F.lit("normal_vol")
    for k, v in _VOL.items():
        vol = F.when(F.col("volatility_class") == k, v).otherwise(vol)
    return F.when(F.col("adx") > 25, F.concat(F.lit("strong_trend_"), vol)).when(F.col("adx") > 18, "weak_trend").when(
        F.col("is_transition"), F.concat(F.lit("transition_"), vol)).otherwise(F.concat(F.lit("ranging_"), vol))


native("bar_regime", ["adx", "volatility_class", "is_transition"], _bar_regime, group=G)

# Window features of the last 33 bars: Parkinson volatility and the slope of the scaled closes. A price of 0 has the logarithm
# -infinity, so such windows have an infinite volatility and no slope (NaN).
WINDOW = 33


def _log(price: str):
    p = F.col(price)
    return F.when(p == 0, F.lit(float("-inf"))).when(p < 0, F.lit(float("nan"))).otherwise(F.ln(p))


native("_hl_log2", ["high", "low"], lambda: F.pow(F.when(F.col("low") > 0, F.ln(div("high", "low"))).otherwise(_log("high") - _log("low")), 2))
native("parkinson_vol", ["_hl_log2"],
       lambda: F.when(F.count("_hl_log2").over(trailing(WINDOW)) == WINDOW,
                      F.sqrt(F.avg("_hl_log2").over(trailing(WINDOW)) / F.lit(2.772588722239781)) * 100), back=WINDOW, group=G)
native("_quartiles33", ["close"], lambda: F.percentile("close", F.array(F.lit(0.25), F.lit(0.75))).over(trailing(WINDOW)), back=WINDOW)
native("robust_slope", ["close", "_quartiles33"],
       lambda: F.when(F.count("close").over(trailing(WINDOW)) == WINDOW,
                      div(F.regr_slope("close", F.col("_i").cast("double")).over(trailing(WINDOW)),
                          F.col("_quartiles33")[1] - F.col("_quartiles33")[0]) * 100), back=WINDOW, group=G)
native("log_slope", ["close"],
       lambda: F.when(F.count("close").over(trailing(WINDOW)) == WINDOW,
                      F.regr_slope(_log("close"), F.col("_i").cast("double")).over(trailing(WINDOW)) * 100), back=WINDOW, group=G)
native("_slope10", ["close"], lambda: F.regr_slope("close", F.col("_i").cast("double")).over(span(-5, 4)), back=5, ahead=4)
native("_gradient10", ["_pct_diff"], lambda: F.avg("_pct_diff").over(span(-5, 4)), back=5, ahead=4)
