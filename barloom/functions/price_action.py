"""Structure, breaks, failures and divergences. Pivots are used only once confirmed by the bars after them."""

from pyspark.sql import functions as F

from barloom.functions.frames import div, flag, lag, rmax, rmin, rstd, sma, sma1, strict_pivot, yes
from barloom.functions.registry import fill, native
from barloom.operators.blocks import span, trailing

G = "action"
K = 5

for _side in ("high", "low"):
    native(f"pa_pivot_{_side}", [_side], lambda s=_side: flag(yes(strict_pivot(s, K, s == "high"))),
           back=K, ahead=K, group="peek")
    native(f"pa_swing_{_side}", [_side], lambda s=_side: flag(_confirmed(s)), back=2 * K, group=G)
    fill(f"pa_level_{_side}", [f"pa_swing_{_side}", _side],
         lambda s=_side: F.when(F.col(f"pa_swing_{s}") == 1, lag(s, K)), back=K, group=G)


def _confirmed(side: str):
    agg = F.max if side == "high" else F.min
    p = lag(side, K)
    after, before = agg(side).over(span(-(K - 1), 0)), agg(side).over(span(-2 * K, -(K + 1)))
    seen = F.count(side).over(span(-2 * K, 0)) == 2 * K + 1
    return seen & ((p > after) & (p > before) if side == "high" else (p < after) & (p < before))


# Twenty-bar frame ending now against the twenty bars before it.
_now, _before = (-20, 0), (-40, -21)


def _extreme(side: str, agg, above: bool):
    v = F.col(side)
    now, past = agg(side).over(span(*_now)), agg(side).over(span(*_before))
    seen = F.count(side).over(span(*_before)) == 20
    return flag(seen & (v == now) & (v > past if above else v < past))


native("higher_highs", ["high"], lambda: _extreme("high", F.max, True), back=40, group=G)
native("higher_lows", ["low"], lambda: _extreme("low", F.max, True), back=40, group=G)
native("lower_highs", ["high"], lambda: _extreme("high", F.min, False), back=40, group=G)
native("lower_lows", ["low"], lambda: _extreme("low", F.min, False), back=40, group=G)
_FOUR = ["higher_highs", "higher_lows", "lower_highs", "lower_lows"]
native("trend_strength", _FOUR,
       lambda: (F.col("higher_highs") + F.col("higher_lows") - F.col("lower_highs") - F.col("lower_lows")) / F.lit(4.0), group=G)
native("hh_ll", _FOUR, lambda: F.when(F.col("higher_highs") == 1, 1).when(F.col("lower_lows") == 1, -1).otherwise(0), group=G)
# Shorter frames for series in which the twenty-bar frames never fire.
native("_hh10", ["high"], lambda: flag(F.col("high") == rmax("high", 10)), back=10)
native("_ll10", ["low"], lambda: flag(F.col("low") == rmin("low", 10)), back=10)
native("_hl10", ["low"], lambda: flag((F.count("low").over(span(-10, -1)) == 10) & (F.col("low") > F.min("low").over(span(-10, -1)))), back=10)
native("_lh10", ["high"], lambda: flag((F.count("high").over(span(-10, -1)) == 10) & (F.col("high") < F.max("high").over(span(-10, -1)))), back=10)

native("momentum_divergence_bullish", ["low", "rsi"],
       lambda: flag((F.count("rsi").over(trailing(11)) == 11) & (F.col("low") < F.min("low").over(span(-10, -1)))
                    & (F.col("rsi") > F.min("rsi").over(span(-10, -1)))), back=11, group=G)
native("momentum_divergence_bearish", ["high", "rsi"],
       lambda: flag((F.count("rsi").over(trailing(11)) == 11) & (F.col("high") > F.max("high").over(span(-10, -1)))
                    & (F.col("rsi") < F.max("rsi").over(span(-10, -1)))), back=11, group=G)
native("volume_breakout", ["volume", "close", "_rn"],
       lambda: flag((F.col("_rn") > 20) & (F.col("volume") > sma1("volume", 20) * 1.3)
                    & (div(F.abs(F.col("close") - lag("close")), lag("close")) > 0.002)), back=20, group=G)
native("volume_divergence", ["volume", "close", "_rn"],
       lambda: flag((F.col("_rn") > 20) & (F.col("close") < lag("close", 5))
                    & (F.avg("volume").over(span(-5, 0)) < F.avg("volume").over(span(-10, -6)) * 0.8)), back=20, group=G)

native("_above50", ["close", "ema_50"], lambda: F.when(yes(F.col("close") > F.col("ema_50")), 1.0).otherwise(0.0))
native("_share_above", ["_above50"], lambda: sma("_above50", 20), back=20)
native("trend_structure", ["_share_above"],
       lambda: F.when(F.col("_share_above") > 0.7, "strong_uptrend").when(F.col("_share_above") >= 0.55, "uptrend")
       .when(F.col("_share_above") < 0.3, "strong_downtrend").when(F.col("_share_above") < 0.45, "downtrend")
       .otherwise("neutral"), group=G)


def _market(lo: int, hi: int):
    return F.when(F.col("adx") > hi, "strong_trend").when(F.col("adx") >= lo, "trending").otherwise("ranging")


native("market_structure", ["adx"], lambda: _market(20, 30), group=G)
native("market_structure_strict", ["adx"], lambda: _market(25, 35), group=G)

native("structure_break_bullish", ["close", "pa_level_high", "volume", "_vol_mean20"],
       lambda: flag((F.col("close") > F.col("pa_level_high")) & (F.col("volume") > F.col("_vol_mean20") * 1.2)), group=G)
native("structure_break_bearish", ["close", "pa_level_low", "volume", "_vol_mean20"],
       lambda: flag((F.col("close") < F.col("pa_level_low")) & (F.col("volume") > F.col("_vol_mean20") * 1.2)), group=G)
native("false_breakout_bullish", ["low", "close", "pa_level_low"],
       lambda: flag((F.col("low") < F.col("pa_level_low")) & (F.col("close") > lag("pa_level_low", 2) * 1.003)), back=2, group=G)
native("false_breakout_bearish", ["high", "close", "pa_level_high"],
       lambda: flag((F.col("high") > F.col("pa_level_high")) & (F.col("close") < lag("pa_level_high", 2) * 0.997)), back=2, group=G)
native("_rsi5", ["rsi"], lambda: sma("rsi", 5), back=5)
native("momentum_continuation", ["_rsi5", "close"],
       lambda: F.when((F.col("_rsi5") > 50) & (F.col("close") > lag("close")), 1)
       .when((F.col("_rsi5") < 50) & (F.col("close") < lag("close")), -1).otherwise(0), back=1, group=G)
native("_range_pct", ["high", "low", "close"], lambda: div(rmax("high", 10) - rmin("low", 10), "close"), back=10)
native("equal_highs_lows", ["_range_pct"], lambda: flag(F.col("_range_pct") < sma("_range_pct", 20) * 0.5), back=20, group=G)
native("swing_failure", ["high", "low", "close", "pa_level_high", "pa_level_low"],
       lambda: F.when((F.col("low") < F.col("pa_level_low")) & (F.col("close") > F.col("pa_level_low")), 1)
       .when((F.col("high") > F.col("pa_level_high")) & (F.col("close") < F.col("pa_level_high")), -1).otherwise(0), group=G)
native("_pct_std20", ["_pct1"], lambda: rstd("_pct1", 20), back=20)


def _volume_confirm():
    strong = (F.col("volume") > F.col("_vol_mean20") * 1.5) & (F.abs("_pct1") > F.col("_pct_std20"))
    return (F.when(strong & (F.col("close") > lag("close")), 1).when(strong & (F.col("close") < lag("close")), -1).otherwise(0))


native("volume_breakout_confirmation", ["volume", "_vol_mean20", "_pct1", "_pct_std20", "close"], _volume_confirm, back=1, group=G)
native("bb_squeeze", ["bb_width"], lambda: flag(F.col("bb_width") < sma("bb_width", 20) * 0.7), back=20, group=G)
native("rsi_extreme", ["rsi"], lambda: flag((F.col("rsi") < 30) | (F.col("rsi") > 70)), group=G)
native("momentum_confirmation", ["macd", "macd_signal"],
       lambda: flag(((F.col("macd") > F.col("macd_signal")) & (F.col("macd") > 0))
                    | ((F.col("macd") < F.col("macd_signal")) & (F.col("macd") < 0))), group=G)
native("volume_price_mismatch", ["close", "volume"],
       lambda: flag((F.count("close").over(trailing(10)) == 10)
                    & ((F.col("close") > lag("close", 9)) != (F.col("volume") > lag("volume", 9)))), back=10, group=G)
native("volume_below_trend", ["volume"], lambda: flag(F.col("volume") < sma("volume", 10) * 0.9), back=10, group=G)
# Simple stand-ins for series that arrive without the full pullback columns.
native("simple_pullback_complete_bull", ["close", "ema_20"],
       lambda: flag((div(F.abs(F.col("close") - F.col("ema_20")), "ema_20") < 0.01) & (F.col("close") > lag("close"))), back=1, group=G)
native("simple_pullback_complete_bear", ["close", "ema_20"],
       lambda: flag((div(F.abs(F.col("close") - F.col("ema_20")), "ema_20") < 0.01) & (F.col("close") < lag("close"))), back=1, group=G)
native("simple_healthy_bull", ["close", "volume"],
       lambda: flag((F.col("close") < lag("close", 5)) & (F.col("volume") < sma("volume", 10))), back=10, group=G)
native("simple_healthy_bear", ["close", "volume"],
       lambda: flag((F.col("close") > lag("close", 5)) & (F.col("volume") < sma("volume", 10))), back=10, group=G)
ACTION = [
    "higher_highs", "higher_lows", "lower_highs", "lower_lows", "trend_strength", "hh_ll", "momentum_divergence_bullish",
    "momentum_divergence_bearish", "volume_breakout", "volume_divergence", "trend_structure", "market_structure",
    "structure_break_bullish", "structure_break_bearish", "false_breakout_bullish", "false_breakout_bearish",
    "momentum_continuation", "equal_highs_lows", "swing_failure", "volume_breakout_confirmation", "bb_squeeze", "rsi_extreme",
    "momentum_confirmation",
]
