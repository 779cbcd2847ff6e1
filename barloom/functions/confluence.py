"""Parts of a confluence score that one timeframe gives on its own, for a direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.frames import div, flag, lag, sma, yes
from barloom.functions.registry import REGISTRY, native
from barloom.operators.blocks import span, trailing

G = "confluence"
SIDES = {"bullish": 1, "bearish": -1}


def _volume(d: int) -> Column:
    mean = sma("volume", 20)
    recent, before = F.avg("volume").over(trailing(5)), F.avg("volume").over(span(-9, -5))
    level = F.when(F.col("volume") > mean * 1.2, 0.4).when(F.col("volume") > mean, 0.2).otherwise(0.0)
    moved = (F.col("_rn") >= 10) & (recent > before if d > 0 else recent < before)
    return F.least(F.lit(1.0), level + flag(moved) * 0.3 + flag(F.col("volume_breakout_confirmation") > 0) * 0.3)


def _rsi(d: int) -> Column:
    mild, far = (F.col("rsi") > 30) & (F.col("rsi") < 70), F.col("rsi") > 50 if d > 0 else F.col("rsi") < 50
    return F.when(mild, 0.7).when(far, 0.9).otherwise(0.3)


def _macd(d: int) -> Column:
    return F.when(F.col("macd") > F.col("macd_signal") if d > 0 else F.col("macd") < F.col("macd_signal"), 0.8).otherwise(0.3)


def _regime() -> Column:
    mean = sma("atr", 20)
    volatility = F.when((F.col("atr") > mean * 1.3) | (F.col("atr") < mean * 0.7), 0.3).otherwise(0.5)
    return volatility + F.when(F.col("adx") > 25, 0.4).when(F.col("adx") > 20, 0.6).otherwise(0.3)


for _name, _d in SIDES.items():
    native(f"conf_volume_{_name}", ["volume", "volume_breakout_confirmation", "_rn"], lambda d=_d: _volume(d), back=20, group=G)
    native(f"conf_rsi_{_name}", ["rsi"], lambda d=_d: _rsi(d), group=G)
    native(f"conf_macd_{_name}", ["macd", "macd_signal"], lambda d=_d: _macd(d), group=G)
    native(f"conf_direction_{_name}", ["close", "_rn"],
           lambda d=_d: F.when(F.col("_rn") < 10, 0.5).when(yes((F.col("close") - lag("close", 9)) * d > 0), 0.8).otherwise(0.3), back=9, group=G)
# A trend-structure column these frames do not have would add three tenths.
native("conf_structure", ["swing_high", "swing_low", "equal_highs_lows"],
       lambda: flag(F.sum(F.col("swing_high") + F.col("swing_low")).over(trailing(20)).between(3, 8)) * 0.4 + flag(F.sum("equal_highs_lows").over(trailing(10)) >= 2) * 0.3,
       back=20, group=G)
native("conf_regime", ["atr", "adx"], lambda: F.least(F.lit(1.0), _regime()), back=20, group=G)
native("conf_volatility", ["atr", "close"], lambda: div("atr", "close"), group=G)


def _strength(signal: str, d: int) -> Column:
    v = F.col(signal)
    if "rsi" in signal:
        return F.when(v < 40, 0.8 - v / 100).otherwise(0.5) if d > 0 else F.when(v > 60, v / 100 - 0.4).otherwise(0.5)
    if "macd" in signal:
        return F.coalesce(F.least(F.lit(0.9), F.abs(v - F.col("macd_signal")) * 10), F.lit(0.9))
    if "bb" in signal:
        return F.when(F.abs(v) > 0.8, 0.8).when(F.abs(v) > 0.5, 0.6).otherwise(0.5)
    if any(p in signal for p in ("swing", "breakout", "divergence")):
        return F.when(v != 0, 0.7 + F.abs(v) * 0.3).otherwise(0.5)
    return F.lit(0.5)


def signal_features(signal: str, direction: str) -> tuple[str, str, str]:
    """Names of three features of a numeric signal: how strong it is, how steadily it had the sign, whether it has it now."""
    d = SIDES[direction]
    names = (f"conf_strength_{direction}_{signal}", f"conf_steady_{direction}_{signal}", f"conf_active_{direction}_{signal}")
    if names[0] not in REGISTRY:
        deps = [signal, "macd_signal"] if "macd" in signal else [signal]
        native(names[0], deps, lambda: _strength(signal, d), group=G)
        native(names[1], [signal, "_rn"],
               lambda: F.when(F.col("_rn") < 10, 0.3).otherwise(F.sum(flag(F.col(signal) * d > 0)).over(trailing(10)) / 10.0), back=10, group=G)
        native(names[2], [signal], lambda: flag(F.col(signal) * d > 0), group=G)
    return names
