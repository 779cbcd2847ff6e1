"""Regime-helper features."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from barloom.functions.frames import C, diff, div, flag, lag, rsum, sma, sma1, slope
from barloom.functions.registry import native
from barloom.operators.blocks import trailing

G = "helper"

native("_pct_diff", ["_pct1"], lambda: diff("_pct1"), back=1)
native("return_gradient", ["_pct_diff"], lambda: sma("_pct_diff", 5), back=5, group=G)
native("_up", ["_pct1"], lambda: flag(F.col("_pct1") > 0).cast("double"))
native("directional_persistence", ["_up"], lambda: sma("_up", 10) - 0.5, back=10, group=G)
native("gap_intensity", ["open", "close"], lambda: div(F.abs(F.col("open") - lag("close")), lag("close")), back=1, group=G)
native("extended_bar_ratio", ["high", "low", "atr"], lambda: div(F.col("high") - F.col("low"), "atr"), group=G)

# Pattern names counted over the last five bars.
RECENT = {
    "recent_bullish_patterns": ("pattern_hammer", "pattern_bullish_engulfing", "pattern_morning_star",
                                "pattern_piercing_line", "pattern_inverted_hammer"),
    "recent_bearish_patterns": ("pattern_shooting_star", "pattern_bearish_engulfing", "pattern_evening_star",
                                "pattern_dark_cloud_cover", "pattern_hanging_man"),
    "recent_doji": ("pattern_doji", "pattern_dragonfly_doji", "pattern_gravestone_doji", "pattern_long_legged_doji"),
}
for _name, _parts in RECENT.items():
    native(_name, list(_parts), lambda parts=_parts: rsum(reduce(add, [C(p) for p in parts]), 5), back=5, group=G)

native("_slope5", ["close"],
       lambda: F.when(F.count("close").over(trailing(5)) > 1, slope("close", 5)).otherwise(0.0), back=5)
native("local_slope", ["_slope5"], lambda: sma1("_slope5", 3), back=3, group=G)
