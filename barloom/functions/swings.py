"""Confirmed swings, pullbacks and retracement levels per bar."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from barloom.functions.frames import div, flag, lag, strict_pivot
from barloom.functions.registry import fill, native
from barloom.operators.blocks import span, trailing

G = "swing"
LOOKBACK = 2

# Pivot lookback recommended per timeframe (2 when unknown).
LOOKBACK_BY_TIMEFRAME = {"1m": 1, "5m": 2, "15m": 2, "1h": 3, "4h": 3}
# Retracement ratios by column suffix.
FIB = {"23_6": 0.236, "38_2": 0.382, "50_0": 0.500, "61_8": 0.618, "78_6": 0.786}

native("_pivot_high", ["high"], lambda: strict_pivot("high", LOOKBACK, True), back=LOOKBACK, ahead=LOOKBACK)
native("_pivot_low", ["low"], lambda: strict_pivot("low", LOOKBACK, False), back=LOOKBACK, ahead=LOOKBACK)
for _side in ("high", "low"):
    # A confirmed swing is flagged LOOKBACK bars after the pivot, so nothing from the future is used.
    native(f"swing_{_side}", [_side],
           lambda s=_side: flag(_confirmed(s)), back=2 * LOOKBACK, group=G)
    fill(f"last_swing_{_side}", [f"swing_{_side}", _side],
         lambda s=_side: F.when(F.col(f"swing_{s}") == 1, F.col(s)), group=G)
    fill(f"_swing_{_side}_rn", [f"swing_{_side}", "_rn"],
         lambda s=_side: F.when(F.col(f"swing_{s}") == 1, F.col("_rn")))
    native(f"bars_since_swing_{_side}", [f"_swing_{_side}_rn", "_rn"],
           lambda s=_side: F.coalesce(F.col("_rn") - F.col(f"_swing_{s}_rn"), F.col("_rn") - 1 + 9999), group=G)
    native(f"pullback_from_{_side}_pct", ["close", f"last_swing_{_side}"],
           lambda s=_side: div(F.col("close") - F.col(f"last_swing_{s}"), f"last_swing_{s}") * 100, group=G)


def _confirmed(side: str):
    pivot = lag(side, LOOKBACK)
    agg = F.max if side == "high" else F.min
    after, before = span(-(LOOKBACK - 1), 0), span(-2 * LOOKBACK, -(LOOKBACK + 1))
    seen = F.count(side).over(span(-2 * LOOKBACK, 0)) == 2 * LOOKBACK + 1
    a, b = agg(side).over(after), agg(side).over(before)
    return seen & ((pivot > a) & (pivot > b) if side == "high" else (pivot < a) & (pivot < b))


native("_swing_range", ["last_swing_high", "last_swing_low"], lambda: F.col("last_swing_high") - F.col("last_swing_low"))
for _s, _r in FIB.items():
    native(f"fib_{_s}", ["last_swing_high", "_swing_range"],
           lambda r=_r: F.col("last_swing_high") - F.col("_swing_range") * r, group=G)
    native(f"near_fib_{_s.replace('_', '')}", ["close", f"fib_{_s}"],
           lambda s=_s: flag(div(F.abs(F.col("close") - F.col(f"fib_{s}")), "close") < 0.005), group=G)

native("pullback_depth", ["pullback_from_high_pct"],
       lambda: F.when(F.col("pullback_from_high_pct") < -10, "deep")
       .when(F.col("pullback_from_high_pct").between(-10, -5), "moderate")
       .when(F.col("pullback_from_high_pct").between(-5, -1), "shallow").otherwise("none"), group=G)


def _last_three(side: str):
    """The last three confirmed swing prices within 51 bars."""
    seen = F.collect_list(F.when(F.col(f"swing_{side}") == 1, F.col(side))).over(trailing(51))
    return F.when(F.size(seen) >= 3, F.slice(seen, -3, 3))


native("_lows3", ["swing_low", "low"], lambda: _last_three("low"), back=51)
native("_highs3", ["swing_high", "high"], lambda: _last_three("high"), back=51)
native("higher_lows_pattern", ["_lows3", "trend_medium", "_rn"],
       lambda: flag((F.col("_rn") > 20) & (F.col("_lows3")[1] > F.col("_lows3")[0])
                    & (F.col("_lows3")[2] > F.col("_lows3")[1]) & (F.col("trend_medium") == 1)), group=G)
native("lower_highs_pattern", ["_highs3", "trend_medium", "_rn"],
       lambda: flag((F.col("_rn") > 20) & (F.col("_highs3")[1] < F.col("_highs3")[0])
                    & (F.col("_highs3")[2] < F.col("_highs3")[1]) & (F.col("trend_medium") == -1)), group=G)

for _name, _ma in (("ema9", "ema_9"), ("ema20", "ema_26"), ("sma50", "sma_50")):
    native(f"pullback_to_{_name}", ["close", _ma],
           lambda m=_ma: flag(div(F.abs(F.col("close") - F.col(m)), m) < 0.01), group=G)

native("_rsi_mid", ["rsi"], lambda: (F.col("rsi") > 40) & (F.col("rsi") < 60))
native("healthy_bull_pullback", ["trend_medium", "_rsi_mid", "close"],
       lambda: flag((F.col("trend_medium") == 1) & F.col("_rsi_mid") & (F.col("close") < lag("close"))), back=1, group=G)
native("healthy_bear_pullback", ["trend_medium", "_rsi_mid", "close"],
       lambda: flag((F.col("trend_medium") == -1) & F.col("_rsi_mid") & (F.col("close") > lag("close"))), back=1, group=G)

# A-B-C shape inside 21 bars: an extreme A with more than five bars after it, the opposite extreme B after A
# with at least three bars left, and a C that stays beyond A by half a percent.
ABC = 21


def _abc(near: str, far: str, low_first: bool):
    nl, fl = F.col(f"_{near}_21"), F.col(f"_{far}_21")
    ext, opp = (F.array_min, F.array_max) if low_first else (F.array_max, F.array_min)
    a = ext(nl)
    pos_a = F.array_position(nl, a)
    left = F.lit(ABC) - pos_a + 1
    after_a = F.slice(fl, pos_a, left)
    pos_b = F.array_position(after_a, opp(after_a))
    from_b = F.slice(nl, pos_a + pos_b - 1, left - pos_b + 1)
    c = ext(from_b)
    beyond = c > a * 1.005 if low_first else c < a * 0.995
    room = (pos_a - 1 < ABC - 5) & (pos_b - 1 < left - 2)
    return flag((F.size(nl) == ABC) & room & beyond)


native("_low_21", ["low"], lambda: F.collect_list("low").over(trailing(ABC)), back=ABC)
native("_high_21", ["high"], lambda: F.collect_list("high").over(trailing(ABC)), back=ABC)
native("abc_pullback_bull", ["_low_21", "_high_21"], lambda: _abc("low", "high", True), group=G)
native("abc_pullback_bear", ["_low_21", "_high_21"], lambda: _abc("high", "low", False), group=G)

native("pullback_quality_score",
       ["trend_short", "trend_medium", "trend_long", "pullback_from_high_pct", "volume_decreasing", "_rsi_mid"],
       lambda: flag((F.col("trend_short") == F.col("trend_medium")) & (F.col("trend_medium") == F.col("trend_long"))) * 30
       + flag(F.col("pullback_from_high_pct").between(-12, -3)) * 30
       + F.col("volume_decreasing") * 20 + flag(F.col("_rsi_mid")) * 20, group=G)


def _near(level: str):
    return flag(div(F.abs(F.col("close") - F.col(level)), "close") < 0.01)


_LEVELS = ("ema_9", "ema_26", "sma_50", "last_swing_low")
_NEAR = ("near_fib_382", "near_fib_500", "near_fib_618")
native("sr_confluence_score", ["close", *_LEVELS, *_NEAR],
       lambda: reduce(add, [_near(x) for x in _LEVELS] + [F.col(n) for n in _NEAR]), group=G)

_DONE = ["trend_medium", "pullback_quality_score", "rsi", "sr_confluence_score", "volume_decreasing", "open", "close"]


def _complete(trend: int):
    toward = F.col("close") > F.col("open") if trend > 0 else F.col("close") < F.col("open")
    side = F.col("rsi") < 50 if trend > 0 else F.col("rsi") > 50
    return flag((F.col("trend_medium") == trend) & (F.col("pullback_quality_score") >= 50) & side
                & (F.col("sr_confluence_score") >= 2) & (F.col("volume_decreasing") == 1) & toward)


native("pullback_complete_bull", _DONE, lambda: _complete(1), group=G)
native("pullback_complete_bear", _DONE, lambda: _complete(-1), group=G)
native("failed_pullback_bull", ["trend_medium", "close", "last_swing_low", "volume", "volume_ma5"],
       lambda: flag((F.col("trend_medium") == 1) & (F.col("close") < F.col("last_swing_low"))
                    & (F.col("volume") > F.col("volume_ma5"))), group=G)
native("failed_pullback_bear", ["trend_medium", "close", "last_swing_high", "volume", "volume_ma5"],
       lambda: flag((F.col("trend_medium") == -1) & (F.col("close") > F.col("last_swing_high"))
                    & (F.col("volume") > F.col("volume_ma5"))), group=G)

native("measured_move_bull_target", ["last_swing_high", "_swing_range"],
       lambda: F.col("last_swing_high") + F.col("_swing_range"), group=G)
native("measured_move_bear_target", ["last_swing_low", "_swing_range"],
       lambda: F.col("last_swing_low") - F.col("_swing_range"), group=G)
native("distance_to_bull_target_pct", ["measured_move_bull_target", "close"],
       lambda: div(F.col("measured_move_bull_target") - F.col("close"), "close") * 100, group=G)
native("distance_to_bear_target_pct", ["measured_move_bear_target", "close"],
       lambda: div(F.col("close") - F.col("measured_move_bear_target"), "close") * 100, group=G)


def _stage():
    """Later checks override earlier ones: completion, then pullback age and depth, then impulse."""
    up, down = F.col("trend_medium") == 1, F.col("trend_medium") == -1
    falling = up & (F.col("close") < lag("close"))
    age, depth = F.col("bars_since_swing_high"), F.abs("pullback_from_high_pct")
    known = F.col("_rn") > 10
    return (
        F.when(~known, "neutral")
        .when(F.col("pullback_complete_bull") == 1, "resumption_bull")
        .when(F.col("pullback_complete_bear") == 1, "resumption_bear")
        .when(falling & (age <= 3), "pullback_early")
        .when(falling & (age <= 7) & (depth < 8), "pullback_mid")
        .when(falling & (depth >= 5), "pullback_late")
        .when(up & (F.col("close") > lag("close", 10) * 1.03), "impulse_up")
        .when(down & (F.col("close") < lag("close", 10) * 0.97), "impulse_down")
        .otherwise("neutral")
    )


native("pullback_stage", ["_rn", "close", "trend_medium", "bars_since_swing_high", "pullback_from_high_pct",
                          "pullback_complete_bull", "pullback_complete_bear"], _stage, back=10, group=G)
