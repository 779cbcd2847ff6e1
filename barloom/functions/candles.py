"""Candlestick flags."""

from pyspark.sql import functions as F

from barloom.functions.frames import flag, lag
from barloom.functions.registry import native

G = "candle"

native("_body", ["open", "close"], lambda: F.abs(F.col("close") - F.col("open")))
native("_hl", ["high", "low"], lambda: F.col("high") - F.col("low"))
native("_upper", ["open", "high", "close"], lambda: F.col("high") - F.greatest("open", "close"))
native("_lower", ["open", "low", "close"], lambda: F.least("open", "close") - F.col("low"))
native("_bull", ["open", "close"], lambda: F.col("close") > F.col("open"))
native("_bear", ["open", "close"], lambda: F.col("close") < F.col("open"))
native("_small", ["_body", "_hl"], lambda: F.col("_body") <= 0.25 * F.col("_hl"))

_SHAPE = ["_body", "_hl", "_upper", "_lower", "_bull", "_bear"]


def _shape(name, cond):
    native(f"pattern_{name}", _SHAPE, lambda: flag(cond(*[F.col(c) for c in _SHAPE])), group=G)


_shape("hammer", lambda body, hl, up, lo, bull, bear: (lo > 2 * body) & (up <= body))
_shape("inverted_hammer", lambda body, hl, up, lo, bull, bear: (up > 2 * body) & (lo <= body) & bull)
_shape("hanging_man", lambda body, hl, up, lo, bull, bear: (lo > 2 * body) & (up <= body) & bear)
_shape("shooting_star", lambda body, hl, up, lo, bull, bear: (up > 2 * body) & (lo <= body))
_shape("doji", lambda body, hl, up, lo, bull, bear: body <= 0.1 * hl)
_shape("long_legged_doji", lambda body, hl, up, lo, bull, bear: (body <= 0.1 * hl) & (up >= 0.4 * hl) & (lo >= 0.4 * hl))
_shape("dragonfly_doji", lambda body, hl, up, lo, bull, bear: (body <= 0.1 * hl) & (lo >= 0.6 * hl) & (up <= 0.1 * hl))
_shape("gravestone_doji", lambda body, hl, up, lo, bull, bear: (body <= 0.1 * hl) & (up >= 0.6 * hl) & (lo <= 0.1 * hl))
_shape("marubozu_bull", lambda body, hl, up, lo, bull, bear: bull & (up <= 0.05 * hl) & (lo <= 0.05 * hl))
_shape("marubozu_bear", lambda body, hl, up, lo, bull, bear: bear & (up <= 0.05 * hl) & (lo <= 0.05 * hl))


def _sequence(name, cond):
    native(f"pattern_{name}", ["open", "close", "_bull", "_bear", "_small"], lambda: flag(cond()), back=2, group=G)


def _mid2():
    return (lag("open", 2) + lag("close", 2)) / 2


_sequence("bullish_engulfing", lambda: lag("_bear") & F.col("_bull")
          & (F.col("close") >= lag("open")) & (F.col("open") <= lag("close")))
_sequence("bearish_engulfing", lambda: lag("_bull") & F.col("_bear")
          & (F.col("open") >= lag("close")) & (F.col("close") <= lag("open")))
_sequence("morning_star", lambda: lag("_bear", 2) & lag("_small") & F.col("_bull") & (F.col("close") >= _mid2()))
_sequence("evening_star", lambda: lag("_bull", 2) & lag("_small") & F.col("_bear") & (F.col("close") <= _mid2()))
_sequence("three_white_soldiers", lambda: F.col("_bull") & lag("_bull") & lag("_bull", 2)
          & (F.col("close") > lag("close")) & (lag("close") > lag("close", 2)))
_sequence("three_black_crows", lambda: F.col("_bear") & lag("_bear") & lag("_bear", 2)
          & (F.col("close") < lag("close")) & (lag("close") < lag("close", 2)))

# Pattern columns that exist but are always 0.
PLACEHOLDERS = (
    "belt_hold_bull", "belt_hold_bear", "tweezer_top", "tweezer_bottom", "bullish_harami", "bearish_harami",
    "piercing_line", "dark_cloud_cover", "on_neck", "in_neck", "thrusting", "morning_doji_star",
    "evening_doji_star", "three_inside_up", "three_inside_down", "three_outside_up", "three_outside_down",
    "rising_three_methods", "falling_three_methods", "upside_tasuki_gap", "downside_tasuki_gap",
    "abandoned_baby_bull", "abandoned_baby_bear", "stick_sandwich", "matching_low", "matching_high",
    "ladder_bottom", "counterattack_bull", "counterattack_bear", "breakaway_bull", "breakaway_bear",
    "separating_lines_bull", "separating_lines_bear", "side_by_side_white_lines", "homing_pigeon",
    "doji_star_bull", "doji_star_bear", "rickshaw_man", "kicking_bull", "kicking_bear",
    "kicking_by_length_bull", "kicking_by_length_bear",
)
for _p in PLACEHOLDERS:
    native(f"pattern_{_p}", [], lambda: F.lit(0), group=G)

CANDLES = ("hammer", "inverted_hammer", "hanging_man", "shooting_star", "doji", "long_legged_doji", "dragonfly_doji",
           "gravestone_doji", "marubozu_bull", "marubozu_bear", "bullish_engulfing", "bearish_engulfing",
           "morning_star", "evening_star", "three_white_soldiers", "three_black_crows")
