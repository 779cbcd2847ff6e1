"""Quality of a pullback in an uptrend at every bar: seven parts, weighted score, grade, recommendation, confidence."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.frames import div, flag, lag, yes
from barloom.functions.registry import native
from barloom.functions.swings import FIB
from barloom.operators.blocks import span, trailing

G = "pullback_quality"
# Weights in hundredths, least scores of grades and recommendations, parts that count for confidence.
WEIGHTS = {"depth": 20, "structure": 25, "volume": 15, "momentum": 15, "fibonacci": 10, "time": 10, "risk_reward": 5}
GRADES = {90: "A+", 85: "A", 80: "A-", 75: "B+", 70: "B", 65: "B-", 60: "C+", 55: "C", 50: "C-", 40: "D"}
ADVICE = {80: "high_quality", 70: "good_quality", 60: "moderate_quality", 50: "low_quality"}
CONFIDENT = {"depth": 70, "structure": 70, "volume": 60, "momentum": 70}
LEAST_ROWS = 30
# ---- end of fixed values ----


def ladder(x: Column, table: dict, other) -> Column:
    """The value of the highest threshold that is reached."""
    out = F.lit(other)
    for least in sorted(table):
        out = F.when(x >= least, F.lit(table[least])).otherwise(out)
    return out


def _part(name: str, deps: list[str], build, back: int = 0):
    native(f"pullback_{name}_score", ["_rn", *deps], lambda: F.when(F.col("_rn") < LEAST_ROWS, 0).otherwise(build()).cast("int"), back=back, group=G)


_SWINGS = ["close", "last_swing_high", "last_swing_low"]
native("pullback_retracement", ["_rn", *_SWINGS],
       lambda: F.when((F.col("_rn") >= LEAST_ROWS) & (F.col("last_swing_high") > F.col("last_swing_low")),
                      (F.col("last_swing_high") - F.col("close")) / (F.col("last_swing_high") - F.col("last_swing_low")) * 100).otherwise(0.0), group=G)
_part("depth", [*_SWINGS, "pullback_retracement"],
      lambda: F.when(~yes(F.col("last_swing_high") > F.col("last_swing_low")), 0)
      .when(F.col("pullback_retracement").between(38.2, 61.8), 100).when(F.col("pullback_retracement").between(23.6, 78.6), 75)
      .when(F.col("pullback_retracement") < 23.6, 50).otherwise(25))

_LEVELS = [f"fib_{s}" for s in FIB] + [f"near_fib_{s.replace('_', '')}" for s in FIB]
_MEANS = ["ema_50", "sma_50", "sma_200"]


def _near(level: str, tolerance: float) -> Column:
    return flag(div(F.abs(F.col("close") - F.col(level)), "close") < tolerance)


native("pullback_supports", ["close", *_LEVELS, *_MEANS],
       lambda: sum((_near(c, 0.01) for c in _MEANS), sum((_near(c, 0.005) for c in _LEVELS[1:]), _near(_LEVELS[0], 0.005))), group=G)


def _orderly() -> Column:
    """The range of ten bars, as a share of their low, is under two average ranges as a share of price."""
    high, low = F.max("high").over(trailing(10)), F.min("low").over(trailing(10))
    return flag((F.col("atr") > 0) & (div(div(high - low, low), div("atr", "close")) < 2.0))


native("pullback_orderly", ["high", "low", "close", "atr"], _orderly, back=10, group=G)
native("pullback_breaks_structure", ["close", "low_ring"],
       lambda: flag((F.size("low_ring") >= 2) & (F.col("close") < F.get("low_ring", F.lit(0))["low"])), group=G)
_part("structure", ["pullback_orderly", "pullback_supports", "pullback_breaks_structure"],
      lambda: F.least(F.lit(100), F.greatest(F.lit(0), F.col("pullback_orderly") * 25 + F.col("pullback_supports") * 15 - F.col("pullback_breaks_structure") * 20)))


def _volume() -> Column:
    now, then = F.avg("volume").over(trailing(10)), F.avg("volume").over(span(-19, -10))
    reversal = (F.col("close") > lag("close")) & (F.col("volume") > lag("volume") * 1.2)
    return flag(now < then * 0.8) * 40 + flag((F.col("close") < lag("close", 9)) & (now < then)) * 30 + flag(reversal) * 30


_part("volume", ["volume", "close"], _volume, back=20)


def _momentum() -> Column:
    divergence = (F.col("low") < lag("low", 4)) & (F.col("rsi") > lag("rsi", 4))
    crossing = (F.col("macd") > F.col("macd_signal")) & (lag("macd", 2) <= F.col("macd_signal"))
    k = F.col("stoch_k")
    total = flag(F.col("rsi") < 30) * 25 + flag(divergence) * 35 + flag(crossing) * 40 + flag(k < 20) * 20 + flag((k > 20) & (k < 50)) * 10
    return F.least(F.lit(100), total)


_part("momentum", ["low", "rsi", "macd", "macd_signal", "stoch_k"], _momentum, back=4)
# The level names this part asks for are not those of any column, so it never scores.
_part("fibonacci", [], lambda: F.lit(0))
_part("time", ["bars_since_swing_high"],
      lambda: F.when(F.col("bars_since_swing_high").between(3, 8), 100).when(F.col("bars_since_swing_high").between(2, 12), 75)
      .when(F.col("bars_since_swing_high") == 1, 50).otherwise(25))
native("pullback_reward_ratio", ["_rn", *_SWINGS],
       lambda: F.when((F.col("_rn") >= LEAST_ROWS) & (F.col("last_swing_high") > F.col("last_swing_low")) & (F.col("close") > F.col("last_swing_low")),
                      (F.col("last_swing_high") - F.col("close")) / (F.col("close") - F.col("last_swing_low"))).otherwise(1.0), group=G)
_part("risk_reward", [*_SWINGS, "pullback_reward_ratio"],
      lambda: F.when(yes((F.col("last_swing_high") > F.col("last_swing_low")) & (F.col("close") > F.col("last_swing_low"))),
                     ladder(F.col("pullback_reward_ratio"), {3.0: 100, 2.0: 80, 1.5: 60, 1.0: 40}, 20)).otherwise(0))

_PARTS = [f"pullback_{p}_score" for p in WEIGHTS]
native("pullback_overall", _PARTS,
       lambda: F.bround(sum((F.col(f"pullback_{p}_score") * w for p, w in list(WEIGHTS.items())[1:]), F.col("pullback_depth_score") * WEIGHTS["depth"]) / 100.0, 1), group=G)
# Depth and reward are judged in uptrends only, so in a downtrend the other five parts make the score.
native("pullback_overall_bearish", _PARTS,
       lambda: F.bround(sum((F.col(f"pullback_{p}_score") * w for p, w in WEIGHTS.items() if p not in ("depth", "risk_reward")), F.lit(0)) / 100.0, 1), group=G)
native("pullback_grade", ["pullback_overall"], lambda: ladder(F.col("pullback_overall"), GRADES, "F"), group=G)
native("pullback_recommendation", ["pullback_overall"], lambda: ladder(F.col("pullback_overall"), ADVICE, "avoid"), group=G)
# Four of seven parts are looked at, so a high confidence (0.7 of seven) is never reached.
native("pullback_confidence", _PARTS,
       lambda: ladder(sum((flag(F.col(f"pullback_{p}_score") >= n) for p, n in CONFIDENT.items()), F.lit(0)), {4: "medium", 5: "high"}, "low"), group=G)
PULLBACK_QUALITY = [*_PARTS, "pullback_retracement", "pullback_supports", "pullback_reward_ratio", "pullback_overall", "pullback_grade",
                    "pullback_recommendation", "pullback_confidence"]
