"""Running counts that structure alignment compares over timeframes: swings, pullbacks, recent swing order."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.frames import flag, lag, yes
from barloom.functions.registry import native, total
from barloom.operators.blocks import span, trailing

G = "alignment"
# A pullback is a close above the five before it that is two percent lower five bars later; it counts once that is seen.
native("_pullback_seen", ["close", "_rn"],
       lambda: flag((F.col("_rn") >= 16) & yes(lag("close", 5) > F.max("close").over(span(-10, -6))) & yes(F.col("close") < lag("close", 5) * 0.98)), back=10)
total("pullbacks_so_far", ["_pullback_seen"], lambda: F.col("_pullback_seen"), group=G)
total("swings_so_far", ["swing_high", "swing_low"], lambda: F.col("swing_high") + F.col("swing_low"), group=G)
native("swing_strength", ["swings_so_far", "_rn"],
       lambda: F.when(F.col("_rn") < 20, 0.0).otherwise(F.least(F.lit(1.0), F.col("swings_so_far") / F.greatest(F.lit(1), F.floor(F.col("_rn") / 20)))), group=G)


def _ordered(side: str, up: bool) -> Column:
    """The last three swings of a side, each beyond the one before."""
    a, b, c = (F.get(f"{side}_ring", F.lit(i))[side] for i in range(3))
    return (a > b) & (b > c) if up else (a < b) & (b < c)


def _order() -> Column:
    """Of rising and falling order the last one tested holds."""
    return (F.when((F.size("high_ring") < 3) | (F.size("low_ring") < 3), "neutral")
            .when(_ordered("high", False) & _ordered("low", False), "strong_downtrend").when(_ordered("high", False), "weak_downtrend")
            .when(_ordered("high", True) & _ordered("low", True), "strong_uptrend").when(_ordered("high", True), "weak_uptrend").otherwise("neutral"))


native("swing_order", ["high_ring", "low_ring"], _order, group=G)

native("_high_50", ["high"], lambda: F.max("high").over(trailing(50)), back=50)
native("_low_50", ["low"], lambda: F.min("low").over(trailing(50)), back=50)

total("market_structure_run", ["market_structure"],
      lambda: F.when(F.col("market_structure").eqNullSafe(lag("market_structure")), 0).otherwise(1), back=2, group=G)
