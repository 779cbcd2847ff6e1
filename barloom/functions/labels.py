"""Forward labels. These look ahead by design and never feed a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import lead
from barloom.functions.registry import native
from barloom.operators.blocks import span

# Default horizon in bars, and the move in percent that counts as a direction.
HORIZON, THRESHOLD_PCT = 5, 0.005
HORIZONS = (1, 3, 5, 10, 24, 72, 168)

for _h in HORIZONS:
    native(f"future_return_{_h}", ["close"],
           lambda h=_h: F.when(lead("close", h).isNull(), None).when(F.col("close") == 0, 0.0).otherwise(
               (F.try_divide(lead("close", h), F.col("close")) - 1) * 100), ahead=_h, group="label")
    native(f"price_state_{_h}", [f"future_return_{_h}"],
           lambda h=_h: F.when(F.col(f"future_return_{h}").isNull(), "unknown")
           .when(F.col(f"future_return_{h}") > THRESHOLD_PCT, "bullish")
           .when(F.col(f"future_return_{h}") < -THRESHOLD_PCT, "bearish").otherwise("neutral"), group="label")
native("log_forward_return", ["close"], lambda: F.ln(F.try_divide(lead("close"), F.col("close"))), ahead=1, group="label")
native("abs_log_forward_return", ["log_forward_return"], lambda: F.abs("log_forward_return"), group="label")
native("_fwd_high_24", ["high"], lambda: F.max("high").over(span(0, 23)), ahead=24)
native("_fwd_low_24", ["low"], lambda: F.min("low").over(span(0, 23)), ahead=24)
native("max_favorable_excursion_1d", ["close", "_fwd_high_24"],
       lambda: F.try_divide(F.col("_fwd_high_24") - F.col("close"), F.col("close")) * 100, group="label")
native("max_adverse_excursion_1d", ["close", "_fwd_low_24"],
       lambda: F.try_divide(F.col("_fwd_low_24") - F.col("close"), F.col("close")) * 100, group="label")


def known_returns(df: DataFrame) -> DataFrame:
    """The same rows with unknown forward returns at closes of 0, where the labels themselves say 0."""
    return df.withColumns({c: F.when(F.col("close") != 0, F.col(c)) for c in df.columns if c.startswith("future_return_")})


# Swing labels: extremes of the five bars either side (ties allowed), 2 % from one pivot to the next.
ORDER, SWING_PCT = 5, 0.02
_hi = (-ORDER, ORDER)
native("_extreme_close", ["close"],
       lambda: (F.col("close") == F.max("close").over(span(*_hi))) | (F.col("close") == F.min("close").over(span(*_hi))),
       back=ORDER, ahead=ORDER)
