"""Volatility measures and channels."""

import math

from pyspark.sql import functions as F

from barloom.functions.frames import div, pct, rmax, rmin, rstd, rsum, sma1
from barloom.functions.registry import native
from barloom.operators.blocks import bw, trailing

G = "indicator"


def _channel(prefix: str, mid: str, upper, lower, deps, back=0):
    native(f"{prefix}_upper", deps, upper, back=back, group=G)
    native(f"{prefix}_lower", deps, lower, back=back, group=G)
    u, low = f"{prefix}_upper", f"{prefix}_lower"
    native(f"{prefix}_width", [mid, u, low], lambda: div(F.col(u) - F.col(low), mid), group=G)
    native(f"{prefix}_pct", ["close", u, low],
           lambda: div(F.col("close") - F.col(low), F.col(u) - F.col(low)), group=G)


native("bb_middle", ["sma_20"], lambda: F.col("sma_20"), group=G)
native("_bb_std", ["close"], lambda: rstd("close", 20), back=20)
_channel("bb", "bb_middle", lambda: F.col("bb_middle") + 2 * F.col("_bb_std"),
         lambda: F.col("bb_middle") - 2 * F.col("_bb_std"), ["bb_middle", "_bb_std"])
native("bb_bandwidth", ["bb_width"], lambda: F.col("bb_width"), group=G)
# The first frames hold no middle band yet; they take the first value that follows, at most 19 rows on.
native("bb_mean", ["bb_middle"],
       lambda: F.coalesce(sma1("bb_middle", 50),
                          F.first("bb_middle", ignorenulls=True).over(bw().rowsBetween(0, 19)), F.lit(0.0)),
       back=50, ahead=19, group=G)

native("atr_ratio", ["atr", "close"], lambda: F.coalesce(div("atr", "close"), F.lit(0.0)), group=G)
native("atr_mean", ["atr"], lambda: sma1("atr", 100), back=100, group=G)
native("atr_percent", ["atr", "close"], lambda: div("atr", "close") * 100, group=G)
native("low_mean", ["low"], lambda: sma1("low", 50), back=50, group=G)

native("kc_middle", ["ema_20"], lambda: F.col("ema_20"), group=G)
_channel("kc", "kc_middle", lambda: F.col("kc_middle") + 2 * F.col("atr"),
         lambda: F.col("kc_middle") - 2 * F.col("atr"), ["kc_middle", "atr"])
_channel("dc", "dc_middle", lambda: rmax("high", 20), lambda: rmin("low", 20), ["high", "low"], back=20)
native("dc_middle", ["dc_upper", "dc_lower"], lambda: (F.col("dc_upper") + F.col("dc_lower")) / 2, group=G)

native("_peak14", ["close"], lambda: F.max("close").over(trailing(14)), back=14)
native("_dd2", ["close", "_peak14"], lambda: F.pow(div(F.col("close") - F.col("_peak14"), "_peak14") * 100, 2))
native("ulcer_index", ["_dd2"], lambda: F.sqrt(sma1("_dd2", 14)), back=14, group=G)
native("choppiness", ["atr", "_hh14", "_ll14"],
       lambda: 100 * F.log10(div(rsum("atr", 14), F.col("_hh14") - F.col("_ll14"))) / math.log10(14),
       back=14, group=G)
native("_pct1", ["close"], lambda: pct("close"), back=1)
native("normalized_variance", ["_pct1"], lambda: rstd("_pct1", 20), back=20, group=G)
