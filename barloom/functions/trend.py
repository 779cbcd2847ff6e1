"""Trend indicators."""

from pyspark.sql import functions as F

from barloom.functions.frames import (
    diff, div, lag, pct, position_of_first_max, position_of_first_min, rmax, rmin, rsum, sma, sma1,
)
from barloom.functions.registry import ema, native, rma

G = "indicator"

native("macd", ["ema_12", "ema_26"], lambda: F.col("ema_12") - F.col("ema_26"), group=G)
ema("macd_signal", lambda p: p["ema_12"] - p["ema_26"], 9, ("ema_12", "ema_26"), group=G)
native("macd_hist", ["macd", "macd_signal"], lambda: F.col("macd") - F.col("macd_signal"), group=G)
native("macd_mean", ["macd"], lambda: F.coalesce(sma1("macd", 50), F.lit(0.0)), back=50, group=G)

native("tr", ["high", "low", "close"],
       lambda: F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lag("close")),
                          F.abs(F.col("low") - lag("close"))), back=1)
native("_dm_pos", ["high", "low"],
       lambda: F.when((diff("high") > -diff("low")) & (diff("high") > 0), diff("high")).otherwise(0.0), back=1)
native("_dm_neg", ["high", "low"],
       lambda: F.when((-diff("low") > diff("high")) & (-diff("low") > 0), -diff("low")).otherwise(0.0), back=1)
rma("atr", "tr", 14, group=G)
rma("_dm_pos_r", "_dm_pos", 14)
rma("_dm_neg_r", "_dm_neg", 14)


def _dx(p):
    up, down = p["_dm_pos_r"], p["_dm_neg_r"]
    both = (up + down).where(p["atr"] != 0)
    return 100 * (up - down).abs() / both.where(both != 0)


rma("adx", _dx, 14, ("_dm_pos_r", "_dm_neg_r", "atr"), group=G)
native("di_plus", ["_dm_pos_r", "atr"], lambda: div(100 * F.col("_dm_pos_r"), "atr"), group=G)
native("di_minus", ["_dm_neg_r", "atr"], lambda: div(100 * F.col("_dm_neg_r"), "atr"), group=G)

native("aroon_up", ["high"], lambda: position_of_first_max("high", 25) / F.lit(25.0) * 100, back=25, group=G)
native("aroon_down", ["low"], lambda: position_of_first_min("low", 25) / F.lit(25.0) * 100, back=25, group=G)
native("aroon_osc", ["aroon_up", "aroon_down"], lambda: F.col("aroon_up") - F.col("aroon_down"), group=G)


def _mid(n):
    return (rmax("high", n) + rmin("low", n)) / 2


native("ichimoku_conversion", ["high", "low"], lambda: _mid(9), back=9, group=G)
native("ichimoku_base", ["high", "low"], lambda: _mid(26), back=26, group=G)
native("_mid52", ["high", "low"], lambda: _mid(52), back=52)
native("ichimoku_a", ["ichimoku_conversion", "ichimoku_base"],
       lambda: (lag("ichimoku_conversion", 26) + lag("ichimoku_base", 26)) / 2, back=26, group=G)
native("ichimoku_b", ["_mid52"], lambda: lag("_mid52", 26), back=26, group=G)
native("ichimoku_lagging", ["close"], lambda: lag("close", 26), back=26, group=G)

ema("_ema15_1", "close", 15)
ema("_ema15_2", "_ema15_1", 15)
ema("_ema15_3", "_ema15_2", 15)
native("trix", ["_ema15_3"], lambda: pct("_ema15_3") * 100, back=1, group=G)
native("trix_signal", ["trix"], lambda: sma("trix", 9), back=9, group=G)

native("_range", ["high", "low"], lambda: F.col("high") - F.col("low"))
ema("_range_e9", "_range", 9)
ema("_range_e99", "_range_e9", 9)
native("_mass_ratio", ["_range_e9", "_range_e99"], lambda: div("_range_e9", "_range_e99"))
native("mass_index", ["_mass_ratio"], lambda: rsum("_mass_ratio", 25), back=25, group=G)

native("dpo", ["close", "sma_20"], lambda: lag("close", 11) - F.col("sma_20"), back=11, group=G)
for _k in (10, 15, 20, 30):
    native(f"_roc{_k}", ["close"], lambda k=_k: pct("close", k) * 100, back=_k)
native("kst", [f"_roc{k}" for k in (10, 15, 20, 30)],
       lambda: sma("_roc10", 10) + sma("_roc15", 10) * 2 + sma("_roc20", 10) * 3 + sma("_roc30", 15) * 4,
       back=15, group=G)
native("kst_signal", ["kst"], lambda: sma("kst", 9), back=9, group=G)

native("_vm_pos", ["high", "low"], lambda: F.abs(F.col("high") - lag("low")), back=1)
native("_vm_neg", ["high", "low"], lambda: F.abs(F.col("low") - lag("high")), back=1)
native("vortex_pos", ["_vm_pos", "tr"], lambda: div(rsum("_vm_pos", 14), rsum("tr", 14)), back=14, group=G)
native("vortex_neg", ["_vm_neg", "tr"], lambda: div(rsum("_vm_neg", 14), rsum("tr", 14)), back=14, group=G)
native("vortex_diff", ["vortex_pos", "vortex_neg"], lambda: F.col("vortex_pos") - F.col("vortex_neg"), group=G)

for _name, _ema in (("short", "ema_9"), ("medium", "ema_50"), ("long", "ema_200")):
    native(f"trend_{_name}", ["close", _ema],
           lambda e=_ema: F.when(F.col("close") > F.col(e), F.lit(1)).otherwise(F.lit(-1)), group="state")
