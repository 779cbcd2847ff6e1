"""Oscillators and momentum."""

from pyspark.sql import functions as F

from barloom.functions.frames import diff, div, lag, pct, rmax, rmin, rsum, sma, sma1
from barloom.functions.registry import ema, fill, native, rma
from barloom.operators.blocks import trailing

G = "indicator"

native("_delta", ["close"], lambda: diff("close"), back=1)
native("_gain", ["_delta"], lambda: F.when(F.col("_delta") > 0, F.col("_delta")).otherwise(0.0))
native("_loss", ["_delta"], lambda: F.when(F.col("_delta") < 0, -F.col("_delta")).otherwise(0.0))
for _n, _out in ((14, "rsi"), (30, "rsi_30")):
    rma(f"_gain_{_n}", "_gain", _n)
    rma(f"_loss_{_n}", "_loss", _n)
    native(_out, [f"_gain_{_n}", f"_loss_{_n}"],
           lambda n=_n: 100 * div(f"_gain_{n}", F.col(f"_gain_{n}") + F.col(f"_loss_{n}")), group=G)

# Streak length: distance from the last bar whose direction differs from the bar before it.
native("_dir", ["_delta"], lambda: F.signum(F.coalesce(F.col("_delta"), F.lit(0.0))))
fill("_run_start", ["_dir", "_rn"], lambda: F.when(~F.col("_dir").eqNullSafe(lag("_dir")), F.col("_rn")), back=1)
native("streak", ["_dir", "_run_start", "_rn"],
       lambda: F.col("_dir") * (F.col("_rn") - F.col("_run_start") + 1))
native("_streak_delta", ["streak"], lambda: F.coalesce(diff("streak"), F.lit(0.0)), back=1)
rma("_streak_gain", lambda p: p["_streak_delta"].clip(lower=0), 2, ("_streak_delta",), min_periods=1)
rma("_streak_loss", lambda p: -p["_streak_delta"].clip(upper=0), 2, ("_streak_delta",), min_periods=1)
native("_roc1", ["close"], lambda: pct("close"), back=1)
native("_w", ["_roc1"], lambda: F.collect_list("_roc1").over(trailing(100)), back=100)
native("_roc_rank", ["_roc1", "_w"],
       lambda: F.when(F.col("_roc1").isNotNull(),
                      (F.size(F.filter("_w", lambda x: x < F.col("_roc1")))
                       + (F.size(F.filter("_w", lambda x: x == F.col("_roc1"))) + 1) / F.lit(2.0))
                      / F.size("_w") * 100))
native("connors_rsi", ["rsi", "_streak_gain", "_streak_loss", "_roc_rank"],
       lambda: (F.col("rsi") + 100 * div("_streak_gain", F.col("_streak_gain") + F.col("_streak_loss"))
                + F.col("_roc_rank")) / 3, group=G)

native("_hh14", ["high"], lambda: rmax("high", 14), back=14)
native("_ll14", ["low"], lambda: rmin("low", 14), back=14)
native("stoch_k", ["close", "_hh14", "_ll14"],
       lambda: 100 * div(F.col("close") - F.col("_ll14"), F.col("_hh14") - F.col("_ll14")), group=G)
native("stoch_d", ["stoch_k"], lambda: sma("stoch_k", 3), back=3, group=G)
native("stoch_rsi", ["rsi"],
       lambda: div(F.col("rsi") - rmin("rsi", 14), rmax("rsi", 14) - rmin("rsi", 14)), back=14, group=G)
native("stoch_rsi_k", ["stoch_rsi"], lambda: sma("stoch_rsi", 3) * 100, back=3, group=G)
native("stoch_rsi_d", ["stoch_rsi_k"], lambda: sma("stoch_rsi_k", 3), back=3, group=G)

native("_smi_span", ["_hh14", "_ll14"], lambda: F.col("_hh14") - F.col("_ll14"))
native("_smi_rel", ["close", "_hh14", "_ll14"], lambda: F.col("close") - (F.col("_hh14") + F.col("_ll14")) / 2)
ema("_smi_rel1", "_smi_rel", 3)
ema("_smi_rel2", "_smi_rel1", 3)
ema("_smi_span1", "_smi_span", 3)
ema("_smi_span2", "_smi_span1", 3)


def _smi(p):
    half = p["_smi_span2"] / 2
    return (100 * p["_smi_rel2"] / half.where(half != 0)).where(half.isna() | (half != 0), 0.0)


native("smi", ["_smi_rel2", "_smi_span2"],
       lambda: F.when(F.col("_smi_span2") != 0, 100 * F.col("_smi_rel2") / (F.col("_smi_span2") / 2)).when(
           F.col("_smi_span2") == 0, 0.0), group=G)
ema("smi_signal", _smi, 3, ("_smi_rel2", "_smi_span2"), group=G)
native("smi_ergodic", ["smi"], lambda: F.col("smi"), group=G)
ema("smi_ergodic_signal", _smi, 5, ("_smi_rel2", "_smi_span2"), group=G)

native("williams_r", ["close", "_hh14", "_ll14"],
       lambda: -100 * div(F.col("_hh14") - F.col("close"), F.col("_hh14") - F.col("_ll14")), group=G)
native("roc", ["close"], lambda: pct("close", 10) * 100, back=10, group=G)
native("roc_20", ["close"], lambda: pct("close", 20) * 100, back=20, group=G)
native("_median_price", ["high", "low"], lambda: (F.col("high") + F.col("low")) / 2)
native("ao", ["_median_price"], lambda: sma("_median_price", 5) - sma("_median_price", 34), back=34, group=G)


def _ppo(p):
    return (p["ema_12"] - p["ema_26"]) / p["ema_26"].where(p["ema_26"] != 0) * 100


native("ppo", ["ema_12", "ema_26"], lambda: div(F.col("ema_12") - F.col("ema_26"), "ema_26") * 100, group=G)
ema("ppo_signal", _ppo, 9, ("ema_12", "ema_26"), group=G)
native("ppo_hist", ["ppo", "ppo_signal"], lambda: F.col("ppo") - F.col("ppo_signal"), group=G)
native("ppo_mean", ["ppo"], lambda: F.coalesce(sma1("ppo", 50), F.lit(0.0)), back=50, group=G)

native("_bp", ["close", "low"], lambda: F.col("close") - F.least(F.col("low"), lag("close")), back=1)
native("ultimate_osc", ["_bp", "tr"],
       lambda: 100 * (4 * div(rsum("_bp", 7), rsum("tr", 7)) + 2 * div(rsum("_bp", 14), rsum("tr", 14))
                      + div(rsum("_bp", 28), rsum("tr", 28))) / 7, back=28, group=G)
ema("_tsi_1", "_delta", 25)
ema("_tsi_2", "_tsi_1", 13)
ema("_tsi_a1", lambda p: p["_delta"].abs(), 25, ("_delta",))
ema("_tsi_a2", "_tsi_a1", 13)
native("tsi", ["_tsi_2", "_tsi_a2"], lambda: 100 * div("_tsi_2", "_tsi_a2"), group=G)

native("tp", ["high", "low", "close"], lambda: (F.col("high") + F.col("low") + F.col("close")) / 3)
native("_tp_sma", ["tp"], lambda: sma("tp", 20), back=20)
native("_tp_list", ["tp"], lambda: F.collect_list("tp").over(trailing(20)), back=20)
native("_tp_mad", ["_tp_sma", "_tp_list"],
       lambda: F.aggregate("_tp_list", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_tp_sma"))) / 20)
native("cci", ["tp", "_tp_sma", "_tp_mad"], lambda: div(F.col("tp") - F.col("_tp_sma"), 0.015 * F.col("_tp_mad")), group=G)
native("woodies_cci", ["cci"], lambda: F.col("cci"), group=G)
ema("woodies_cci_signal", "cci", 6, group=G)
native("momentum", ["close"], lambda: F.col("close") - lag("close", 10), back=10, group=G)
native("momentum_pct", ["close"], lambda: (div("close", lag("close", 10)) - 1) * 100, back=10, group=G)
native("bop", ["open", "high", "low", "close"],
       lambda: div(F.col("close") - F.col("open"), F.col("high") - F.col("low")), group=G)
ema("_ema13", "close", 13)
native("bull_power", ["high", "_ema13"], lambda: F.col("high") - F.col("_ema13"), group=G)
native("bear_power", ["low", "_ema13"], lambda: F.col("low") - F.col("_ema13"), group=G)
