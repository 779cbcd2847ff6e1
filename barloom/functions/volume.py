"""Volume indicators."""

from pyspark.sql import functions as F

from barloom.functions.frames import diff, div, flag, lag, pct, rstd, rsum, sma, sma1
from barloom.functions.registry import ema, native, total
from barloom.operators.blocks import running

G = "indicator"

native("_signed_volume", ["_delta", "volume"],
       lambda: F.signum(F.coalesce(F.col("_delta"), F.lit(0.0))) * F.col("volume"))
total("obv", ["_signed_volume"], lambda: F.col("_signed_volume"), group=G)
native("obv_mean", ["obv"], lambda: sma1("obv", 50), back=50, group=G)
native("obv_change", ["obv"], lambda: diff("obv"), back=1, group=G)

native("_clv_volume", ["high", "low", "close", "volume"],
       lambda: F.coalesce(div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")),
                              F.col("high") - F.col("low")), F.lit(0.0)) * F.col("volume"))
native("cmf", ["_clv_volume", "volume"], lambda: div(rsum("_clv_volume", 20), rsum("volume", 20)), back=20, group=G)
native("force_index", ["_delta", "volume"], lambda: F.col("_delta") * F.col("volume"), group=G)
ema("force_index_ema", "force_index", 13, group=G)
native("eom", ["_median_price", "high", "low", "volume"],
       lambda: div(diff("_median_price"), div(F.col("volume") / 1e8, F.col("high") - F.col("low"))), back=1, group=G)
native("eom_sma", ["eom"], lambda: sma("eom", 14), back=14, group=G)
total("vpt", ["_pct1", "volume"], lambda: F.coalesce(F.col("_pct1"), F.lit(0.0)) * F.col("volume"), group=G)

# A product of growth factors is the exponential of a running sum of logarithms.
total("_nvi_log", ["close", "volume"],
      lambda: F.when(diff("volume") < 0, F.ln(F.lit(1.0) + F.coalesce(pct("close"), F.lit(0.0)))).otherwise(0.0))
native("nvi", ["_nvi_log"], lambda: 1000 * F.exp("_nvi_log"), group=G)
total("ad", ["_clv_volume"], lambda: F.col("_clv_volume"), group=G)
# The oscillator is a difference of means, so the block-local running sum serves as well as the full one.
native("_ad_local", ["_clv_volume"], lambda: F.sum("_clv_volume").over(running()))
ema("_ad_e3", "_ad_local", 3)
ema("_ad_e10", "_ad_local", 10)
native("chaikin_osc", ["_ad_e3", "_ad_e10"], lambda: F.col("_ad_e3") - F.col("_ad_e10"), group=G)

native("_flow", ["tp", "volume"], lambda: F.col("tp") * F.col("volume"))
native("_flow_up", ["tp", "_flow"], lambda: F.when(F.col("tp") > lag("tp"), F.col("_flow")).otherwise(0.0), back=1)
native("_flow_down", ["tp", "_flow"], lambda: F.when(F.col("tp") < lag("tp"), F.col("_flow")).otherwise(0.0), back=1)
native("mfi", ["_flow_up", "_flow_down"],
       lambda: 100 * div(rsum("_flow_up", 14), rsum("_flow_up", 14) + rsum("_flow_down", 14)), back=14, group=G)
total("_cum_flow", ["_flow"], lambda: F.col("_flow"))
total("_cum_volume", ["volume"], lambda: F.col("volume"))
native("vwap", ["_cum_flow", "_cum_volume"], lambda: div("_cum_flow", "_cum_volume"), group=G)

native("volume_ma5", ["volume"], lambda: sma("volume", 5), back=5, group=G)
native("volume_decreasing", ["volume", "volume_ma5"], lambda: flag(F.col("volume") < F.col("volume_ma5")), group="state")
native("volume_roc", ["volume"], lambda: pct("volume", 5), back=5, group=G)
native("_vol_mean20", ["volume"], lambda: sma("volume", 20), back=20)
native("volume_zscore", ["volume", "_vol_mean20"],
       lambda: div(F.col("volume") - F.col("_vol_mean20"), rstd("volume", 20)), back=20, group=G)
native("volume_spike", ["volume", "_vol_mean20"], lambda: flag(F.col("volume") > 2 * F.col("_vol_mean20")), group="state")
