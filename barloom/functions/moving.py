"""Moving averages."""

from pyspark.sql import functions as F

from barloom.functions.frames import div, full, lag, rsum, slope, sma, wma
from barloom.functions.registry import Feature, ema, native, register, rma, warm_up
from barloom.operators.blocks import running, trailing

G = "indicator"

native("_cum_close", ["close"], lambda: F.sum("close").over(running()))


def _long_sma(n: int):
    """Long means come from two prefix sums, so their cost does not grow with the frame."""
    native(f"sma_{n}", ["close", "_cum_close"],
           lambda: full("close", n, (F.col("_cum_close") - F.coalesce(lag("_cum_close", n), F.lit(0.0))) / n),
           back=n, group=G)


for _n in (7, 20):
    native(f"sma_{_n}", ["close"], lambda n=_n: sma("close", n), back=_n, group=G)
for _n in (50, 100, 200):
    _long_sma(_n)
for _n in (9, 12, 20, 26, 50, 200):
    ema(f"ema_{_n}", "close", _n, group=G)
native("wma_20", ["close"], lambda: wma("close", 20), back=20, group=G)
rma("smma", "close", 14, group=G)
ema("_ema20_2", "ema_20", 20)
ema("_ema20_3", "_ema20_2", 20)
native("dema", ["ema_20", "_ema20_2"], lambda: 2 * F.col("ema_20") - F.col("_ema20_2"), group=G)
native("tema", ["ema_20", "_ema20_2", "_ema20_3"],
       lambda: 3 * F.col("ema_20") - 3 * F.col("_ema20_2") + F.col("_ema20_3"), group=G)
native("_wma10", ["close"], lambda: wma("close", 10), back=10)
native("_hma_raw", ["_wma10", "wma_20"], lambda: 2 * F.col("_wma10") - F.col("wma_20"))
native("hma", ["_hma_raw"], lambda: wma("_hma_raw", 4), back=4, group=G)
native("lsma", ["close"],
       lambda: full("close", 25, F.avg("close").over(trailing(25)) + slope("close", 25) * 12.0), back=25, group=G)
native("vwma", ["close", "volume"],
       lambda: div(rsum(F.col("close") * F.col("volume"), 20), rsum("volume", 20)), back=20, group=G)

# Efficiency-ratio length and the fast and slow spans of the adaptive mean.
KAMA_ER, KAMA_FAST, KAMA_SLOW = 10, 2, 30
_fast, _slow = 2.0 / (KAMA_FAST + 1), 2.0 / (KAMA_SLOW + 1)
native("_abs_change", ["close"], lambda: F.abs(F.col("close") - lag("close")), back=1)
native("_kama_sc", ["close", "_abs_change"],
       lambda: F.pow(F.coalesce(div(F.abs(F.col("close") - lag("close", KAMA_ER)),
                                    F.sum("_abs_change").over(trailing(KAMA_ER))), F.lit(0.0))
                     * (_fast - _slow) + _slow, 2), back=KAMA_ER)
register(Feature("kama", "ewm", ("close", "_kama_sc"), None, warm_up(_slow**2), alpha="_kama_sc",
                 min_periods=KAMA_ER, group=G))
