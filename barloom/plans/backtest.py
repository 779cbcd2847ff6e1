"""Backtests as aggregates over signal states, and ledgers as verified block scans."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.blocks import BLOCK_ROWS, SERIES, carry, core_rows, number_rows, to_blocks
from barloom.operators.quantiles import grouped_quantiles
from barloom.operators.scan import block_scan

PERIODS = 252 * 24


def directed(ret: Column, side: Column) -> Column:
    """Return in the direction of the trade (side 1 or -1)."""
    return ret * side


def mask_backtest(rows: DataFrame, by: Sequence[str], ret: str = "future_return", side: str = "side") -> DataFrame:
    """Wins, mean win and loss, profit factor of the rows whose side is not 0. Unknown returns count as not won."""
    x = rows.where(F.col(side) != 0).withColumn("_r", directed(F.col(ret), F.col(side)))
    r = F.col("_r")
    gain, loss = F.sum(F.when(r > 0, r)), F.sum(F.when(r <= 0, r))
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signals"), F.sum(F.coalesce((r > 0).cast("int"), F.lit(0))).alias("wins"), F.avg(r).alias("avg_return"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.abs(F.try_divide(gain, loss)).alias("profit_factor")).withColumn("win_rate", F.col("wins") / F.col("signals"))


def with_trend_filter(rows: DataFrame, trend: str = "h_trend_structure", side: str = "side") -> DataFrame:
    """Drops signals against a strong trend of the slow timeframe."""
    against = ((F.col(side) > 0) & (F.col(trend) == "strong_downtrend")) | ((F.col(side) < 0) & (F.col(trend) == "strong_uptrend"))
    return rows.where(~F.coalesce(against, F.lit(False)))


def regime_robustness(rows: DataFrame, by: Sequence[str], regime: str, ret: str = "future_return", side: str = "side", min_n: int = 10) -> DataFrame:
    """Win rate per regime with more than ``min_n`` signals; robustness = mean x (1 - population deviation)."""
    hit = F.coalesce((directed(F.col(ret), F.col(side)) > 0).cast("int"), F.lit(0))
    per = rows.where(F.col(side) != 0).groupBy(*by, regime).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("wr")).where(F.col("n") > min_n)
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("regimes"), F.avg("wr").alias("mean_win_rate"),
                                (F.avg("wr") * (1 - F.stddev_pop("wr"))).alias("robustness"))


def sharpe(mean: Column, std: Column, periods: int = PERIODS) -> Column:
    return F.coalesce(F.try_divide(mean, std), F.lit(0.0)) * math.sqrt(periods)


def walk_forward(rows: DataFrame, state: str, horizons: Sequence[int] = (3, 5, 10), window: int = 500, step: int = 100,
                 cost_bps: float = 5, keys: Sequence[str] = SERIES) -> DataFrame:
    """Out-of-sample metrics per fold, horizon and side; a fold is ``step`` rows after ``window`` rows of history.

    ``rows`` carries ``future_return_<h>`` for every horizon.
    """
    keys = list(keys)
    n = number_rows(rows, keys)
    total = n.groupBy(*keys).agg(F.max("_rn").alias("_n"))
    i = F.col("_rn") - 1
    x = n.join(total, keys).where((i >= window) & (i < F.col("_n") - max(horizons)) & (F.col(state) != 0))
    x = x.withColumn("fold", F.floor((i - window) / step)).where(F.col("fold") * step < F.col("_n") - window - max(horizons))
    x = x.withColumn("h", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"future_return_{h}").alias("r")) for h in horizons])))
    r = (F.col("h.r") - cost_bps / 100.0) * F.col(state)
    x = x.select(*keys, "fold", F.col("h.horizon").alias("horizon"), F.when(F.col(state) > 0, "bull").otherwise("bear").alias("side"), "_rn", r.alias("r"))
    x = x.where("r is not null")
    g = [*keys, "fold", "horizon", "side"]
    # A fold holds at most ``step`` rows, so its running sums stay inside one small window.
    w = Window.partitionBy(*g).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_cum", F.sum("r").over(w))
    x = x.withColumn("_peak", F.max("_cum").over(w))
    dd = F.when(F.col("_peak") == 0, 0.0).otherwise((F.col("_cum") - F.col("_peak")) / F.col("_peak"))
    down = F.when(F.col("r") < 0, F.col("r"))
    few = F.count(F.lit(1)) < 2
    return x.groupBy(*g).agg(
        F.count(F.lit(1)).alias("signals"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"),
        F.when(few, 0.0).otherwise(sharpe(F.avg("r"), F.stddev_pop("r"))).alias("sharpe"),
        F.when(few, 0.0).otherwise(sharpe(F.avg("r"), F.stddev_pop(down))).alias("sortino"), F.min(dd).alias("max_drawdown"))


def running_drawdown(rows: DataFrame, value: str, keys: Sequence[str] = SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``cum`` and ``drawdown`` of a running sum; sums and peaks before a block come from a block table."""
    keys = list(keys)
    b = to_blocks(rows, 0, keys=keys, block_rows=block_rows)
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_c", F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w))
    b = b.withColumn("_m", F.max("_c").over(w))
    wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    t = b.groupBy(*keys, "_blk").agg(F.max_by("_c", "_rn").alias("_s"), F.max("_m").alias("_top"))
    t = t.withColumn("_s0", F.coalesce(F.sum("_s").over(wb), F.lit(0.0)))
    t = t.withColumn("_p0", F.max(F.col("_s0") + F.col("_top")).over(wb)).select(*keys, "_blk", "_s0", "_p0")
    j = core_rows(b.join(t, [*keys, "_blk"]), keep=("_rn",))
    cum = F.col("_s0") + F.col("_c")
    peak = F.greatest(F.col("_p0"), F.col("_s0") + F.col("_m"))
    return j.withColumn("cum", cum).withColumn("drawdown", cum - peak).drop("_c", "_m", "_s0", "_p0")


def comprehensive_metrics(returns: DataFrame, value: str, keys: Sequence[str] = SERIES, order: str = "ts", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Risk-adjusted figures of a return series per key, streaks and tail risk included."""
    keys = list(keys)
    x = returns.where(F.col(value).isNotNull()).select(*keys, order, F.col(value).alias("r"))
    d = running_drawdown(x, "r", keys, block_rows)
    b = to_blocks(d.withColumn("_won", (F.col("r") > 0).cast("int")), 2, keys=keys, block_rows=block_rows)
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn")
    changed = F.coalesce(F.col("_won") != F.lag("_won").over(w), F.lit(True))
    b = b.withColumn("_start", F.when(changed, F.col("_rn")))
    s = core_rows(carry(b, 2, lasts={"_from": F.col("_start")}, keys=keys, block_rows=block_rows), keep=("_rn",)).withColumn("_len", F.col("_rn") - F.col("_from") + 1)
    cut = grouped_quantiles(x, keys, ["r"], [0.05]).select(*keys, F.col("value").alias("var_95"))
    s = s.join(cut, keys)
    periods, rf = 365 * 24, 0.02 / (365 * 24)
    r = F.col("r")
    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(r).alias("total_return"), F.avg(r).alias("avg_return"), F.stddev_pop(r).alias("volatility"),
        F.stddev_pop(F.when(r < 0, r)).alias("_dv"), F.min("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("avg_drawdown"),
        F.avg("_won").alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss"), F.abs(F.try_divide(F.sum(F.when(r > 0, r)), F.sum(F.when(r <= 0, r)))).alias("profit_factor"),
        F.max("var_95").alias("var_95"), F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"),
        F.max(F.when(F.col("_won") == 1, F.col("_len")).otherwise(0)).alias("max_winning_streak"),
        F.max(F.when(F.col("_won") == 0, F.col("_len")).otherwise(0)).alias("max_losing_streak"))
    ex = F.col("avg_return") - rf
    odds = F.try_divide(F.col("avg_win"), F.abs("avg_loss"))
    return g.withColumns({
        "sharpe_ratio": F.coalesce(F.try_divide(ex, F.col("volatility")) * math.sqrt(periods), F.lit(0.0)),
        "sortino_ratio": F.coalesce(F.try_divide(ex, F.col("_dv")) * math.sqrt(periods), F.lit(0.0)),
        "kelly_criterion": F.coalesce(F.when(odds > 0, F.col("win_rate") - F.try_divide(1 - F.col("win_rate"), odds)), F.lit(0.0)),
        "calmar_ratio": F.coalesce(F.try_divide(F.col("avg_return") * periods, F.abs("max_drawdown")), F.lit(0.0)),
    }).drop("_dv")


# ---- ledgers ----
def fixed_fraction_kernel(cost: float, fraction: float, stop: float, take: float):
    """One position at a time. Exits depend on the price ratio only, so the state is (entry price, entry row)."""
    def run(rows: pd.DataFrame, state):
        px, sig, rn = rows["close"].to_numpy(), rows["side"].to_numpy(), rows["_rn"].to_numpy()
        entry, at, side = (0.0, 0.0, 0.0) if state is None else state
        growth = np.full(len(rows), np.nan)
        ep, er = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
        for i in range(len(rows)):
            if entry == 0.0:
                if sig[i] != 0 and px[i] > 0:
                    entry, at, side = px[i], float(rn[i]), float(sig[i])
            else:
                g = fraction * side * (px[i] / entry - 1) - cost
                if g <= -stop or g >= take:
                    growth[i], ep[i], er[i] = g, entry, at
                    entry, at, side = 0.0, 0.0, 0.0
        return {"growth": growth, "entry_price": ep, "entry_row": er}, [entry, at, side]

    return run


def ledger(rows: DataFrame, keys: Sequence[str] = SERIES, capital: float = 10000.0, cost: float = 0.001, fraction: float = 0.1,
           stop: float = 0.02, take: float = 0.04, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Closed trades with the capital after each. ``rows``: keys, ts, close and side (1, -1 or 0)."""
    out = {n: T.DoubleType() for n in ("growth", "entry_price", "entry_row")}
    src = number_rows(rows.select(*keys, "ts", "close", F.col("side").cast("double").alias("side")), keys)
    x = block_scan(src, fixed_fraction_kernel(cost, fraction, stop, take), out, 512, keys, block_rows=block_rows)
    trades = x.where("growth is not null and not isnan(growth)").select(
        *keys, "ts", F.col("entry_row").cast("long").alias("entry_row"), F.col("_rn").alias("exit_row"), "entry_price", F.col("close").alias("exit_price"), "growth")
    b = to_blocks(trades, 16, keys=keys, block_rows=block_rows)
    # A product of factors: logarithms of the sizes, and the parity of the negative ones.
    f = 1 + F.col("growth")
    c = core_rows(carry(b, 16, sums={"_log": F.ln(F.abs(f)), "_neg": (f < 0).cast("long")}, keys=keys, block_rows=block_rows))
    after = capital * F.exp("_log") * F.when(F.col("_neg") % 2 == 0, 1).otherwise(-1)
    return c.withColumn("capital", after).withColumn("pnl", after - F.try_divide(after, 1 + F.col("growth"))).drop("_log", "_neg")


def stop_kernel(rows: pd.DataFrame, state):
    """Enter on a signal with the stop given on that bar; leave at the stop or when the signal turns."""
    px, lo, hi, sig, stop = (rows[c].to_numpy() for c in ("close", "low", "high", "side", "stop"))
    entry, level, side = (0.0, 0.0, 0.0) if state is None else state
    n = len(rows)
    out = {k: np.full(n, np.nan) for k in ("entry_price", "stop_price", "exit_price", "trade_side")}
    for i in range(n):
        if side == 0.0:
            if sig[i] != 0 and stop[i] == stop[i]:
                entry, level, side = px[i], stop[i], float(sig[i])
        else:
            hit = lo[i] <= level if side > 0 else hi[i] >= level
            if hit or sig[i] == -side:
                out["entry_price"][i], out["stop_price"][i], out["trade_side"][i] = entry, level, side
                out["exit_price"][i] = level if hit else px[i]
                entry, level, side = 0.0, 0.0, 0.0
    return out, [entry, level, side]


def stop_ledger(rows: DataFrame, keys: Sequence[str] = SERIES, risk: float = 100.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trades sized so that the distance to the stop costs ``risk``."""
    out = {k: T.DoubleType() for k in ("entry_price", "stop_price", "exit_price", "trade_side")}
    src = rows.select(*keys, "ts", "close", "low", "high", F.col("side").cast("double").alias("side"), "stop")
    x = block_scan(src, stop_kernel, out, 512, keys, block_rows=block_rows).where("exit_price is not null and not isnan(exit_price)")
    qty = F.try_divide(F.lit(risk), F.abs(F.col("entry_price") - F.col("stop_price")))
    return x.select(*keys, "ts", "entry_price", "stop_price", "exit_price", F.col("trade_side").cast("int").alias("side"), qty.alias("quantity"),
                    (qty * (F.col("exit_price") - F.col("entry_price")) * F.col("trade_side")).alias("pnl"))


def regime_aware_comparison(rows: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Base trend signal against one overridden by regime (2 long, 1 out, 0 the trend): total log return and hit rate."""
    base = F.when(F.col("close") > F.col("sma_50"), 1).otherwise(0)
    aware = F.when(F.col("regime") == 2, 1).when(F.col("regime") == 1, 0).otherwise(base)
    r = F.col("log_forward_return")
    x = rows.where("sma_50 is not null and log_forward_return is not null").select(*by, (base * r).alias("b"), (aware * r).alias("a"), base.alias("bs"), aware.alias("as_"))
    return x.groupBy(*by).agg(F.sum("b").alias("base_return"), F.sum("a").alias("aware_return"), F.sum("bs").alias("base_bars"), F.sum("as_").alias("aware_bars"))
