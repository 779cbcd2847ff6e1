"""Stop and target plans for every entry at once, trailing stops, position size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.registry import compute
from barloom.operators.asof import asof_join
from barloom.operators.blocks import BLOCK_ROWS, SERIES, core_rows, number_rows, to_blocks
from barloom.operators.scan import block_scan
from barloom.session import cut_lineage

# Stop and target multiples of the average range by regime.
REGIME_MULTIPLES = {
    "strong_trend_high_vol": (2.5, 4.0), "strong_trend_normal_vol": (2.0, 3.0), "ranging_high_vol": (1.0, 1.5),
    "ranging_normal_vol": (1.5, 2.0), "transition": (0.8, 5.0), "default": (1.5, 2.5),
}


def recent_levels(bars: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(pair, side, ts, levels): the newest k confirmed pivot prices, one row per pivot."""
    f = compute(bars, [f"pa_{x}_{s}" for s in ("low", "high") for x in ("swing", "level")], block_rows)
    sides = F.array_compact(F.array(*[
        F.when(F.col(f"pa_swing_{s}") == 1, F.struct(F.lit(n).alias("side"), F.col(f"pa_level_{s}").alias("v"))) for s, n in (("low", "sup"), ("high", "res"))]))
    keys = [*SERIES, "side"]
    flagged = cut_lineage(f.select(*SERIES, "ts", F.explode(sides).alias("p")).select(*SERIES, "ts", "p.*"))
    p = to_blocks(number_rows(flagged, keys), k, keys=keys, block_rows=max(block_rows, k))
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(-(k - 1), 0)
    return core_rows(p.withColumn("levels", F.collect_list("v").over(w))).select("pair", "side", "ts", "levels")


def entries_with_levels(entries: DataFrame, bars: DataFrame, k: int, prefix: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Entries (pair, ts, entry) with the supports and resistances known at their time."""
    levels = cut_lineage(recent_levels(bars, k, block_rows))
    for side in ("sup", "res"):
        right = levels.where(F.col("side") == side).drop("side")
        entries = asof_join(entries, right, ["pair"], "ts", "ts", f"{prefix}{side}_").drop(f"{prefix}{side}_ts")
    return cut_lineage(entries)


def nearest(levels: str, entry: Column, below: bool, otherwise: Column) -> Column:
    pick = F.array_max(F.filter(levels, lambda x: x < entry)) if below else F.array_min(F.filter(levels, lambda x: x > entry))
    return F.coalesce(pick, otherwise)


PLACES = 4


def _plan(method, sl: Column, tp: Column) -> Column:
    name = F.lit(method) if isinstance(method, str) else method
    return F.struct(name.alias("method"), sl.alias("sl"), tp.alias("tp"))


def swing_plan(e: Column, prefix: str = "") -> Column:
    return _plan("swing", nearest(f"{prefix}sup_levels", e, True, e * 0.98) * 0.995, nearest(f"{prefix}res_levels", e, False, e * 1.02) * 0.995)


def hierarchical_plan(e: Column, bullish: bool = True) -> Column:
    """Stop from the slow level unless the fast one is within 1 % of it; target from the trading timeframe."""
    if bullish:
        h = nearest("h_sup_levels", e, True, e * 0.97)
        low = nearest("l_sup_levels", e, True, h)
        sl = F.when(F.coalesce(F.try_divide(F.abs(low - h), h) < 0.01, h == 0), low).otherwise(h) * 0.995
        return _plan("hierarchical", sl, nearest("t_res_levels", e, False, e * 1.03) * 0.995)
    h = nearest("h_res_levels", e, False, e * 1.03)
    low = nearest("l_res_levels", e, False, h)
    sl = F.when(F.try_divide(F.abs(low - h), h) < 0.01, low).otherwise(h) * 1.005
    return _plan("hierarchical", sl, nearest("t_sup_levels", e, True, e * 0.97) * 1.005)


def regime_plan(e: Column, regime: Column, avg_range: Column) -> Column:
    a = F.coalesce(avg_range, e * 0.02)
    mult = lambda i: F.coalesce(F.create_map(*[F.lit(x) for k, v in REGIME_MULTIPLES.items() for x in (k, v[i])])[regime],
                                F.lit(REGIME_MULTIPLES["default"][i]))
    return _plan(F.concat(F.lit("regime_"), regime), e - a * mult(0), e + a * mult(1))


def range_plan(e: Column, range14: Column, sl: float = 1.5, tp: float = 2.5) -> Column:
    return _plan("range_atr", e - range14 * sl, e + range14 * tp)


def average_plan(e: Column, ma: Column) -> Column:
    return _plan("moving_average", ma * 0.99, e + (e - ma * 0.99) * 2)


def fibonacci_plan(e: Column, fib_low: Column, ext1: Column, ext2: Column) -> Column:
    return _plan("fibonacci", fib_low * 0.995, F.when(F.abs(ext1 - e) < F.abs(ext2 - e), ext1).otherwise(ext2))


def validate(plans: DataFrame, min_rr: float = 2.0) -> DataFrame:
    """Long rows (entry, method, sl, tp) with the reward to risk ratio and whether it suffices."""
    rr = F.coalesce(F.try_divide(F.abs(F.col("tp") - F.col("entry")), F.abs(F.col("entry") - F.col("sl"))), F.lit(0.0))
    return plans.withColumn("rrr", F.round(rr, 2)).withColumn("valid", rr >= min_rr).withColumns(
        {c: F.round(c, PLACES) for c in ("sl", "tp")})


def best_plan(plans: DataFrame, by: Sequence[str]) -> DataFrame:
    """The hierarchical plan where it exists, else the one with the highest ratio."""
    order = F.struct((F.col("method") == "hierarchical").alias("h"), F.col("rrr"), F.col("method"))
    return plans.where("sl is not null and tp is not null").groupBy(*by).agg(F.max_by(F.struct("method", "sl", "tp", "rrr", "valid"), order).alias("_b")).select(*by, "_b.*")


def raw_plans(bars: DataFrame, regime: str = "default", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All single-timeframe plans for every bar taken as an entry at its close, unrounded."""
    f = compute(bars, ["sma_50", "fib_61_8", "last_swing_low", "_swing_range", "_hh14", "_ll14", "avg_range14"], block_rows)
    cols = ["pair", "timeframe", "ts", F.col("close").alias("entry"), "sma_50", "fib_61_8", "avg_range14", (F.col("_hh14") - F.col("_ll14")).alias("range14"),
            (F.col("last_swing_low") + F.col("_swing_range") * 1.272).alias("ext1"), (F.col("last_swing_low") + F.col("_swing_range") * 1.618).alias("ext2")]
    x = entries_with_levels(f.select(*cols), bars, 50, "", block_rows)
    e = F.col("entry")
    plans = F.array(swing_plan(e), regime_plan(e, F.lit(regime), F.col("avg_range14")), range_plan(e, F.col("range14")), average_plan(e, F.col("sma_50")),
                    fibonacci_plan(e, F.col("fib_61_8"), F.col("ext1"), F.col("ext2")))
    return x.select("pair", "timeframe", "ts", "entry", F.explode(plans).alias("p")).select("pair", "timeframe", "ts", "entry", "p.*")


def plan_entries(bars: DataFrame, regime: str = "default", min_rr: float = 2.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return validate(raw_plans(bars, regime, block_rows), min_rr)


def trailing_settings(price: Column, atr: Column) -> dict[str, Column]:
    """Mode, distance and decimals of a trailing stop from the price level and the average range."""
    decimals = F.when(price >= 1000, 2).when(price >= 1, 4).otherwise(6)
    mode = F.when(atr.isNotNull() & (atr > 0), "atr").otherwise("percent")
    return {"mode": mode, "distance": F.when(mode == "atr", atr * 2.0).otherwise(price * 0.01), "decimals": decimals}


def chandelier(price: str, atr: str, keys: Sequence[str], k: float = 3.0, long: bool = True, block_rows: int = BLOCK_ROWS):
    """Stop k average ranges off the best price since entry: a running extreme, carried across blocks."""
    def run(df: DataFrame) -> DataFrame:
        b = to_blocks(df, 0, keys=keys, block_rows=block_rows)
        agg = F.max if long else F.min
        w = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
        b = b.withColumn("_x", agg(price).over(w))
        wb = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
        t = b.groupBy(*keys, "_blk").agg(agg(price).alias("_e")).withColumn("_before", agg("_e").over(wb)).drop("_e")
        best = (F.greatest if long else F.least)(F.col("_x"), F.col("_before"))
        j = core_rows(b.join(t, [*keys, "_blk"])).withColumn("best_price", best)
        return j.withColumn("stop", F.col("best_price") - (k if long else -k) * F.col(atr)).drop("_x", "_before")

    return run


def trail_kernel(mode: str, pct: float, k: float, min_improve: float, cooldown: float, long: bool, places: int | None = None):
    """Ratcheting stop: never loosens, moves only by enough and not within the cooldown; fixed once locked. Event time, not clock time."""
    def run(rows: pd.DataFrame, state):
        px, atr, t, swing, locks = (rows[c].to_numpy(float) for c in ("close", "atr", "epoch", "swing_level", "locked"))
        stop, last, locked = (float("nan"), float("nan"), 0.0) if state is None else state
        out = np.full(len(rows), np.nan)
        for i in range(len(rows)):
            locked = max(locked, locks[i])
            if locked or (last == last and t[i] - last < cooldown):
                out[i] = stop
                continue
            dist = px[i] * pct if mode == "percent" else k * atr[i]
            cand = swing[i] if mode == "swing" else px[i] - dist if long else px[i] + dist
            if cand == cand and (mode != "atr" or atr[i] != 0):
                cand = cand if places is None else round(float(cand), places)
                better = stop != stop or (cand >= stop if long else cand <= stop)
                enough = stop != stop or mode != "atr" or abs(cand - stop) >= min_improve * atr[i]
                if better and enough:
                    stop, last = cand, float(t[i])
            out[i] = stop
        return {"stop": out}, [stop, last, locked]

    return run


def trailing_stop(df: DataFrame, keys: Sequence[str] = SERIES, mode: str = "percent", pct: float = 0.01, k: float = 2.0, min_improve: float = 0.1,
                  cooldown: float = 0.0, long: bool = True, block_rows: int = BLOCK_ROWS, places: int | None = None) -> DataFrame:
    """``df``: one row per (position keys, ts) with close and atr, for mode ``swing`` a swing_level, and where a stop may be fixed a
    ``locked`` flag. Adds the stop after each price, rounded to ``places``. A stop that only ratchets is a running extreme and needs no scan."""
    extra = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(d).cast("double").alias(c) for c, d in (("swing_level", None), ("locked", 0.0))]
    src = df.select(*keys, "ts", "close", "atr", F.unix_seconds("ts").cast("double").alias("epoch"), *extra)
    x = block_scan(src, trail_kernel(mode, pct, k, min_improve, cooldown, long, places), {"stop": T.DoubleType()}, 2048, keys, block_rows=block_rows)
    return x.drop("epoch", "swing_level", "locked")


def breakeven_ready(price: Column, entry: Column, atr: Column, trigger: float = 1.0, long: bool = True) -> Column:
    """The price has gone ``trigger`` average ranges beyond the entry."""
    advance = price - entry if long else entry - price
    return F.coalesce(advance >= trigger * atr, F.lit(False))


def position_size(balance: Column, price: Column, share: float = 0.1, min_notional: float = 10.0) -> Column:
    """Quantity for a share of the free balance; nothing below the smallest order value."""
    notional = balance * share
    return F.when(notional >= min_notional, F.try_divide(notional, price)).otherwise(0.0)


def all_plans(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
