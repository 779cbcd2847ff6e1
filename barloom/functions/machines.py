"""Non-linear recursions: parabolic stop-and-reverse and the self-adjusting average."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barloom.functions.registry import table
from barloom.operators.scan import block_scan

# Acceleration start, step and cap; smoothing constant of the self-adjusting average.
SAR_START, SAR_STEP, SAR_MAX = 0.02, 0.02, 0.2
ADJUST_K = 20.0


def sar_kernel(rows: pd.DataFrame, state):
    """State: sar, rising, acceleration, extreme, then the two previous lows and highs."""
    nan = float("nan")
    high, low, close = (rows[c].to_numpy() for c in ("high", "low", "close"))
    out = np.empty(len(rows))
    start = 0
    if state is None:
        if len(rows) == 0:
            return {"psar": out}, [nan] * 8
        sar, rising, acc, ext, l1, l2, h1, h2 = close[0], 1.0, SAR_START, high[0], low[0], nan, high[0], nan
        out[0], start = sar, 1
    else:
        sar, rising, acc, ext, l1, l2, h1, h2 = state
    for i in range(start, len(rows)):
        h, lo = high[i], low[i]
        sar += acc * (ext - sar)
        if rising and lo < sar:
            sar, rising, acc, ext = ext, 0.0, SAR_START, lo
        elif not rising and h > sar:
            sar, rising, acc, ext = ext, 1.0, SAR_START, h
        elif (h > ext) if rising else (lo < ext):
            ext, acc = (h if rising else lo), min(acc + SAR_STEP, SAR_MAX)
        if rising:
            sar = min([sar, *(v for v in (l1, l2) if v == v)])
        else:
            sar = max([sar, *(v for v in (h1, h2) if v == v)])
        l1, l2, h1, h2 = lo, l1, h, h1
        out[i] = sar
    return {"psar": out}, [sar, rising, acc, ext, l1, l2, h1, h2]


def adjusting_kernel(rows: pd.DataFrame, state):
    close = rows["close"].to_numpy()
    out = np.empty(len(rows))
    m = float("nan") if state is None else state[0]
    with np.errstate(all="ignore"):
        for i, c in enumerate(close):
            if m != m or m == 0:
                m = c
            elif c != 0:
                m += (c - m) / (ADJUST_K * (c / m) ** 4)
            out[i] = m if np.isfinite(m) else np.nan
    return {"mcginley": out}, [m]


def psar_table(bars: DataFrame, block_rows: int) -> DataFrame:
    src = bars.select("pair", "timeframe", "ts", "high", "low", "close")
    return block_scan(src, sar_kernel, {"psar": T.DoubleType()}, 512, block_rows=block_rows).select(
        "pair", "timeframe", "ts", "psar")


def mcginley_table(bars: DataFrame, block_rows: int) -> DataFrame:
    src = bars.select("pair", "timeframe", "ts", "close")
    return block_scan(src, adjusting_kernel, {"mcginley": T.DoubleType()}, 2048, block_rows=block_rows).select(
        "pair", "timeframe", "ts", "mcginley")


table(["psar"], psar_table, "indicator")
table(["mcginley"], mcginley_table, "indicator")
