"""Strategy discovery: which signals, alone or together, preceded moves in their direction.

Every mode is one scan of a state table. Named setups become boolean columns; the ones active on a bar
are exploded and aggregated. Signal triples are counted inside the tasks, so the rows that reach the
combination step are triples of states with counts, not bars.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.registry import REGISTRY
from barloom.functions.states import STATES, state_long, state_table
from barloom.operators.blocks import BLOCK_ROWS, SERIES
from barloom.plans.mtf import GROUPS, contexts, last_bar, mtf_table
from barloom.session import cut_lineage

RET = "future_return"
# ---- Fixed values: setups by mode; each lists the signals of the high, trading and low timeframe. ----
MULTI_SIGNAL = {
    "bullish_trend_pullback_entry": (3, ("trend_medium", "higher_lows_pattern", "higher_highs"),
                                     ("pullback_complete_bull", "healthy_bull_pullback", "volume_decreasing"),
                                     ("swing_low", "near_fib_618", "near_fib_500", "sr_confluence_score", "rsi")),
    "bullish_breakout_structure": (3, ("trend_long", "trend_medium", "abc_pullback_bull"),
                                   ("structure_break_bullish", "higher_highs"),
                                   ("volume_breakout", "momentum_continuation", "rsi", "macd_hist")),
    "bullish_reversal_confluence": (2, ("failed_pullback_bear", "swing_failure"),
                                    ("momentum_divergence_bullish", "false_breakout_bearish"),
                                    ("swing_low", "structure_break_bullish", "volume_breakout")),
    "bearish_trend_pullback_entry": (3, ("trend_medium", "lower_highs_pattern", "lower_lows"),
                                     ("pullback_complete_bear", "healthy_bear_pullback", "volume_decreasing"),
                                     ("swing_high", "near_fib_382", "near_fib_236", "sr_confluence_score", "rsi")),
    "bearish_breakout_structure": (3, ("trend_long", "trend_medium", "abc_pullback_bear"),
                                   ("structure_break_bearish", "lower_lows"),
                                   ("volume_breakout", "momentum_continuation", "rsi", "macd_hist")),
    "bearish_reversal_confluence": (2, ("failed_pullback_bull", "swing_failure"),
                                    ("momentum_divergence_bearish", "false_breakout_bullish"),
                                    ("swing_high", "structure_break_bearish", "volume_breakout")),
}
HYBRID = {
    "hybrid_bull_1": (("trend_medium", "higher_lows_pattern", "rsi"), ("pullback_complete_bull", "macd"), ("swing_low", "near_fib_618", "bb_pct")),
    "hybrid_bull_2": (("abc_pullback_bull", "ema_50"), ("healthy_bull_pullback", "stoch_k"), ("sr_confluence_score", "rsi")),
    "hybrid_bear_1": (("trend_medium", "lower_highs_pattern", "rsi"), ("pullback_complete_bear", "macd"), ("swing_high", "near_fib_382", "bb_pct")),
}
BREAKOUT = {
    "structural_breakout_bull": (("higher_highs",), ("momentum_divergence_bullish",), ("volume_breakout",)),
    "structural_breakout_bear": (("lower_lows",), ("momentum_divergence_bearish",), ("volume_breakout",)),
}
DIVERGENCE = {
    "momentum_divergence_bull": (("trend_structure",), ("momentum_divergence_bullish",), ("false_breakout_bearish",)),
    "momentum_divergence_bear": (("trend_structure",), ("momentum_divergence_bearish",), ("false_breakout_bullish",)),
}
TREND_CONTEXT = {
    "uptrend_pullback": (("trend_structure",), ("pullback_complete_bull",), ("structure_break_bullish",)),
    "downtrend_rally": (("trend_structure",), ("pullback_complete_bear",), ("structure_break_bearish",)),
}
QUALITY_PULLBACK = {
    "hq_bullish_pullback": (("trend_structure",), ("pullback_complete_bull",), ("momentum_divergence_bullish",)),
    "hq_bearish_pullback": (("trend_structure",), ("pullback_complete_bear",), ("momentum_divergence_bearish",)),
}
REGIME_OPTIMISED = {
    "trend_following_momentum": (("strong_trend_high_vol", "strong_trend_normal_vol", "weak_trend"),
                                 (("trend_structure",), ("momentum_continuation",), ("pullback_complete_bull",))),
    "trend_pullback_entries": (("strong_trend_normal_vol", "weak_trend"),
                               (("trend_structure",), ("pullback_complete_bull",), ("momentum_divergence_bullish",))),
    "range_boundary_trading": (("ranging_high_vol", "ranging_normal_vol"), (("market_structure",), ("swing_high", "swing_low"), ("rsi",))),
    "breakout_anticipation": (("ranging_low_vol", "transition_normal_vol"), (("bb_width",), ("momentum_continuation",), ("structure_break_bullish",))),
}
ADAPTIVE = {
    "universal_momentum_bull": (1.15, (("trend_structure",), ("momentum_continuation",), ("volume_breakout",)),
                                {"trending": ("higher_highs", 1.2), "ranging": ("equal_highs_lows", 0.8), "transition": ("swing_failure", 1.5)}),
    "universal_momentum_bear": (1.15, (("trend_structure",), ("momentum_continuation",), ("volume_breakout",)),
                                {"trending": ("lower_lows", 1.2), "ranging": ("equal_highs_lows", 0.8), "transition": ("swing_failure", 1.5)}),
    "structure_breakout_adaptive_bull": (1.1, (("equal_highs_lows",), ("structure_break_bullish",), ("momentum_continuation",)),
                                         {"trending": ("higher_highs", 1.1), "ranging": ("swing_low", 0.9), "transition": ("volume_divergence", 1.3)}),
    "structure_breakout_adaptive_bear": (1.1, (("equal_highs_lows",), ("structure_break_bearish",), ("momentum_continuation",)),
                                         {"trending": ("lower_lows", 1.1), "ranging": ("swing_high", 0.9), "transition": ("volume_divergence", 1.3)}),
}
ALIGNED = {
    "perfect_alignment_breakout": ("excellent", 0.8, (("trend_structure",), ("structure_break_bullish",), ("higher_highs",))),
    "aligned_pullback_entry": ("good", 0.6, (("trend_structure",), ("pullback_complete_bull",), ("swing_low",))),
}
VOLATILITY = {
    "high_vol_breakout_bull": ("high_volatility", 1.25, (("trend_structure",), ("structure_break_bullish",), ("momentum_continuation",))),
    "high_vol_breakout_bear": ("high_volatility", 1.25, (("trend_structure",), ("structure_break_bearish",), ("momentum_continuation",))),
    "high_vol_range_expansion_bull": ("high_volatility", 1.2, (("market_structure",), ("equal_highs_lows",), ("structure_break_bullish",))),
    "high_vol_range_expansion_bear": ("high_volatility", 1.2, (("market_structure",), ("equal_highs_lows",), ("structure_break_bearish",))),
    "low_vol_compression_bull": ("low_volatility", 1.3, (("market_structure",), ("bb_squeeze",), ("structure_break_bullish",))),
    "low_vol_compression_bear": ("low_volatility", 1.3, (("market_structure",), ("bb_squeeze",), ("structure_break_bearish",))),
    "low_vol_mean_reversion_bull": ("low_volatility", 1.15, (("equal_highs_lows",), ("rsi_extreme",), ("momentum_divergence_bullish",))),
    "low_vol_mean_reversion_bear": ("low_volatility", 1.15, (("equal_highs_lows",), ("rsi_extreme",), ("momentum_divergence_bearish",))),
    "normal_vol_trend_bull": ("normal_volatility", 1.1, (("trend_structure",), ("pullback_complete_bull",), ("momentum_confirmation",))),
    "normal_vol_trend_bear": ("normal_volatility", 1.1, (("trend_structure",), ("pullback_complete_bear",), ("momentum_confirmation",))),
}
VOLATILITY_MIN_WIN = {"high_volatility": 0.52, "normal_volatility": 0.50, "low_volatility": 0.48}
CASCADES = {
    "momentum_cascade_bull": ("htf_to_ltf", ("bullish", "bullish", "bullish"), 1.2, (("trend_structure",), ("momentum_continuation",), ("structure_break_bullish",))),
    "momentum_cascade_bear": ("htf_to_ltf", ("bearish", "bearish", "bearish"), 1.2, (("trend_structure",), ("momentum_continuation",), ("structure_break_bearish",))),
    "momentum_acceleration_bull": ("accelerating", ("bullish", "bullish", "bullish"), 1.15, (("trend_structure",), ("momentum_continuation",), ("volume_breakout",))),
    "momentum_acceleration_bear": ("accelerating", ("bearish", "bearish", "bearish"), 1.15, (("trend_structure",), ("momentum_continuation",), ("volume_breakout",))),
    "momentum_reversal_bull": ("reversal", ("neutral", "bullish", "bullish"), 1.25, (("trend_structure",), ("false_breakout_bearish",), ("structure_break_bullish",))),
    "momentum_reversal_bear": ("reversal", ("neutral", "bearish", "bearish"), 1.25, (("trend_structure",), ("false_breakout_bullish",), ("structure_break_bearish",))),
}
CONFLUENCE = {
    "bullish_trend_resumption": (("strong_trend_high_vol", "strong_trend_normal_vol", "weak_trend"),
                                 (("trend_structure",), ("pullback_complete_bull",), ("structure_break_bullish",)),
                                 (("adx", "ema_50"), ("rsi", "macd"), ("bb_pct", "stoch_k"))),
    "bearish_reversal_confluence": (("ranging_high_vol", "ranging_normal_vol", "transition_normal_vol"),
                                    (("market_structure",), ("false_breakout_bullish",), ("structure_break_bearish",)),
                                    (("rsi",), ("macd", "stoch_k"), ("rsi", "bb_pct"))),
}
# ---- end of fixed values ----


def hits(direction: Column, ret: Column | str = RET) -> Column:
    r = F.col(ret) if isinstance(ret, str) else ret
    return F.coalesce(F.when(direction == "bullish", r > 0).otherwise(r < 0), F.lit(False))


def single_signals(bars: DataFrame, signals: Sequence[str], min_n: int = 20, min_win: float = 0.51, min_rows: int = 50,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Accuracy of each signal and direction in one pass over the unpivoted states."""
    wide = state_table(bars, signals, block_rows, ["price_state_5"])
    long = state_long(wide, signals, ["price_state_5"])
    side = F.when(F.col("code") == 1, "bullish").when(F.col("code") == -1, "bearish")
    agg = long.withColumn("direction", side).groupBy(*SERIES, "signal", "direction").agg(
        F.count(F.lit(1)).alias("sample_size"), F.sum((F.col("price_state_5") == F.col("direction")).cast("int")).alias("_ok"))
    rows = Window.partitionBy(*SERIES, "signal")
    return (
        agg.withColumn("_rows", F.sum("sample_size").over(rows)).where("direction is not null")
        .withColumn("discovered_accuracy", F.col("_ok") / F.col("sample_size"))
        .where((F.col("_rows") >= min_rows) & (F.col("sample_size") > min_n) & (F.col("discovered_accuracy") > min_win))
        .select(*SERIES, "signal", "direction", "discovered_accuracy", "sample_size")
    )


def combinations(bars: DataFrame, signals: Sequence[str], first: int | None = None, least: int = 3, min_n: int = 10,
                 min_win: float = 0.55, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sets of signals active together, taken on every bar where they are (not only on bars that moved).

    A set holds all active signals, or the ``first`` of them in the order of ``signals``.
    """
    wide = state_table(bars, signals, block_rows, ["future_return_5"])

    def active(code):
        return F.array_compact(F.array(*[F.when(F.col(f"state_{s}") == code, F.lit(s)) for s in signals]))

    sides = F.explode(F.array(
        F.struct(F.lit("bullish").alias("direction"), active(1).alias("active")),
        F.struct(F.lit("bearish").alias("direction"), active(-1).alias("active")))).alias("s")
    rows = wide.select(*SERIES, "future_return_5", sides).where(F.size("s.active") >= least)
    combo = F.concat_ws("+", F.array_sort(F.slice("s.active", 1, first) if first else F.col("s.active"))).alias("combo")
    agg = rows.select(*SERIES, "s.direction", combo, hits(F.col("s.direction"), "future_return_5").alias("hit")).groupBy(
        *SERIES, "direction", "combo").agg(F.count(F.lit(1)).alias("sample_size"), F.avg(F.col("hit").cast("int")).alias("discovered_accuracy"))
    k = F.size(F.split("combo", r"\+"))
    return agg.where((F.col("sample_size") >= min_n) & (F.col("discovered_accuracy") > min_win)).withColumn(
        "performance_score", F.col("discovered_accuracy") * (1 + k * 0.05))


def triple_counts(aligned: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Bars, rises and falls of every signal triple in every constellation of its three states.

    A task adds up its bars by products of 0/1 tables, one per state of the high timeframe, and hands on counts; the rows that are
    shuffled are counts of triples, whose number does not depend on the bars.
    """
    names = list(signals)
    k = 3 * len(names)
    cols = [f"{p}_state_{s}" for p in "htl" for s in names]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def given():
            for pair, cube in sums.items():
                h, t, low = np.nonzero(cube[..., 0])
                part = {"pair": pair}
                for p, at in (("h", h), ("t", t), ("l", low)):
                    part |= {f"{p}s": at // 3, f"{p}v": at % 3 - 1}
                yield pd.DataFrame(part | {c: cube[h, t, low, i].astype(np.int64) for i, c in enumerate(("n", "up", "down"))})
            sums.clear()

        for pdf in batches:
            for pair, rows in pdf.groupby("pair", sort=False, dropna=False):
                v = rows[cols].to_numpy().reshape(len(rows), 3, len(names))
                on = (v[..., None] == np.array([-1, 0, 1])).reshape(len(rows), 3, k).astype(np.float64)
                ends = np.stack([np.ones(len(rows)), rows["_up"].to_numpy(), rows["_down"].to_numpy()], axis=1)
                low = (on[:, 2, :, None] * ends[:, None, :]).reshape(len(rows), 3 * k)
                cube = sums.setdefault(None if pd.isna(pair) else pair, np.zeros((k, k, k, 3)))
                for i in range(k):
                    mine = on[:, 0, i] > 0
                    if mine.any():
                        cube[i] += (on[mine, 1].T @ low[mine]).reshape(k, k, 3)
                if len(sums) * k**3 > 2_000_000:
                    yield from given()
        yield from given()

    sign = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    states = aligned.select("pair", *[F.coalesce(F.col(c), F.lit(0)).cast("tinyint").alias(c) for c in cols],
                            sign(F.col(RET) > 0).alias("_up"), sign(F.col(RET) < 0).alias("_down"))
    parts = states.mapInPandas(counted, "pair string, hs int, hv int, ts int, tv int, ls int, lv int, n long, up long, down long")
    at = ["pair", "hs", "hv", "ts", "tv", "ls", "lv"]
    sums = parts.groupBy(*at).agg(*[F.sum(c).alias(c) for c in ("n", "up", "down")])
    name = F.array(*[F.lit(s) for s in names])
    return sums.select("pair", *[F.struct(F.get(name, F.col(f"{p}s")).alias("s"), F.col(f"{p}v").alias("v")).alias(p) for p in "htl"], "n", "up", "down")


def triples(aligned: DataFrame, signals: Sequence[str], mode: str, min_win: float = 0.51, counts: DataFrame | None = None) -> DataFrame:
    """Modes A (all three agree), B (two of three) and C (weighted score) over all signal triples.

    ``counts``: what ``triple_counts`` gives of ``aligned``, for a caller of several modes.
    """
    x = triple_counts(aligned, signals) if counts is None else counts
    h, t, low = F.col("h.v"), F.col("t.v"), F.col("l.v")
    extra: list[str] = []
    if mode == "a":
        x, side = x.where((h != 0) & (t == h) & (low == h)), h
    elif mode == "b":
        pair_of = lambda name, a, b: F.when((a == b) & (a != 0), F.struct(F.lit(name).alias("c"), a.alias("d")))
        x = x.withColumn("k", F.explode(F.array_compact(F.array(
            pair_of("HTF+TTF", h, t), pair_of("HTF+LTF", h, low), pair_of("TTF+LTF", t, low)))))
        x, side, extra = x.withColumn("confluence", F.col("k.c")), F.col("k.d"), ["confluence"]
    else:
        score = h * 5 + t * 3 + low * 2
        x = x.withColumn("_score", score).withColumn("threshold", F.explode(F.array(F.lit(6), F.lit(7), F.lit(8))))
        x, side, extra = x.where(F.abs("_score") >= F.col("threshold")), F.signum("_score"), ["threshold"]
    x = x.withColumn("direction", F.when(side > 0, "bullish").otherwise("bearish"))
    agg = x.groupBy("pair", F.col("h.s").alias("htf_signal"), F.col("t.s").alias("ttf_signal"), F.col("l.s").alias("ltf_signal"),
                    "direction", *extra).agg(
        F.sum("n").alias("sample_size"), F.sum(F.when(F.col("direction") == "bullish", F.col("up")).otherwise(F.col("down"))).alias("_w"))
    acc = F.col("_w") / F.col("sample_size")
    least = {"a": F.lit(10), "b": F.when(F.col("direction") == "bullish", 10).otherwise(25), "c": F.lit(12)}[mode]
    score = {"a": F.lit(1.0), "b": F.lit(0.9), "c": 1 + F.col("threshold") / 10 if mode == "c" else None}[mode]
    return agg.withColumn("discovered_accuracy", acc).where((F.col("sample_size") > least) & (acc > min_win)).withColumn(
        "performance_score", F.col("discovered_accuracy") * score).drop("_w")


def state_of(prefix: str, signal: str, direction: int) -> Column:
    """Does the signal of that timeframe point in the direction. Plain flags point both ways."""
    if signal == "rsi_extreme":
        r = F.col(f"{prefix}_rsi")
        out = r < 30 if direction > 0 else r > 70
    elif signal in ("bb_squeeze", "momentum_confirmation"):
        out = F.col(f"{prefix}_{signal}") == 1
    else:
        out = F.col(f"{prefix}_state_{signal}") == direction
    return F.coalesce(out, F.lit(False))


def all_of(parts: tuple[tuple[str, ...], ...], direction: int) -> Column:
    return reduce(and_, [state_of(p, s, direction) for p, group in zip("htl", parts, strict=True) for s in group])


def side_of(name: str) -> int:
    return -1 if ("bear" in name or name.startswith("downtrend")) else 1


def evaluate(aligned: DataFrame, setups: Sequence[tuple[str, int, Column]], extra: dict[str, Column] | None = None) -> DataFrame:
    """Count and accuracy per (pair, setup, direction) of all setups in a single scan."""
    active = F.array_compact(F.array(*[
        F.when(mask, F.struct(F.lit(name).alias("setup"), F.lit("bullish" if d > 0 else "bearish").alias("direction")))
        for name, d, mask in setups]))
    extra = extra or {}
    x = aligned.withColumns({f"_{k}": v for k, v in extra.items()}).select("pair", RET, *[f"_{k}" for k in extra], F.explode(active).alias("s"))
    return x.groupBy("pair", "s.setup", "s.direction").agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg(hits(F.col("s.direction")).cast("int")).alias("discovered_accuracy"),
        *[F.avg(f"_{k}").alias(k) for k in extra])


def signals_of(mode: str) -> tuple[list[str], list[str]]:
    """State signals and raw columns a mode reads."""
    flat = lambda parts: [s for group in parts for s in group]
    lists = {
        "d": [flat(v[1:]) for v in MULTI_SIGNAL.values()], "e": [flat(v) for v in HYBRID.values()],
        "f": [flat(v) for v in BREAKOUT.values()], "g": [flat(v) for v in DIVERGENCE.values()],
        "h": [flat(v) for v in TREND_CONTEXT.values()], "i": [flat(v) for v in QUALITY_PULLBACK.values()],
        "j": [flat(v[1]) for v in REGIME_OPTIMISED.values()],
        "k": [flat(v[1]) + [f for f, _ in v[2].values()] for v in ADAPTIVE.values()],
        "l": [flat(v[2]) for v in ALIGNED.values()], "m": [flat(v[2]) for v in VOLATILITY.values()],
        "n": [flat(v[3]) for v in CASCADES.values()],
        "confluence": [flat(v[1]) + flat(v[2]) for v in CONFLUENCE.values()],
    }[mode]
    names = list(dict.fromkeys(s for one in lists for s in one))
    raw = [s for s in names if s in ("bb_squeeze", "momentum_confirmation")]
    if "rsi_extreme" in names or mode == "d":
        raw.append("rsi")
    if mode in ("j", "confluence"):
        raw.append("historical_regime")
    return [s for s in names if s in STATES or s == "bb_width"], [r for r in dict.fromkeys(raw) if r in REGISTRY]


def _keep(df: DataFrame, min_n: int, min_win: float, strict: bool, score: Column) -> DataFrame:
    n, a = F.col("sample_size"), F.col("discovered_accuracy")
    ok = (n > min_n) & (a > min_win) if strict else (n >= min_n) & (a >= min_win)
    return df.where(ok).withColumn("performance_score", a * score)


def multi_signal(aligned: DataFrame, min_n: int = 10, min_win: float = 0.51) -> DataFrame:
    """Mode D: enough of the listed signals agree on each timeframe; a mild RSI also counts."""
    setups, levels = [], []
    for name, (need, *parts) in MULTI_SIGNAL.items():
        d = side_of(name)
        sums = []
        for p, group in zip("htl", parts, strict=True):
            masks = [state_of(p, s, d) for s in group]
            if p == "l" and "rsi" in group:
                i = group.index("rsi")
                masks[i] = masks[i] | F.coalesce(F.col("l_rsi") < 50 if d > 0 else F.col("l_rsi") > 50, F.lit(False))
            sums.append((reduce(add, [m.cast("int") for m in masks]), min(need, len(group))))
        setups.append((name, d, reduce(and_, [s >= k for s, k in sums])))
        levels.append((name, reduce(add, [s for s, _ in sums]) / F.lit(3.0)))
    active = F.array_compact(F.array(*[
        F.when(mask, F.struct(F.lit(n).alias("setup"), F.lit("bullish" if d > 0 else "bearish").alias("direction"), lv[1].alias("c")))
        for (n, d, mask), lv in zip(setups, levels, strict=True)]))
    x = aligned.select("pair", RET, F.explode(active).alias("s"))
    agg = x.groupBy("pair", "s.setup", "s.direction").agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg(hits(F.col("s.direction")).cast("int")).alias("discovered_accuracy"),
        F.avg("s.c").alias("avg_confluence"))
    return _keep(agg, min_n, min_win, True, 1 + F.col("avg_confluence") / 10)


def plain_setups(aligned: DataFrame, mode: str, least: tuple[int, float] | None = None) -> DataFrame:
    """Modes E, F and G: every listed signal agrees."""
    table, min_n, min_win, strict, bonus = {
        "e": (HYBRID, 8, 0.51, True, 1.1), "f": (BREAKOUT, 5, 0.50, False, 1.2), "g": (DIVERGENCE, 5, 0.50, False, 1.15)}[mode]
    setups = [(n, side_of(n), all_of(p, side_of(n))) for n, p in table.items()]
    min_n, min_win = least or (min_n, min_win)
    return _keep(evaluate(aligned, setups), min_n, min_win, strict, F.lit(bonus))


def custom_setups(aligned: DataFrame, setups: dict[str, tuple[tuple[str, ...], ...]], bonus: float = 1.0,
                  min_n: int = 5, min_win: float = 0.5) -> DataFrame:
    """The template behind the named modes, for a user's own setups."""
    return _keep(evaluate(aligned, [(n, side_of(n), all_of(p, side_of(n))) for n, p in setups.items()]), min_n, min_win, False, F.lit(bonus))


def regime_optimised(aligned: DataFrame, regime: str = "l_historical_regime") -> DataFrame:
    """Mode J: signals agree while a compatible regime was in force; the score adds the share of bars covered."""
    total = aligned.groupBy("pair").agg(F.count(F.lit(1)).alias("_all"))
    setups = [(n, d, all_of(p, d) & F.coalesce(F.col(regime).isin(*r), F.lit(False)))
              for n, (r, p) in REGIME_OPTIMISED.items() for d in (1, -1)]
    x = evaluate(aligned, setups).join(total, "pair")
    return _keep(x, 10, 0.51, True, 1 + F.col("sample_size") / F.col("_all")).drop("_all")


def adaptive(aligned: DataFrame, context: DataFrame) -> DataFrame:
    """Mode K: a setup with a further filter per regime context present on the newest bars."""
    setups, bonus = [], []
    for n, (b, p, adapt) in ADAPTIVE.items():
        d = side_of(n)
        for regime, (flt, mult) in adapt.items():
            setups.append((f"{n}|{regime}", d, all_of(p, d) & state_of("l", flt, d)))
            bonus.append((f"{n}|{regime}", b * mult))
    factor = F.create_map(*[F.lit(v) for kv in bonus for v in kv])[F.col("setup")]
    now = last_bar(context, ["regimes"])
    x = evaluate(aligned, setups).join(now, "pair").withColumn("regime_context", F.substring_index("setup", "|", -1))
    x = x.where(F.array_contains("regimes", F.col("regime_context"))).drop("regimes")
    return _keep(x, 5, 0.48, False, factor)


def structure_aligned(aligned: DataFrame, context: DataFrame) -> DataFrame:
    """Mode L: only for pairs whose three trends agree well enough on the newest bar."""
    now = last_bar(context, ["alignment_quality", "alignment_score"])
    setups = [(n, d, all_of(p, d)) for n, (_, _, p) in ALIGNED.items() for d in (1, -1)]
    need = F.create_map(*[F.lit(v) for n, (q, _, _) in ALIGNED.items() for v in (n, q)])[F.col("setup")]
    least = F.create_map(*[F.lit(v) for n, (_, s, _) in ALIGNED.items() for v in (n, s)])[F.col("setup")]
    x = evaluate(aligned, setups).join(now, "pair").where((F.col("alignment_quality") == need) & (F.col("alignment_score") >= least))
    return _keep(x, 5, 0.51, True, 1 + F.col("alignment_score"))


def volatility_adaptive(aligned: DataFrame, context: DataFrame) -> DataFrame:
    """Mode M: setups of the volatility class the newest bar is in, with that class's threshold."""
    now = last_bar(context, ["volatility_class"])
    setups = [(n, side_of(n), all_of(p, side_of(n))) for n, (_, _, p) in VOLATILITY.items()]
    cls = F.create_map(*[F.lit(v) for n, (c, _, _) in VOLATILITY.items() for v in (n, c)])[F.col("setup")]
    bonus = F.create_map(*[F.lit(v) for n, (_, b, _) in VOLATILITY.items() for v in (n, b)])[F.col("setup")]
    least = F.create_map(*[F.lit(v) for kv in VOLATILITY_MIN_WIN.items() for v in kv])[F.col("volatility_class")]
    x = evaluate(aligned, setups).join(now, "pair").where(cls == F.col("volatility_class"))
    return x.where((F.col("sample_size") >= 5) & (F.col("discovered_accuracy") >= least)).withColumn(
        "performance_score", F.col("discovered_accuracy") * bonus)


def momentum_cascade(aligned: DataFrame, context: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Mode N: the newest momentum flow matches the setup; confidence is the cascade score over 100."""
    now = last_bar(context, ["flow", "htf_momentum", "ttf_momentum", "ltf_momentum", "cascade_score"])
    setups = [(n, side_of(n), all_of(p, side_of(n))) for n, (_, _, _, p) in CASCADES.items()]
    spec = F.create_map(*[x for n, (f, m, b, _) in CASCADES.items() for x in (
        F.lit(n), F.struct(F.lit(f).alias("flow"), F.array(*[F.lit(v) for v in m]).alias("m"), F.lit(b).alias("b")))])[F.col("setup")]
    same = F.array("htf_momentum", "ttf_momentum", "ltf_momentum") == spec["m"]
    x = evaluate(aligned, setups).join(now, "pair").where(
        (F.col("flow") == spec["flow"]) & same & (F.col("cascade_score") / 100 >= min_confidence))
    return _keep(x, 5, 0.48, False, spec["b"] * (1 + F.col("cascade_score") / 100)).select(
        "pair", "setup", "direction", "sample_size", "discovered_accuracy", "flow", "cascade_score", "performance_score")


TRENDS = {1: ("strong_uptrend", "uptrend"), -1: ("strong_downtrend", "downtrend")}
#: What modes H and I read of each timeframe besides signal states.
CONTEXT_EXTRA = ["primary_trend", "primary_trend_strength", "swing_trend_quality", "oscillator_trend", "pullback_overall", "pullback_overall_bearish"]
GATES = {"h": (TREND_CONTEXT, 50), "i": (QUALITY_PULLBACK, 80)}


def gate_report(aligned: DataFrame, mode: str, at: str = "last") -> DataFrame:
    """Per pair and setup of mode H (trend strength at least 50) or I (pullback score at least 80): bars in the gate, bars on which all
    signals agree, and count, accuracy and score of the bars that count.

    ``at="last"`` asks the trend and the score of a pair's newest bar only, which then admits or bars its whole past; ``at="bar"``
    asks every bar what was known there. ``aligned`` holds the mode's states and ``CONTEXT_EXTRA``.
    """
    from barloom.plans.structure import synthesis_columns

    table, least = GATES[mode]
    known = synthesis_columns()
    score = {1: F.coalesce(F.col("l_pullback_overall"), F.lit(0.0)), -1: F.coalesce(F.col("l_pullback_overall_bearish"), F.lit(0.0))}
    df = aligned.withColumns({"_trend": known["primary_trend"], "_strength": known["trend_strength"], "_up": score[1], "_down": score[-1]})
    if at == "last":
        now = last_bar(df, ["_trend", "_strength", "_up", "_down"])
        df = df.drop("_trend", "_strength", "_up", "_down").join(now, "pair")
    rows = []
    for name, parts in table.items():
        d = side_of(name)
        grade = F.col("_strength") if mode == "h" else F.col("_up" if d > 0 else "_down")
        rows.append(F.struct(F.lit(name).alias("setup"), F.lit("bullish" if d > 0 else "bearish").alias("direction"), grade.alias("grade"),
                             (F.col("_trend").isin(*TRENDS[d]) & (grade >= least)).alias("gate"), all_of(parts, d).alias("on")))
    x = df.select("pair", RET, F.explode(F.array(*rows)).alias("s")).select("pair", RET, "s.*").withColumn("both", F.col("gate") & F.col("on"))
    count = lambda c: F.sum(F.col(c).cast("int"))
    out = x.groupBy("pair", "setup", "direction").agg(
        count("gate").alias("gated_bars"), count("on").alias("signal_bars"), count("both").alias("sample_size"),
        F.avg(F.when(F.col("both"), hits(F.col("direction")).cast("int"))).alias("discovered_accuracy"), F.avg(F.when(F.col("both"), F.col("grade"))).alias("gate_score"))
    bonus = F.lit(1.1) if mode == "h" else 1 + F.col("gate_score") / 100
    return out.withColumn("performance_score", F.col("discovered_accuracy") * bonus)


def gated(aligned: DataFrame, mode: str, at: str = "last") -> DataFrame:
    """Strategies of mode H (at least 5 bars, half of them right) or I (more than 5 bars and 0.51)."""
    n, a = F.col("sample_size"), F.col("discovered_accuracy")
    return gate_report(aligned, mode, at).where((n >= 5) & (a >= 0.50) if mode == "h" else (n > 5) & (a > 0.51))


def confluence(aligned: DataFrame, regime: str = "l_historical_regime", share: float = 0.6) -> DataFrame:
    """At least ``share`` of the price-action and of the indicator signals agree in a fitting regime."""
    import math

    setups = []
    for n, (regimes, action, indicators) in CONFLUENCE.items():
        d = side_of(n)
        parts = []
        for group in (action, indicators):
            masks = [state_of(p, s, d).cast("int") for p, g in zip("htl", group, strict=True) for s in g]
            parts.append(reduce(add, masks) >= math.ceil(len(masks) * share))
        setups.append((n, d, parts[0] & parts[1] & F.coalesce(F.col(regime).isin(*regimes), F.lit(False))))
    return _keep(evaluate(aligned, setups), 10, 0.51, True, F.lit(1.0))


def top_pairs(bars: DataFrame, timeframes: tuple[str, str, str], signals: Sequence[str], top: int = 5, each: int = 3,
              min_n: int = 15, min_win: float = 0.58, at: str = "close", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of each timeframe's best indicators, combined over the three timeframes."""
    wide = state_table(bars.where(F.col("timeframe").isin(*timeframes)), signals, block_rows, ["future_return_5"])
    long = state_long(wide, signals, ["future_return_5"]).where("code <> 0").withColumn(
        "direction", F.when(F.col("code") == 1, "bullish").otherwise("bearish"))
    ranked = long.groupBy(*SERIES, "signal", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.avg(hits(F.col("direction"), "future_return_5").cast("int")).alias("wr")).where("n > 20")
    ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("wr"), "signal", "direction"))).where(
        F.col("_k") <= top)
    ranked = ranked.withColumn("_j", F.row_number().over(Window.partitionBy(*SERIES, "direction").orderBy("_k"))).where(F.col("_j") <= each)
    role = F.when(F.col("timeframe") == timeframes[0], "h").when(F.col("timeframe") == timeframes[1], "t").otherwise("l")
    best = ranked.withColumn("r", role).groupBy("pair", "direction").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("r") == p, F.col("signal")))).alias(f"_{p}") for p in "htl"])
    best = best.where("size(_h) >= 2 and size(_t) >= 2 and size(_l) >= 2")
    aligned = mtf_table(bars, timeframes, signals, at=at, block_rows=block_rows)

    def active(p, code):
        return F.array_compact(F.array(*[F.when(F.col(f"{p}_state_{s}") == code, F.lit(s)) for s in signals]))

    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("direction"), *[active(p, c).alias(p) for p in "htl"])
                                for n, c in (("bullish", 1), ("bearish", -1))])).alias("s")
    x = aligned.select("pair", RET, sides).select("pair", RET, "s.*").join(best, ["pair", "direction"])

    def pairs(p):
        both = F.array_sort(F.array_intersect(p, f"_{p}"))
        return F.flatten(F.transform(both, lambda a: F.transform(F.filter(both, lambda b: b > a), lambda b: F.concat_ws("+", a, b))))

    for p in "htl":
        x = x.withColumn(f"{p}_pair", F.explode(pairs(p)))
    agg = x.groupBy("pair", "direction", "h_pair", "t_pair", "l_pair").agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg(hits(F.col("direction")).cast("int")).alias("discovered_accuracy"))
    return _keep(agg, min_n, min_win, True, F.lit(1.1))


def quality_score(win: Column, n: Column, gain: Column, loss: Column, regimes: Column | None = None) -> Column:
    """0-100 from win rate (40), sample size (20), profit factor (20) and breadth of regimes (20)."""
    pf = F.abs(F.try_divide(gain, loss))
    parts = F.least(F.lit(40.0), (win - 0.5) * 200) + F.least(F.lit(20.0), n / 100 * 20) + F.coalesce(
        F.least(F.lit(20.0), (pf - 1) * 10), F.lit(0.0))
    return F.when(n < 10, 0.0).otherwise(parts + (F.least(F.lit(20), regimes * 5) if regimes is not None else 10))


def filter_and_rank(strategies: DataFrame) -> DataFrame:
    q = F.coalesce(F.col("quality_score"), F.col("performance_score") * 100) if "quality_score" in strategies.columns else F.col("performance_score") * 100
    return strategies.withColumn("quality_score", q).where(
        (F.col("sample_size") >= 15) & (F.col("discovered_accuracy") >= 0.52) & (F.col("quality_score") >= 50)).orderBy(
        F.desc("performance_score"))


#: Signals that modes A, B, C and COMBO combine over timeframes when none are named.
COMBINED = ("sma_50", "ema_50", "rsi", "macd", "roc", "bop", "adx", "obv", "trend_structure")


def all_modes(bars: DataFrame, groups: dict[str, tuple[str, str, str]] | None = None, signals: Sequence[str] = COMBINED, regime: str = "bar_regime",
              gate: str = "last", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every mode of every timeframe group, ranked and given ids. The states of a group are computed once and kept.

    Modes A, B, C and COMBO combine ``signals``; J and the confluence mode read ``regime`` of the fast timeframe; H and I are gated at ``gate``.
    """
    cols = ["pair", "setup", "direction", "sample_size", "discovered_accuracy", "performance_score"]
    states, raw = list(signals), [*CONTEXT_EXTRA, regime]
    for m in ("d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n", "confluence"):
        s, r = signals_of(m)
        states += s
        raw += r
    pool = None
    for group, timeframes in (groups or GROUPS).items():
        mine = cut_lineage(bars.where(F.col("timeframe").isin(*timeframes)))
        aligned = cut_lineage(mtf_table(mine, timeframes, list(dict.fromkeys(states)), list(dict.fromkeys(raw)), block_rows=block_rows))
        ctx = cut_lineage(contexts(mine, timeframes, block_rows=block_rows))
        named = F.concat_ws("|", "htf_signal", "ttf_signal", "ltf_signal")
        counts = cut_lineage(triple_counts(aligned, signals))
        parts = {m: triples(aligned, signals, m, counts=counts).withColumn("setup", named) for m in "ab"}
        parts["c"] = triples(aligned, signals, "c", counts=counts).withColumn("setup", F.concat_ws("|", named, F.col("threshold").cast("string")))
        parts |= {"d": multi_signal(aligned), "e": plain_setups(aligned, "e"), "f": plain_setups(aligned, "f"), "g": plain_setups(aligned, "g"),
                  "h": gated(aligned, "h", gate), "i": gated(aligned, "i", gate), "j": regime_optimised(aligned, f"l_{regime}"), "k": adaptive(aligned, ctx),
                  "l": structure_aligned(aligned, ctx), "m": volatility_adaptive(aligned, ctx), "n": momentum_cascade(aligned, ctx),
                  "confluence": confluence(aligned, f"l_{regime}"),
                  "combo": top_pairs(mine, timeframes, list(signals), block_rows=block_rows).withColumn("setup", F.concat_ws("|", "h_pair", "t_pair", "l_pair"))}
        for m, p in parts.items():
            rows = p.select(*cols, F.lit(f"mtf_mode_{m}").alias("type"), F.lit(group).alias("group"))
            pool = rows if pool is None else pool.unionByName(rows)
    return pool.withColumn("strategy_id", F.sha2(F.concat_ws("|", "type", "pair", "setup", "direction", "group"), 256).substr(1, 16))
