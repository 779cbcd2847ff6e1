"""Every signal as a state per bar: 1 bullish, -1 bearish, 0 neutral."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.candles import CANDLES, PLACEHOLDERS
from barloom.functions.charts import CHARTS
from barloom.functions.frames import diff, lag
from barloom.functions.registry import REGISTRY, compute, native
from barloom.operators.blocks import BLOCK_ROWS, SERIES, span
from barloom.operators.quantiles import grouped_quantiles

# ---- Fixed values: which rule each signal follows, and its thresholds. ----
CLOSE_VERSUS = (
    "sma_7", "sma_20", "sma_50", "sma_100", "sma_200", "ema_9", "ema_12", "ema_26", "ema_50", "ema_200", "wma_20",
    "dema", "tema", "hma", "smma", "lsma", "mcginley", "vwma", "kama", "bb_middle", "kc_middle", "dc_middle", "vwap",
    "ichimoku_base", "psar", "last_swing_high", "last_swing_low",
)
LOW_BULLISH_HIGH_BEARISH = {
    "rsi": (30, 70), "rsi_30": (30, 70), "connors_rsi": (25, 75), "stoch_k": (20, 80), "stoch_d": (20, 80),
    "stoch_rsi": (0.2, 0.8), "stoch_rsi_k": (20, 80), "stoch_rsi_d": (20, 80), "smi": (-40, 40), "smi_signal": (-40, 40),
    "smi_ergodic": (-20, 20), "smi_ergodic_signal": (-20, 20), "williams_r": (-80, -20), "cci": (-100, 100),
    "woodies_cci": (-100, 100), "woodies_cci_signal": (-100, 100), "mfi": (20, 80), "ultimate_osc": (30, 70),
    "bb_pct": (0.2, 0.8), "kc_pct": (0.2, 0.8), "dc_pct": (0.2, 0.8), "choppiness": (38.2, 61.8),
    "aroon_down": (30, 70), "bear_power": (0, 0),
}
HIGH_BULLISH_LOW_BEARISH = {
    "ao": (0, 0), "macd": (0, 0), "macd_hist": (0, 0), "ppo": (0, 0), "ppo_hist": (0, 0), "kst": (0, 0), "kst_signal": (0, 0),
    "dpo": (0, 0), "tsi": (0, 0), "trix": (0, 0), "trix_signal": (0, 0), "cmf": (0, 0), "force_index": (0, 0),
    "force_index_ema": (0, 0), "eom": (0, 0), "eom_sma": (0, 0), "chaikin_osc": (0, 0), "bop": (0, 0), "bull_power": (0, 0),
    "momentum": (0, 0), "momentum_pct": (0, 0), "roc": (0, 0), "roc_20": (0, 0), "vortex_diff": (0, 0),
    "aroon_osc": (-50, 50), "aroon_up": (30, 70),
}
LINE_VERSUS_LINE = {
    "macd_signal": ("macd", "macd_signal"), "ppo_signal": ("ppo", "ppo_signal"), "di_plus": ("di_plus", "di_minus"),
    "di_minus": ("di_plus", "di_minus"), "vortex_pos": ("vortex_pos", "vortex_neg"), "vortex_neg": ("vortex_pos", "vortex_neg"),
    "ichimoku_conversion": ("ichimoku_conversion", "ichimoku_base"),
}
BAND_TOUCH = {"bb_upper": 1, "kc_upper": 1, "dc_upper": 1, "bb_lower": -1, "kc_lower": -1, "dc_lower": -1}
DIRECTION_OF_CHANGE = ("obv", "vpt", "nvi", "ad")
FLAG_BULLISH = (
    "swing_low", "pullback_complete_bull", "higher_lows_pattern", "near_fib_236", "near_fib_382", "near_fib_500", "near_fib_618",
    "near_fib_786", "healthy_bull_pullback", "failed_pullback_bear", "abc_pullback_bull", "volume_decreasing", "higher_highs",
    "volume_divergence",
)
FLAG_BEARISH = (
    "swing_high", "pullback_complete_bear", "lower_highs_pattern", "healthy_bear_pullback", "failed_pullback_bull",
    "abc_pullback_bear", "lower_lows",
)
SIGNED = ("trend_short", "trend_medium", "trend_long", "volume_breakout", "momentum_continuation", "volume_breakout_confirmation")
CATEGORY = {
    "pullback_depth": (("shallow", "moderate"), ("deep",)),
    "pullback_stage": (("impulse_up", "resumption_bull"), ("impulse_down", "resumption_bear")),
    "trend_structure": (("strong_uptrend", "uptrend"), ("strong_downtrend", "downtrend")),
    "market_structure": (("strong_trend", "trending"), ()),
}
HELD_BULLISH = ("structure_break_bullish", "false_breakout_bullish", "momentum_divergence_bullish")
HELD_BEARISH = ("structure_break_bearish", "false_breakout_bearish", "momentum_divergence_bearish")
HELD_SIGNED = {"equal_highs_lows": -1, "swing_failure": 1}
HOLD_BARS = {"4h": 4, "1h": 4, "15m": 3, "5m": 5, "1m": 1}
HOLD_DEFAULT = 5
ABOVE_MEDIAN_BULLISH = ("bb_width", "bb_bandwidth", "kc_width", "dc_width", "atr", "atr_percent", "adr")
MEDIAN_BAND = (0.5, 1.5)
ULCER_BAND = (0.7, 1.3)
BULLISH_CANDLES = (
    "hammer", "inverted_hammer", "bullish_engulfing", "bullish_harami", "piercing_line", "morning_star", "morning_doji_star",
    "three_white_soldiers", "three_inside_up", "three_outside_up", "rising_three_methods", "upside_tasuki_gap",
    "abandoned_baby_bull", "belt_hold_bull", "breakaway_bull", "separating_lines_bull", "side_by_side_white_lines",
    "homing_pigeon", "matching_low", "doji_star_bull", "kicking_bull", "kicking_by_length_bull",
)
BEARISH_CANDLES = (
    "hanging_man", "shooting_star", "bearish_engulfing", "bearish_harami", "dark_cloud_cover", "evening_star",
    "evening_doji_star", "three_black_crows", "three_inside_down", "three_outside_down", "falling_three_methods",
    "downside_tasuki_gap", "abandoned_baby_bear", "belt_hold_bear", "breakaway_bear", "separating_lines_bear",
    "counterattack_bear", "matching_high", "doji_star_bear", "kicking_bear", "kicking_by_length_bear",
)
BULLISH_CHARTS = (
    "double_bottom", "triple_bottom", "inverse_head_and_shoulders", "bullish_flag", "bullish_pennant", "falling_wedge",
    "cup_and_handle",
)
BEARISH_CHARTS = (
    "double_top", "triple_top", "head_and_shoulders", "bearish_flag", "bearish_pennant", "rising_wedge",
    "inverted_cup_and_handle",
)
# ---- end of fixed values ----

STATES: dict[str, str] = {}


def _code(up: Column, down: Column | None = None) -> Column:
    c = F.when(up, F.lit(1))
    if down is not None:
        c = c.when(down, F.lit(-1))
    return c.otherwise(F.lit(0))


def _state(signal: str, deps: Sequence[str], build, back: int = 0):
    STATES[signal] = f"state_{signal}"
    native(f"state_{signal}", deps, build, back=back, group="mapped")


for _s in CLOSE_VERSUS:
    _state(_s, ["close", _s], lambda s=_s: _code(F.col("close") > F.col(s), F.col("close") < F.col(s)))
for _s, (_lo, _hi) in LOW_BULLISH_HIGH_BEARISH.items():
    _state(_s, [_s], lambda s=_s, lo=_lo, hi=_hi: _code(F.col(s) < lo, F.col(s) > hi))
for _s, (_lo, _hi) in HIGH_BULLISH_LOW_BEARISH.items():
    _state(_s, [_s], lambda s=_s, lo=_lo, hi=_hi: _code(F.col(s) > hi, F.col(s) < lo))
for _s, (_a, _b) in LINE_VERSUS_LINE.items():
    _state(_s, [_a, _b], lambda a=_a, b=_b: _code(F.col(a) > F.col(b), F.col(a) < F.col(b)))
for _s, _d in BAND_TOUCH.items():
    _state(_s, ["close", _s], lambda s=_s, d=_d: F.when(
        F.col("close") > F.col(s) if d > 0 else F.col("close") < F.col(s), F.lit(d)).otherwise(F.lit(0)))
for _s in DIRECTION_OF_CHANGE:
    _state(_s, [_s], lambda s=_s: _code(diff(s) > 0, diff(s) < 0), back=1)
for _s in FLAG_BULLISH:
    _state(_s, [_s], lambda s=_s: _code(F.col(s) == 1))
for _s in FLAG_BEARISH:
    _state(_s, [_s], lambda s=_s: F.when(F.col(s) == 1, F.lit(-1)).otherwise(F.lit(0)))
for _s in SIGNED:
    _state(_s, [_s], lambda s=_s: _code(F.col(s) == 1, F.col(s) == -1))
for _s, (_up, _down) in CATEGORY.items():
    _state(_s, [_s], lambda s=_s, u=_up, d=_down: _code(F.col(s).isin(*u), F.col(s).isin(*d) if d else None))
_state("adx", ["adx", "di_plus", "di_minus"],
       lambda: _code((F.col("adx") > 25) & (F.col("di_plus") > F.col("di_minus")),
                     (F.col("adx") > 25) & (F.col("di_minus") > F.col("di_plus"))))
_state("mass_index", ["mass_index"], lambda: F.when(F.col("mass_index") > 27, F.lit(-1)).otherwise(F.lit(0)))
for _s in ("ichimoku_a", "ichimoku_b"):
    _state(_s, ["close", "ichimoku_a", "ichimoku_b"],
           lambda: _code(F.col("close") > F.greatest("ichimoku_a", "ichimoku_b"),
                         F.col("close") < F.least("ichimoku_a", "ichimoku_b")))
_state("ichimoku_lagging", ["close", "ichimoku_lagging"],
       lambda: _code(F.col("ichimoku_lagging") > lag("close", 26), F.col("ichimoku_lagging") < lag("close", 26)), back=26)
_state("sr_confluence_score", ["sr_confluence_score"], lambda: _code(F.col("sr_confluence_score") >= 3))
_state("pullback_quality_score", ["pullback_quality_score"], lambda: _code(F.col("pullback_quality_score") >= 70))
_state("measured_move_bull_target", ["distance_to_bull_target_pct"],
       lambda: F.when(F.col("distance_to_bull_target_pct") > 20, F.lit(-1)).otherwise(F.lit(0)))
_state("measured_move_bear_target", ["distance_to_bear_target_pct"], lambda: _code(F.col("distance_to_bear_target_pct") > 20))


def _held(event: Column) -> Column:
    """The newest event state, while it is at most the timeframe's hold old."""
    limit = F.lit(HOLD_DEFAULT)
    for tf, k in HOLD_BARS.items():
        limit = F.when(F.col("timeframe") == tf, F.lit(k)).otherwise(limit)
    fired = event != 0
    w = span(-HOLD_DEFAULT, 0)
    newest = F.last(F.when(fired, F.struct(event.alias("s"), F.col("_i").alias("i"))), ignorenulls=True).over(w)
    return F.when(F.col("_i") - newest["i"] <= limit, newest["s"]).otherwise(F.lit(0))


for _s in HELD_BULLISH:
    _state(_s, [_s], lambda s=_s: _held(_code(F.col(s) == 1)), back=HOLD_DEFAULT)
for _s in HELD_BEARISH:
    _state(_s, [_s], lambda s=_s: _held(F.when(F.col(s) == 1, F.lit(-1)).otherwise(F.lit(0))), back=HOLD_DEFAULT)
for _s, _d in HELD_SIGNED.items():
    _state(_s, [_s], lambda s=_s, d=_d: _held(_code(F.col(s) == d, F.col(s) == -d)), back=HOLD_DEFAULT)
for _p in [f"pattern_{c}" for c in (*CANDLES, *PLACEHOLDERS)] + list(CHARTS):
    _d = (1 if _p[8:] in BULLISH_CANDLES + BULLISH_CHARTS else -1 if _p[8:] in BEARISH_CANDLES + BEARISH_CHARTS else 0)
    _state(_p, [_p], lambda p=_p, d=_d: F.when(F.col(p) == 1, F.lit(d)).otherwise(F.lit(0)))

MEDIAN_SIGNALS = tuple(s for s in (*ABOVE_MEDIAN_BULLISH, "ulcer_index") if s in REGISTRY)


def state_table(bars: DataFrame, signals: Sequence[str], block_rows: int = BLOCK_ROWS, extra: Sequence[str] = ()) -> DataFrame:
    """Bars with one state column per signal, plus the ``extra`` features.

    Signals judged against their own median need it once per series; it comes from a distributed exact
    quantile and is joined back.
    """
    by_median = [s for s in signals if s in MEDIAN_SIGNALS]
    plain = [s for s in signals if s not in MEDIAN_SIGNALS]
    df = compute(bars, [*[STATES[s] for s in plain], *by_median, *extra], block_rows)
    if by_median:
        med = grouped_quantiles(df, SERIES, by_median, [0.5])
        wide = med.groupBy(*SERIES).agg(*[
            F.max(F.when(F.col("metric") == s, F.col("value"))).alias(f"_med_{s}") for s in by_median])
        df = df.join(wide, list(SERIES), "left")
        for s in by_median:
            v, m = F.col(s), F.col(f"_med_{s}")
            code = (_code(v < m * ULCER_BAND[0], v > m * ULCER_BAND[1]) if s == "ulcer_index" else _code(v > m * MEDIAN_BAND[1]))
            df = df.withColumn(f"state_{s}", code)
        df = df.drop(*[f"_med_{s}" for s in by_median])
    return df


def state_long(wide: DataFrame, signals: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(series, ts, signal, state) rows from the state columns."""
    cols = [F.col(f"state_{s}").alias(s) for s in signals]
    w = wide.select(*SERIES, "ts", *keep, *cols)
    return w.unpivot([*SERIES, "ts", *keep], list(signals), "signal", "code")


def state_name(code: Column | str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == 1, "bullish").when(c == -1, "bearish").otherwise("neutral")


def all_signals() -> list[str]:
    return [*STATES, *MEDIAN_SIGNALS]


def unmapped_features(columns: Sequence[str]) -> list[str]:
    """Feature columns no state rule covers."""
    known = set(all_signals())
    return sorted(c for c in columns if c not in known)


def debounced(state: str, k: int = 2) -> Column:
    """A state counts once it has held for k bars in a row, otherwise neutral."""
    w = span(-(k - 1), 0)
    same = (F.min(state).over(w) == F.max(state).over(w)) & (F.count(state).over(w) == k)
    return F.when(same, F.col(state)).otherwise(F.lit(0))
