"""Regime instances: greedy segments of a series, each described by one row."""

from __future__ import annotations

from functools import reduce


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import lag, lead, rstd
from barloom.functions.registry import compute, native
from barloom.operators.blocks import BLOCK_ROWS, SERIES, span
from barloom.operators.scan import block_scan
from barloom.session import cut_lineage

MIN_BARS, MAX_BARS, VOL_JUMP, ROTATE = 24, 168, 0.25, 10

native("seg_volatility", ["_pct1"], lambda: F.coalesce(rstd("_pct1", 20), F.lit(0.0)), back=20)
native("seg_structure", ["high"],
       lambda: F.when(F.count("high").over(span(-20, -1)) < 20, 0)
       .when(lag("high") > F.max("high").over(span(-20, -2)), 1)
       .when(lag("high") < F.min("high").over(span(-20, -2)), -1).otherwise(0), back=20)
native("seg_momentum", ["rsi", "macd_hist", "ppo"],
       lambda: (F.col("rsi") - 50) / 50 + F.signum("macd_hist") + F.signum("ppo"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; by 0 it is infinite, or NaN for 0 by 0."""
    return F.when(b == 0, a * float("inf")).otherwise(F.try_divide(a, b))


for _h in (24, 72, 168):
    # Unlike the labels, which are 0 there, an outcome after a close of 0 is infinite.
    native(f"outcome_{_h}", ["close"], lambda h=_h: (ratio(lead("close", h), F.col("close")) - 1) * 100, ahead=_h)


def _trigger() -> Column:
    before = lag("seg_volatility")
    jump = (before > 0) & (F.abs(F.col("seg_volatility") - before) / before > VOL_JUMP)
    was, now = lag("seg_structure", ROTATE), F.col("seg_structure")
    rotated = (was != 0) & (now != 0) & (was != now)
    flipped = lag("seg_momentum", ROTATE) * F.col("seg_momentum") < -0.5
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in (jump, rotated, flipped)])


native("seg_trigger", ["seg_volatility", "seg_structure", "seg_momentum"], _trigger, back=ROTATE)


def cut_kernel(min_bars: int = MIN_BARS, max_bars: int = MAX_BARS):
    """Greedy cuts. State: row number the running segment began at."""
    def run(rows: pd.DataFrame, state):
        rn, trig = rows["_rn"].to_numpy(), rows["seg_trigger"].to_numpy()
        out = np.empty(len(rows), dtype=np.int64)
        start = (rn[0] if len(rows) else 0) if state is None else int(state[0])
        for i in range(len(rows)):
            age = rn[i] - start
            if age >= min_bars and (trig[i] or age >= max_bars):
                start = rn[i]
            out[i] = start
        return {"seg_start": out, "pos": rn - out}, [float(start)]

    return run


# ---- Fixed values: columns summed into the descriptive lists and maps of an instance. ----
PRICE_ACTION = {
    "bullish_structure_break": "structure_break_bullish", "bearish_structure_break": "structure_break_bearish",
    "healthy_bull_pullback": "healthy_bull_pullback", "healthy_bear_pullback": "healthy_bear_pullback",
    "fibonacci_618_bounce": "near_fib_618",
}
CANDLE_SETS = {
    "bullish": ("hammer", "bullish_engulfing", "morning_star", "piercing_line", "three_white_soldiers"),
    "bearish": ("shooting_star", "bearish_engulfing", "evening_star", "dark_cloud_cover", "three_black_crows"),
    "neutral": ("doji",),
}
CHART_SET = ("cup_and_handle", "bullish_flag", "bearish_flag", "triangle", "rising_wedge", "falling_wedge")
PEAK_SET = ("double_top", "double_bottom", "head_and_shoulders")
INDICATORS = ("rsi", "macd_hist", "ppo", "adx", "atr_percent", "bb_width", "obv")
# ---- end of fixed values ----
NEEDED = ["swing_high", "swing_low", "rsi", "macd_hist", "ppo", "adx", "atr", "atr_percent", "bb_width", "obv", "seg_trigger",
          "pullback_depth", "pullback_from_high_pct", "failed_pullback_bull", "failed_pullback_bear"]
OUTCOMES = ["outcome_24", "outcome_72", "outcome_168", "max_favorable_excursion_1d", "max_adverse_excursion_1d"]


def segments(features: DataFrame, min_bars: int = MIN_BARS, max_bars: int = MAX_BARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with ``seg_start`` and ``pos``; an unfinished tail shorter than the minimum is left out.

    The sequential part sees one flag per bar; everything else joins back on the key.
    """
    narrow = features.select(*SERIES, "ts", "seg_trigger")
    cuts = block_scan(narrow, cut_kernel(min_bars, max_bars), {"seg_start": T.LongType(), "pos": T.LongType()},
                      back=4 * max_bars, block_rows=max(block_rows, 4 * max_bars)).drop("seg_trigger")
    sized = cuts.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*SERIES, "seg_start")))
    return features.join(sized.where(F.col("_n") >= min_bars).drop("_n"), [*SERIES, "ts"])


def _trend(x: str) -> Column:
    """Direction of a line fit relative to the range of the values."""
    reach = F.max(x) - F.min(x)
    slope = F.try_divide(F.regr_slope(F.col(x).cast("double"), F.col("pos").cast("double")), reach)
    return F.when(F.count(x) < 3, "stable").when(slope > 0.1, "increasing").when(slope < -0.1, "decreasing").otherwise("stable")


def _indicator_rows(seg: DataFrame, key: list[str]) -> DataFrame:
    """(instance, indicator) statistics, one shuffle for all indicators."""
    long = seg.select(*key, "pos", *[F.col(c).cast("double").alias(c) for c in INDICATORS]).unpivot(
        [*key, "pos"], list(INDICATORS), "indicator_name", "value")
    return long.groupBy(*key, "indicator_name").agg(
        F.avg("value").alias("mean_value"), F.stddev_samp("value").alias("std_value"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), _trend("value").alias("trend"),
        F.percentile("value", F.lit(0.7)).alias("_q70"), F.percentile("value", F.lit(0.3)).alias("_q30"))


def confirming(name: Column, mean: Column, trend: Column, q70: Column, q30: Column) -> Column:
    """The state an indicator confirms over an instance, null when it confirms none."""
    def by(n, up, up_name, down, down_name):
        return (name == n, F.when(up, up_name).when(down, down_name))

    rules = [
        by("rsi", mean > 55, "rsi_bullish", mean < 45, "rsi_bearish"),
        by("macd_hist", mean > 0, "macd_bullish", mean < 0, "macd_bearish"),
        by("ppo", mean > 0, "ppo_bullish", mean < 0, "ppo_bearish"),
        by("adx", mean > 25, "adx_strong_trend", mean < 20, "adx_ranging"),
        by("atr_percent", mean > 3, "high_volatility", mean < 1, "low_volatility"),
        by("bb_width", mean > q70, "bb_expanding", mean < q30, "bb_contracting"),
        by("obv", trend == "increasing", "obv_accumulation", trend == "decreasing", "obv_distribution"),
    ]
    out = F.lit(None).cast("string")
    for cond, value in rules:
        out = F.when(cond, value).otherwise(out)
    return out


def confirmation_strength(name: Column, mean: Column, std: Column, trend: Column) -> Column:
    """50 plus bonuses for steadiness, extreme level and a clear trend, at most 100."""
    cv = F.try_divide(std, F.abs(mean))
    steady = F.when(cv < 0.1, 20).when(cv < 0.2, 10).otherwise(0)
    level = F.when(name.contains("rsi"), F.when((mean > 70) | (mean < 30), 20).when((mean > 60) | (mean < 40), 10).otherwise(0)).when(
        name.contains("adx"), F.when(mean > 40, 20).when(mean > 25, 10).otherwise(0)).otherwise(0)
    moving = F.when(trend.isin("increasing", "decreasing"), 10).otherwise(0)
    return F.least(F.lit(100), F.lit(50) + F.coalesce(steady, F.lit(0)) + level + moving).cast("double")


def structure_name(bars: Column, slope: Column, adx: Column, vol_ratio: Column) -> Column:
    side = lambda s: F.when(slope > 0, f"trending_up_{s}").otherwise(f"trending_down_{s}")
    return F.when(bars < 20, "insufficient_data").when(adx > 25, side("strong")).when(adx > 15, side("moderate")).when(
        vol_ratio > 0.4, "volatile_choppy").otherwise("ranging_tight")


def describe(seg: DataFrame, with_peaks: bool = True) -> DataFrame:
    """One row per segment with price, swing, structure, indicator, pattern and outcome columns."""
    key = [*SERIES, "seg_start"]
    ws = Window.partitionBy(*key).orderBy("pos")
    w5 = ws.rowsBetween(-5, -1)
    whole = Window.partitionBy(*key)
    vol_mean, vol_std = F.avg("volume").over(whole), F.stddev_pop("volume").over(whole)
    crossed = F.signum("macd_hist") != F.lag(F.signum("macd_hist")).over(ws)
    late = F.col("pos") >= 5
    s = seg.withColumns({
        "_spike": (vol_std > 0) & (F.col("volume") > vol_mean + 2 * vol_std), "_cross": F.coalesce(crossed, F.lit(False)),
        "_hh": late & (F.col("high") > F.max("high").over(w5)), "_hl": late & (F.col("low") > F.max("low").over(w5)),
        "_lh": late & (F.col("high") < F.min("high").over(w5)), "_ll": late & (F.col("low") < F.min("low").over(w5)),
    })
    candles = [(side, c) for side, names in CANDLE_SETS.items() for c in names if f"pattern_{c}" in seg.columns]
    charts = [c for c in (*CHART_SET, *(PEAK_SET if with_peaks else ())) if f"pattern_{c}" in seg.columns]
    action = [(n, c) for n, c in PRICE_ACTION.items() if c in seg.columns]
    swing_rows = lambda side: F.transform(F.array_sort(F.collect_list(
        F.when(F.col(f"swing_{side}") == 1, F.struct("pos", F.col(side).alias("v"))))), lambda x: x["v"])
    positions = F.array_sort(F.concat(F.collect_list(F.when(F.col("swing_high") == 1, F.col("seg_start") + F.col("pos"))),
                                      F.collect_list(F.when(F.col("swing_low") == 1, F.col("seg_start") + F.col("pos")))))
    n_of = lambda c: F.sum(F.col(c).cast("int"))
    agg = s.groupBy(*key).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("bar_count"),
        F.min_by("close", "pos").alias("_p0"), F.max_by("close", "pos").alias("_p1"), F.max("high").alias("_hi"), F.min("low").alias("_lo"),
        F.sum(F.col("swing_high") + F.col("swing_low")).alias("swing_count"), F.concat(swing_rows("high"), swing_rows("low")).alias("_sw"),
        F.regr_slope("close", F.col("pos").cast("double")).alias("_slope"), F.avg("adx").alias("adx_mean"), F.avg("atr").alias("volatility_mean"),
        F.stddev_samp("atr").alias("volatility_std"), _trend("atr").alias("volatility_trend"), F.avg("rsi").alias("rsi_mean"),
        F.stddev_samp("rsi").alias("rsi_std"), _trend("rsi").alias("rsi_trend"), F.avg("macd_hist").alias("macd_hist_mean"),
        n_of("_cross").alias("macd_crossovers"), _trend("adx").alias("adx_trend"), F.avg("volume").alias("volume_mean"),
        _trend("volume").alias("volume_trend"), n_of("_spike").alias("volume_spikes"),
        *[F.when(F.count(F.lit(1)) < 10, 0).otherwise(n_of(c)).alias(n) for c, n in (
            ("_hh", "higher_highs"), ("_hl", "higher_lows"), ("_lh", "lower_highs"), ("_ll", "lower_lows"))],
        F.sum((F.col("pullback_depth") != "none").cast("int")).alias("pullback_count"),
        F.avg(F.when(F.col("pullback_depth") != "none", F.abs("pullback_from_high_pct"))).alias("avg_pullback_depth_pct"),
        F.sum(F.col("failed_pullback_bull") + F.col("failed_pullback_bear")).alias("failed_pullbacks"),
        positions.alias("swing_indices"),
        *[F.max_by(c, "pos").alias(c) for c in OUTCOMES],
        *[F.sum(f"pattern_{c}").alias(f"_c_{c}") for _, c in candles], *[F.sum(f"pattern_{c}").alias(f"_h_{c}") for c in charts],
        *[F.sum(c).alias(f"_a_{n}") for n, c in action],
    )
    vol_ratio = F.coalesce(F.try_divide(F.col("volatility_mean"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    moves = F.transform(F.sequence(F.lit(1), F.size("_sw") - 1), lambda i: ratio(
        F.abs(F.get("_sw", i) - F.get("_sw", i - 1)), F.get("_sw", i - 1)) * 100)
    mean_move = F.when(F.size("_sw") > 1, F.aggregate(moves, F.lit(0.0), lambda a, x: a + x) / (F.size("_sw") - 1)).otherwise(0.0)

    def counts(side):
        pairs = [x for sd, c in candles if sd == side for x in (F.lit(c), F.col(f"_c_{c}").cast("int"))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v > 0) if pairs else F.create_map().cast("map<string,int>")

    out = agg.withColumns({
        "instance_id": F.concat_ws("_", "pair", "timeframe", F.date_format("start_time", "yyyyMMdd_HHmm")),
        "duration_hours": (F.unix_seconds("end_time") - F.unix_seconds("start_time")) / 3600.0,
        "price_change_pct": (ratio(F.col("_p1"), F.col("_p0")) - 1) * 100, "max_drawdown_pct": (ratio(F.col("_lo"), F.col("_p0")) - 1) * 100,
        "max_runup_pct": (ratio(F.col("_hi"), F.col("_p0")) - 1) * 100, "avg_swing_magnitude_pct": mean_move,
        "dominant_structure": structure_name(F.col("bar_count"), F.col("_slope"), F.coalesce("adx_mean", F.lit(0.0)), vol_ratio),
        "chart_patterns": F.array_compact(F.array(*[F.when(F.col(f"_h_{c}") > 0, F.lit(c)) for c in charts])),
        "price_action_patterns": F.array_compact(F.array(*[F.when(F.col(f"_a_{n}") > 0, F.lit(n)) for n, _ in action])),
        **{f"{side}_patterns": counts(side) for side in CANDLE_SETS},
    })
    ind = _indicator_rows(seg, key)
    ind = ind.withColumns({
        "confirms": confirming(F.col("indicator_name"), F.col("mean_value"), F.col("trend"), F.col("_q70"), F.col("_q30")),
        "strength": confirmation_strength(F.col("indicator_name"), F.col("mean_value"), F.col("std_value"), F.col("trend")),
    })
    packed = ind.groupBy(*key).agg(
        F.array_sort(F.collect_list("confirms")).alias("confirming_indicators"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("indicator_name", F.struct(
            F.col("mean_value").alias("mean"), F.col("std_value").alias("std"), F.col("min_value").alias("min"),
            F.col("max_value").alias("max"), "trend", "confirms", "strength"))))).alias("indicator_values"))
    out = out.join(packed, key)
    aligned = F.when((F.col("rsi_mean") > 55) | (F.col("rsi_mean") < 45), 1).otherwise(0) + F.when(F.col("macd_hist_mean") != 0, 1).otherwise(0)
    steadiness = F.when(F.col("volatility_std") > 0, (1 - F.least(F.col("volatility_std") / F.col("volatility_mean"), F.lit(1.0))) * 30).otherwise(0.0)
    st = F.col("dominant_structure")
    shape = F.when(st.like("trending_%_strong"), 40).when(st.like("trending_%_moderate"), 25).when(st == "ranging_tight", 20).otherwise(5)
    bulls = (F.when(F.col("rsi_mean") > 50, 1).otherwise(0) + F.when(F.col("macd_hist_mean") > 0, 1).otherwise(0)
             + F.when(F.array_contains("confirming_indicators", "macd_bullish"), 1).otherwise(0))
    nxt = F.nanvl(F.coalesce(F.col("outcome_24"), F.lit(0.0)), F.lit(0.0))
    predict = F.when((bulls > 0) & (nxt > 0), F.least(bulls / 3.0 * F.abs(nxt) * 10, F.lit(100.0))).when(
        (bulls == 0) & (nxt < 0), F.least(F.abs(nxt) * 10, F.lit(100.0))).otherwise(0.0)
    out = out.withColumns({"consistency_score": aligned / 2.0 * 30 + steadiness + shape, "predictability_score": predict})
    out = out.withColumnsRenamed({"outcome_24": "next_1d_return_pct", "outcome_72": "next_3d_return_pct", "outcome_168": "next_7d_return_pct"})
    return out.select("instance_id", *[c for c in out.columns if not c.startswith("_") and c != "instance_id"])


def instance_features(with_peaks: bool = True) -> list[str]:
    candles = [f"pattern_{c}" for names in CANDLE_SETS.values() for c in names]
    charts = [f"pattern_{c}" for c in (*CHART_SET, *(PEAK_SET if with_peaks else ()))]
    return list(dict.fromkeys([*NEEDED, *OUTCOMES, *candles, *charts, *PRICE_ACTION.values()]))


def discover_instances(bars: DataFrame, min_bars: int = MIN_BARS, max_bars: int = MAX_BARS, with_peaks: bool = True,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    # Read twice, by the cut pass (one flag per bar) and by the description.
    feats = cut_lineage(compute(bars, instance_features(with_peaks), block_rows))
    return describe(segments(feats, min_bars, max_bars, block_rows), with_peaks)


def child_tables(instances: DataFrame) -> dict[str, DataFrame]:
    """Instances as a master table and four child tables keyed by instance id."""
    nested = {"confirming_indicators", "indicator_values", "price_action_patterns", "bullish_patterns", "bearish_patterns",
              "neutral_patterns", "chart_patterns", "swing_indices"}
    ind = instances.select("instance_id", F.explode("indicator_values").alias("indicator_name", "v")).select(
        "instance_id", "indicator_name", F.col("v.mean").alias("mean_value"), F.col("v.std").alias("std_value"), F.col("v.min").alias("min_value"),
        F.col("v.max").alias("max_value"), F.col("v.trend").alias("trend"), F.col("v.strength").alias("confirmation_strength"),
        F.col("v.confirms").alias("confirms"))
    candles = reduce(lambda a, b: a.unionByName(b), [instances.select(
        "instance_id", F.explode(f"{side}_patterns").alias("pattern_name", "occurrence_count"), F.lit(side).alias("pattern_type")) for side in CANDLE_SETS])
    return {
        "regime_instances": instances.drop(*nested),
        "regime_confirming_indicators": ind,
        "regime_candlestick_patterns": candles.select("instance_id", "pattern_name", "pattern_type", "occurrence_count"),
        "regime_price_action_patterns": instances.select("instance_id", F.explode("price_action_patterns").alias("pattern_name")).withColumn(
            "occurrence_count", F.lit(1)),
        "regime_chart_patterns": instances.select("instance_id", F.explode("chart_patterns").alias("pattern_name")),
    }


def find_instances(instances: DataFrame, pair: str | None = None, timeframe: str | None = None, structure: str | None = None,
                   min_consistency: float | None = None, limit: int | None = None) -> DataFrame:
    """Instances by optional filters, newest first; all of them unless the caller asks for a page."""
    conds = [F.col(c) == v for c, v in (("pair", pair), ("timeframe", timeframe), ("dominant_structure", structure)) if v is not None]
    if min_consistency is not None:
        conds.append(F.col("consistency_score") >= min_consistency)
    out = reduce(lambda d, c: d.where(c), conds, instances).orderBy(F.desc("start_time"), "instance_id")
    return out if limit is None else out.limit(limit)


def indicator_statistics(tables: dict[str, DataFrame], indicator: str, min_strength: float = 50) -> DataFrame:
    ind = tables["regime_confirming_indicators"].where((F.col("indicator_name") == indicator) & (F.col("confirmation_strength") >= min_strength))
    cols = ["instance_id", "pair", "timeframe", "dominant_structure", "next_1d_return_pct", "next_3d_return_pct"]
    return ind.join(tables["regime_instances"].select(*cols), "instance_id")


def pattern_effectiveness(tables: dict[str, DataFrame], kind: str = "candlestick") -> DataFrame:
    child = tables["regime_candlestick_patterns" if kind == "candlestick" else "regime_price_action_patterns"]
    j = child.join(tables["regime_instances"].select("instance_id", "next_1d_return_pct", "next_3d_return_pct"), "instance_id")
    return j.groupBy("pattern_name").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("occurrence_count").alias("occurrences"), F.avg("next_1d_return_pct").alias("avg_1d_return"),
        F.avg("next_3d_return_pct").alias("avg_3d_return"), F.avg((F.col("next_1d_return_pct") > 0).cast("int")).alias("win_rate_1d"))


