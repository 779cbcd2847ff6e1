"""Confirmation rules on a row of indicator values, and the playbook they build per structure."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: (text, columns printed in it, condition). Missing values never confirm. ----
MOMENTUM_BULL = [
    ("RSI > 55 (%.1f)", ("rsi",), "rsi > 55"), ("RSI(30) Bullish (%.1f)", ("rsi_30",), "rsi_30 > 55"),
    ("Connors RSI Strong (%.1f)", ("connors_rsi",), "connors_rsi > 60"),
    ("Stochastic Bullish (K=%.1f, D=%.1f)", ("stoch_k", "stoch_d"), "stoch_k > stoch_d and stoch_k < 80"),
    ("Stochastic Overbought (K=%.1f)", ("stoch_k",), "stoch_k > 80"), ("Stoch RSI Bullish (%.1f)", ("stoch_rsi_k",), "stoch_rsi_k > 50"),
    ("Williams %%R Bullish (%.1f)", ("williams_r",), "williams_r > -50"), ("ROC Positive (%.2f%%)", ("roc",), "roc > 2"),
    ("ROC(20) Strong (%.2f%%)", ("roc_20",), "roc_20 > 5"), ("Momentum Positive (%.4f)", ("momentum",), "momentum > 0"),
    ("Momentum %% Strong (%.2f%%)", ("momentum_pct",), "momentum_pct > 2"), ("Ultimate Osc Bullish (%.1f)", ("ultimate_osc",), "ultimate_osc > 50"),
    ("TSI Positive (%.2f)", ("tsi",), "tsi > 0"), ("SMI Bullish Cross (%.2f)", ("smi",), "smi > smi_signal and smi > 0"),
    ("SMI Ergodic Positive (%.2f)", ("smi_ergodic",), "smi_ergodic > 0"), ("CCI Overbought (%.1f)", ("cci",), "cci > 100"),
    ("CCI Bullish (%.1f)", ("cci",), "cci > 0 and cci < 100"), ("Woodies CCI Bullish", (), "woodies_cci > woodies_cci_signal"),
]
MOMENTUM_BEAR = [
    ("RSI < 45 (%.1f)", ("rsi",), "rsi < 45"), ("RSI(30) Bearish (%.1f)", ("rsi_30",), "rsi_30 < 45"),
    ("Connors RSI Weak (%.1f)", ("connors_rsi",), "connors_rsi < 40"),
    ("Stochastic Bearish (K=%.1f, D=%.1f)", ("stoch_k", "stoch_d"), "stoch_k < stoch_d and stoch_k > 20"),
    ("Stochastic Oversold (K=%.1f)", ("stoch_k",), "stoch_k < 20"), ("Stoch RSI Bearish (%.1f)", ("stoch_rsi_k",), "stoch_rsi_k < 50"),
    ("Williams %%R Bearish (%.1f)", ("williams_r",), "williams_r < -50"), ("ROC Negative (%.2f%%)", ("roc",), "roc < -2"),
    ("ROC(20) Weak (%.2f%%)", ("roc_20",), "roc_20 < -5"), ("Momentum Negative (%.4f)", ("momentum",), "momentum < 0"),
    ("Momentum %% Weak (%.2f%%)", ("momentum_pct",), "momentum_pct < -2"), ("Ultimate Osc Bearish (%.1f)", ("ultimate_osc",), "ultimate_osc < 50"),
    ("TSI Negative (%.2f)", ("tsi",), "tsi < 0"), ("SMI Bearish Cross (%.2f)", ("smi",), "smi < smi_signal and smi < 0"),
    ("SMI Ergodic Negative (%.2f)", ("smi_ergodic",), "smi_ergodic < 0"), ("CCI Oversold (%.1f)", ("cci",), "cci < -100"),
    ("CCI Bearish (%.1f)", ("cci",), "cci < 0 and cci > -100"),
]
TREND_BULL = [
    ("MACD Histogram Positive (%.4f)", ("macd_hist",), "macd_hist > 0"), ("MACD Above Signal", (), "macd > macd_signal"),
    ("MACD in Positive Territory", (), "macd > 0"), ("PPO Positive (%.2f)", ("ppo",), "ppo > 0"), ("PPO Histogram Positive (%.2f)", ("ppo_hist",), "ppo_hist > 0"),
    ("ADX Strong Bullish Trend (%.1f)", ("adx",), "adx > 30 and di_plus > di_minus"),
    ("ADX Moderate Bullish Trend (%.1f)", ("adx",), "adx > 20 and adx <= 30 and di_plus > di_minus"),
    ("+DI > -DI (%.1f vs %.1f)", ("di_plus", "di_minus"), "adx > 20 and di_plus > di_minus"), ("Aroon Up Strong (%.1f)", ("aroon_up",), "aroon_up > 70"),
    ("Aroon Bullish (%.1f vs %.1f)", ("aroon_up", "aroon_down"), "aroon_up > aroon_down"), ("Aroon Oscillator Bullish (%.1f)", ("aroon_osc",), "aroon_osc > 50"),
    ("TRIX Above Signal", (), "trix > trix_signal"), ("TRIX Positive (%.4f)", ("trix",), "trix > 0"), ("DPO Positive (%.4f)", ("dpo",), "dpo > 0"),
    ("KST Above Signal", (), "kst > kst_signal"), ("Mass Index Reversal Signal (%.2f)", ("mass_index",), "mass_index > 27"),
    ("Awesome Oscillator Positive (%.4f)", ("ao",), "ao > 0"), ("Price Above Ichimoku Cloud", (), "close > greatest(ichimoku_a, ichimoku_b)"),
    ("Ichimoku TK Cross Bullish", (), "ichimoku_conversion > ichimoku_base"), ("Price Above PSAR", (), "close > psar"),
    ("Vortex Bullish (+VI=%.2f)", ("vortex_pos",), "vortex_pos > vortex_neg"), ("Vortex Diff Positive (%.2f)", ("vortex_diff",), "vortex_diff > 0"),
]
TREND_BEAR = [
    ("MACD Histogram Negative (%.4f)", ("macd_hist",), "macd_hist < 0"), ("MACD Below Signal", (), "macd < macd_signal"),
    ("MACD in Negative Territory", (), "macd < 0"), ("PPO Negative (%.2f)", ("ppo",), "ppo < 0"), ("PPO Histogram Negative (%.2f)", ("ppo_hist",), "ppo_hist < 0"),
    ("ADX Strong Bearish Trend (%.1f)", ("adx",), "adx > 30 and di_minus > di_plus"),
    ("ADX Moderate Bearish Trend (%.1f)", ("adx",), "adx > 20 and adx <= 30 and di_minus > di_plus"),
    ("-DI > +DI (%.1f vs %.1f)", ("di_minus", "di_plus"), "adx > 20 and di_minus > di_plus"), ("Aroon Down Strong (%.1f)", ("aroon_down",), "aroon_down > 70"),
    ("Aroon Bearish (%.1f vs %.1f)", ("aroon_down", "aroon_up"), "aroon_down > aroon_up"), ("Aroon Oscillator Bearish (%.1f)", ("aroon_osc",), "aroon_osc < -50"),
    ("TRIX Below Signal", (), "trix < trix_signal"), ("TRIX Negative (%.4f)", ("trix",), "trix < 0"), ("DPO Negative (%.4f)", ("dpo",), "dpo < 0"),
    ("KST Below Signal", (), "kst < kst_signal"), ("Awesome Oscillator Negative (%.4f)", ("ao",), "ao < 0"),
    ("Price Below Ichimoku Cloud", (), "close < least(ichimoku_a, ichimoku_b)"), ("Ichimoku TK Cross Bearish", (), "ichimoku_conversion < ichimoku_base"),
    ("Price Below PSAR", (), "close < psar"), ("Vortex Bearish (-VI=%.2f)", ("vortex_neg",), "vortex_neg > vortex_pos"),
    ("Vortex Diff Negative (%.2f)", ("vortex_diff",), "vortex_diff < 0"),
]
RANGING = [
    ("RSI Neutral (45-55): %.1f", ("rsi",), "rsi between 45 and 55"), ("ADX < 20 (Ranging): %.1f", ("adx",), "adx < 20"),
    ("BB Squeeze (Width=%.4f)", ("bb_width",), "bb_width < 0.02"), ("Choppy Market (Chop=%.1f)", ("choppiness",), "choppiness > 60"),
    ("Low Volume (Z=%.2f)", ("volume_zscore",), "volume_zscore < -0.5"),
]
RANGING_PATTERNS = [("Price Mid-Bollinger Band", (), "bb_pct between 0.4 and 0.6"), ("Price Mid-Keltner Channel", (), "kc_pct between 0.4 and 0.6")]
VOLUME_BULL = [
    ("OBV Rising", (), "obv_change > 0"), ("CMF Strong Positive (%.3f)", ("cmf",), "cmf > 0.1"), ("CMF Positive (%.3f)", ("cmf",), "cmf > 0 and cmf <= 0.1"),
    ("MFI Bullish (%.1f)", ("mfi",), "mfi > 50"), ("MFI Overbought (%.1f)", ("mfi",), "mfi > 80"), ("Force Index Positive", (), "force_index > 0"),
    ("Force Index EMA Bullish", (), "force_index_ema > 0"), ("A/D Line Positive", (), "ad > 0"),
    ("Chaikin Osc Positive (%.2e)", ("chaikin_osc",), "chaikin_osc > 0"), ("Ease of Movement Positive", (), "eom > 0"), ("EOM SMA Positive", (), "eom_sma > 0"),
    ("VPT Rising", (), "vpt > 0"), ("NVI Value: %.2f", ("nvi",), "nvi is not null"), ("Extreme Volume Surge (Z=%.2f)", ("volume_zscore",), "volume_zscore > 2"),
    ("High Volume (Z=%.2f)", ("volume_zscore",), "volume_zscore > 1 and volume_zscore <= 2"),
    ("Volume Increasing (%.2f%%)", ("volume_roc * 100",), "volume_roc > 0.5"), ("Balance of Power Bullish (%.2f)", ("bop",), "bop > 0.5"),
    ("Volume Spike Detected", (), "volume_spike = 1"),
]
VOLUME_BEAR = [
    ("OBV Falling", (), "obv_change < 0"), ("CMF Strong Negative (%.3f)", ("cmf",), "cmf < -0.1"), ("CMF Negative (%.3f)", ("cmf",), "cmf < 0 and cmf >= -0.1"),
    ("MFI Bearish (%.1f)", ("mfi",), "mfi < 50"), ("MFI Oversold (%.1f)", ("mfi",), "mfi < 20"), ("Force Index Negative", (), "force_index < 0"),
    ("Force Index EMA Bearish", (), "force_index_ema < 0"), ("A/D Line Negative", (), "ad < 0"),
    ("Chaikin Osc Negative (%.2e)", ("chaikin_osc",), "chaikin_osc < 0"), ("Ease of Movement Negative", (), "eom < 0"), ("EOM SMA Negative", (), "eom_sma < 0"),
    ("VPT Falling", (), "vpt < 0"), ("Volume Decreasing (%.2f%%)", ("volume_roc * 100",), "volume_roc < -0.3"),
    ("Balance of Power Bearish (%.2f)", ("bop",), "bop < -0.5"), ("Volume Decreasing (Potential Reversal)", (), "volume_decreasing = 1"),
]
VOLATILITY_BULL = [
    ("Price Near Lower BB (%.2f%%) - Potential Bounce", ("bb_pct * 100",), "bb_pct < 0.2"),
    ("Price Near Upper BB (%.2f%%) - Strong Momentum", ("bb_pct * 100",), "bb_pct > 0.8"),
    ("BB Squeeze (%.4f) - Breakout Potential", ("bb_width",), "bb_width < 0.02"), ("BB Expansion (%.4f) - High Volatility", ("bb_width",), "bb_width > 0.05"),
    ("Price Mid-Keltner (Neutral Zone)", (), "kc_pct > 0.3 and kc_pct < 0.7"), ("Price Near Upper KC (Strong)", (), "kc_pct > 0.8"),
    ("Low Volatility (ATR=%.2f%%) - Consolidation", ("atr_percent",), "atr_percent < 1.5"),
    ("High Volatility (ATR=%.2f%%) - Trending", ("atr_percent",), "atr_percent > 3"), ("ATR Ratio: %.4f", ("atr_ratio",), "atr_ratio is not null"),
    ("Price Near Donchian Upper (Breakout)", (), "dc_pct > 0.8"), ("Low Drawdown Risk (Ulcer=%.2f)", ("ulcer_index",), "ulcer_index < 2"),
    ("Bull Power Positive (%.4f)", ("bull_power",), "bull_power > 0"), ("Bear Power Weakening", (), "bear_power > -0.5"),
    ("Low Chop (%.1f) - Trending", ("choppiness",), "choppiness < 40"), ("Low Variance (%.4f)", ("normalized_variance",), "normalized_variance < 0.02"),
]
VOLATILITY_BEAR = [
    ("Price Near Upper BB (%.2f%%) - Potential Reversal", ("bb_pct * 100",), "bb_pct > 0.8"),
    ("Price Near Lower BB (%.2f%%) - Weak Momentum", ("bb_pct * 100",), "bb_pct < 0.2"), ("Price Near Lower KC (Weak)", (), "kc_pct < 0.2"),
    ("High Drawdown Risk (Ulcer=%.2f)", ("ulcer_index",), "ulcer_index > 5"), ("Bull Power Weakening", (), "bull_power < -0.5"),
    ("Bear Power Negative (%.4f)", ("bear_power",), "bear_power < 0"), ("High Chop (%.1f) - Sideways", ("choppiness",), "choppiness > 60"),
]
_AVERAGES = {"ema_9": "EMA(9)", "ema_26": "EMA(26)", "sma_50": "SMA(50)", "sma_200": "SMA(200)", "ema_200": "EMA(200)", "vwma": "VWMA", "vwap": "VWAP"}
AVERAGE_BULL = [
    *[(f"Price > {n} (+%.2f%%)", (f"(close - {c}) / {c} * 100",), f"close > {c}") for c, n in _AVERAGES.items()],
    ("Fast EMA > Slow EMA", (), "ema_9 > ema_26"), ("Golden Cross (SMA50 > SMA200)", (), "sma_50 > sma_200"), ("EMA Golden Cross (EMA50 > EMA200)", (), "ema_50 > ema_200"),
    ("Perfect Bullish MA Alignment", (), "ema_9 >= ema_26 and ema_26 >= sma_50 and sma_50 >= sma_200"),
    ("Near SMA(200) Support (%.2f%%)", ("(close - sma_200) / sma_200 * 100",), "close > sma_200 and (close - sma_200) / sma_200 * 100 < 5"),
]
AVERAGE_BEAR = [
    *[(f"Price < {n} (-%.2f%%)", (f"({c} - close) / {c} * 100",), f"close < {c}") for c, n in _AVERAGES.items()],
    ("Fast EMA < Slow EMA", (), "ema_9 < ema_26"), ("Death Cross (SMA50 < SMA200)", (), "sma_50 < sma_200"), ("EMA Death Cross (EMA50 < EMA200)", (), "ema_50 < ema_200"),
    ("Perfect Bearish MA Alignment", (), "ema_9 <= ema_26 and ema_26 <= sma_50 and sma_50 <= sma_200"),
    ("Near SMA(200) Resistance (%.2f%%)", ("(sma_200 - close) / sma_200 * 100",), "close < sma_200 and (sma_200 - close) / sma_200 * 100 < 5"),
]
FIBONACCI_BULL = [
    ("Near Fib 23.6%% Retracement (Bounce Zone)", (), "near_fib_236 = 1"), ("Near Fib 38.2%% Retracement (Bounce Zone)", (), "near_fib_382 = 1"),
    ("Near Fib 50%% Retracement (Bounce Zone)", (), "near_fib_500 = 1"), ("Near Fib 61.8%% Golden Ratio (Bounce Zone)", (), "near_fib_618 = 1"),
    ("Near Fib 78.6%% Retracement (Bounce Zone)", (), "near_fib_786 = 1"),
    ("S/R Confluence (%d levels)", ("sr_confluence_score",), "sr_confluence_score >= 2"),
    ("High Quality Pullback (Score=%d)", ("pullback_quality_score",), "pullback_quality_score >= 60"),
]
FIBONACCI_BEAR = [
    ("Near Fib 23.6%% Extension (Resistance Zone)", (), "near_fib_236 = 1"), ("Near Fib 38.2%% Extension (Resistance Zone)", (), "near_fib_382 = 1"),
    ("Near Fib 61.8%% Extension (Resistance Zone)", (), "near_fib_618 = 1"),
    ("Resistance Confluence (%d levels)", ("sr_confluence_score",), "sr_confluence_score >= 2"),
]
ACTION_BULL = [
    ("Higher High (HH)", (), "structure_type = 'HH'"), ("Higher Low (HL)", (), "structure_type = 'HL'"), ("Bullish Structure Break", (), "structure_break = 1"),
    ("Short-Term Uptrend", (), "trend_short = 1"), ("Medium-Term Uptrend", (), "trend_medium = 1"), ("Long-Term Uptrend", (), "trend_long = 1"),
    ("Swing Low Formed", (), "swing_low = 1"), ("Strong Upward Persistence (%.2f)", ("directional_persistence",), "directional_persistence > 0.2"),
    ("Positive Price Slope (%.4f)", ("local_slope",), "local_slope > 0"),
]
ACTION_BEAR = [
    ("Lower High (LH)", (), "structure_type = 'LH'"), ("Lower Low (LL)", (), "structure_type = 'LL'"), ("Bearish Structure Break", (), "structure_break = 1"),
    ("Short-Term Downtrend", (), "trend_short = -1"), ("Medium-Term Downtrend", (), "trend_medium = -1"), ("Long-Term Downtrend", (), "trend_long = -1"),
    ("Swing High Formed", (), "swing_high = 1"), ("Strong Downward Persistence (%.2f)", ("directional_persistence",), "directional_persistence < -0.2"),
    ("Negative Price Slope (%.4f)", ("local_slope",), "local_slope < 0"),
]
PULLBACK_BULL = [
    ("✅ Bullish Pullback Complete", (), "pullback_complete_bull = 1"), ("Healthy Bull Pullback", (), "healthy_bull_pullback = 1"),
    ("Higher Lows Pattern (Accumulation)", (), "higher_lows_pattern = 1"), ("ABC Bullish Continuation Pattern", (), "abc_pullback_bull = 1"),
    ("Pullback to EMA(9)", (), "pullback_to_ema9 = 1"), ("Pullback to EMA(20)", (), "pullback_to_ema20 = 1"), ("Pullback to SMA(50)", (), "pullback_to_sma50 = 1"),
    ("Ideal Pullback Depth (%.1f%%)", ("abs(pullback_from_high_pct)",), "abs(pullback_from_high_pct) between 3 and 12"),
    ("Measured Move Target +%.1f%%", ("distance_to_bull_target_pct",), "distance_to_bull_target_pct > 0"),
    ("🚀 Trend Resumption Phase", (), "pullback_stage = 'resumption_bull'"), ("Late Pullback (Entry Zone)", (), "pullback_stage = 'pullback_late'"),
]
PULLBACK_BEAR = [
    ("✅ Bearish Pullback Complete", (), "pullback_complete_bear = 1"), ("Healthy Bear Pullback", (), "healthy_bear_pullback = 1"),
    ("Lower Highs Pattern (Distribution)", (), "lower_highs_pattern = 1"), ("ABC Bearish Continuation Pattern", (), "abc_pullback_bear = 1"),
    ("Failed Bear Pullback (Reversal Risk)", (), "failed_pullback_bear = 1"),
    ("Measured Move Target -%.1f%%", ("distance_to_bear_target_pct",), "distance_to_bear_target_pct > 0"),
    ("📉 Downtrend Resumption Phase", (), "pullback_stage = 'resumption_bear'"), ("Late Pullback (Short Entry Zone)", (), "pullback_stage = 'pullback_late'"),
]
CANDLES = {
    "bull": ("hammer", "inverted_hammer", "bullish_engulfing", "morning_star", "piercing_line", "three_white_soldiers", "bullish_harami", "morning_doji_star",
             "three_inside_up", "three_outside_up", "belt_hold_bull", "tweezer_bottom", "abandoned_baby_bull", "counterattack_bull", "breakaway_bull",
             "kicking_bull", "kicking_by_length_bull", "marubozu_bull"),
    "bear": ("shooting_star", "hanging_man", "bearish_engulfing", "evening_star", "dark_cloud_cover", "three_black_crows", "bearish_harami", "evening_doji_star",
             "three_inside_down", "three_outside_down", "belt_hold_bear", "tweezer_top", "abandoned_baby_bear", "counterattack_bear", "breakaway_bear",
             "kicking_bear", "kicking_by_length_bear", "marubozu_bear"),
    "neutral": ("doji", "long_legged_doji", "dragonfly_doji", "gravestone_doji", "rickshaw_man"),
}
CHARTS = {
    "bull": ("double_bottom", "triple_bottom", "ascending_triangle", "cup_and_handle", "inverse_head_and_shoulders", "bullish_flag", "bullish_pennant",
             "rounding_bottom", "falling_wedge"),
    "bear": ("double_top", "triple_top", "descending_triangle", "head_and_shoulders", "bearish_flag", "bearish_pennant", "rounding_top", "rising_wedge"),
    "neutral": ("symmetrical_triangle", "rectangle", "sideways_channel"),
}
_CANDLE_MARK, _CHART_MARK = {"bull": "🟢", "bear": "🔴", "neutral": "⚪"}, {"bull": "📈", "bear": "📉", "neutral": "↔️"}
_RECENT = {"bull": ("Multiple Bullish Candles (%d recent)", ("recent_bullish_patterns",), "recent_bullish_patterns > 1"),
           "bear": ("Multiple Bearish Candles (%d recent)", ("recent_bearish_patterns",), "recent_bearish_patterns > 1"),
           "neutral": ("Indecision Candles (%d recent)", ("recent_doji",), "recent_doji > 0")}
ANOMALY_BULL = [
    ("Gap Up (%.2f%%)", ("gap_intensity * 100",), "gap_intensity > 0.01"), ("Extended Bullish Bar (Ratio=%.2f)", ("extended_bar_ratio",), "extended_bar_ratio > 2"),
    ("⚡ Volume Spike (Institutional Activity)", (), "volume_spike = 1"),
]
ANOMALY_BEAR = [
    ("Gap Down (%.2f%%)", ("gap_intensity * 100",), "gap_intensity < -0.01"),
    ("Extended Bearish Bar (Ratio=%.2f)", ("extended_bar_ratio",), "extended_bar_ratio > 2 and close < open"),
    ("⚡ Volume Spike (Distribution Alert)", (), "volume_spike = 1"),
]
PATTERN_RULES = {
    "average_bull": AVERAGE_BULL, "average_bear": AVERAGE_BEAR, "fibonacci_bull": FIBONACCI_BULL, "fibonacci_bear": FIBONACCI_BEAR,
    "action_bull": ACTION_BULL, "action_bear": ACTION_BEAR, "pullback_bull": PULLBACK_BULL, "pullback_bear": PULLBACK_BEAR,
    **{f"candle_{k}": [*[(f"{_CANDLE_MARK[k]} Candlestick: {n.replace('_', ' ').title()}", (), f"pattern_{n} = 1") for n in names], _RECENT[k]] for k, names in CANDLES.items()},
    **{f"chart_{k}": [(f"{_CHART_MARK[k]} Chart Pattern: {n.replace('_', ' ').title()}", (), f"{n} = 1") for n in names] for k, names in CHARTS.items()},
    "anomaly_bull": ANOMALY_BULL, "anomaly_bear": ANOMALY_BEAR,
}
PATTERN_INPUTS = [
    *_AVERAGES, "ema_50", *[f"near_fib_{n}" for n in ("236", "382", "500", "618", "786")], "sr_confluence_score", "pullback_quality_score", "trend_short", "trend_medium",
    "trend_long", "swing_high", "swing_low", "directional_persistence", "local_slope", "pullback_complete_bull", "healthy_bull_pullback", "higher_lows_pattern",
    "abc_pullback_bull", "pullback_to_ema9", "pullback_to_ema20", "pullback_to_sma50", "pullback_from_high_pct", "distance_to_bull_target_pct", "pullback_stage",
    "pullback_complete_bear", "healthy_bear_pullback", "lower_highs_pattern", "abc_pullback_bear", "failed_pullback_bear", "distance_to_bear_target_pct",
    "recent_bullish_patterns", "recent_bearish_patterns", "recent_doji", "gap_intensity", "extended_bar_ratio", "volume_spike",
]
# The lists a side is confirmed by, in order: indicators, then patterns.
ENTRY_POINTS = {
    "bullish": (("momentum_bull", "trend_bull", "volume_bull", "volatility_bull", "average_bull", "fibonacci_bull", "anomaly_bull"),
                ("action_bull", "pullback_bull", "candle_bull", "chart_bull")),
    "bearish": (("momentum_bear", "trend_bear", "volume_bear", "volatility_bear", "average_bear", "fibonacci_bear", "anomaly_bear"),
                ("action_bear", "pullback_bear", "candle_bear", "chart_bear")),
    "ranging": (("ranging",), ("candle_neutral", "chart_neutral", "ranging_patterns")),
}
RULES = {"momentum_bull": MOMENTUM_BULL, "momentum_bear": MOMENTUM_BEAR, "trend_bull": TREND_BULL, "trend_bear": TREND_BEAR, "ranging": RANGING,
         "ranging_patterns": RANGING_PATTERNS, "volume_bull": VOLUME_BULL, "volume_bear": VOLUME_BEAR, "volatility_bull": VOLATILITY_BULL,
         "volatility_bear": VOLATILITY_BEAR}
INPUTS = [
    "rsi", "rsi_30", "connors_rsi", "stoch_k", "stoch_d", "stoch_rsi_k", "williams_r", "roc", "roc_20", "momentum", "momentum_pct", "ultimate_osc", "tsi",
    "smi", "smi_signal", "smi_ergodic", "cci", "woodies_cci", "woodies_cci_signal", "macd", "macd_hist", "macd_signal", "ppo", "ppo_hist", "adx", "di_plus",
    "di_minus", "aroon_up", "aroon_down", "aroon_osc", "trix", "trix_signal", "dpo", "kst", "kst_signal", "mass_index", "ao", "ichimoku_a", "ichimoku_b",
    "ichimoku_conversion", "ichimoku_base", "psar", "vortex_pos", "vortex_neg", "vortex_diff", "bb_width", "bb_pct", "kc_pct", "choppiness", "volume_zscore",
    "obv_change", "cmf", "mfi", "force_index", "force_index_ema", "ad", "chaikin_osc", "eom", "eom_sma", "vpt", "nvi", "volume_roc", "bop", "volume_spike",
    "volume_decreasing", "atr_percent", "atr_ratio", "dc_pct", "ulcer_index", "bull_power", "bear_power", "normalized_variance",
]
# ---- end of fixed values ----


def applicable(rules: Sequence[tuple[str, tuple[str, ...], str]], columns: Sequence[str]) -> list[tuple[str, tuple[str, ...], str]]:
    """The rules whose columns the rows have; a rule on a column they lack never confirms."""
    known = {*columns, "and", "between", "abs", "greatest", "least", "is", "not", "null"}
    return [r for r in rules if set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", r[2]))) <= known]


def entry_points(rows: DataFrame) -> DataFrame:
    """Rows with the confirming indicators and patterns of all categories, per side: ``bullish_indicators``, ``bullish_patterns``, ..."""
    every = {**RULES, **PATTERN_RULES}
    texts = {c: confirmations(applicable(every[c], rows.columns)) for pair in ENTRY_POINTS.values() for names in pair for c in names}
    return rows.withColumns({f"{side}_{kind}": F.concat(*[texts[c] for c in names]) for side, pair in ENTRY_POINTS.items() for kind, names in zip(("indicators", "patterns"), pair, strict=True)})


def confirmations(rules: Sequence[tuple[str, tuple[str, ...], str]]) -> Column:
    """The texts of the rules that hold on the row."""
    parts = []
    for text, cols, cond in rules:
        say = F.format_string(text, *[F.expr(c) for c in cols]) if cols else F.lit(text.replace("%%", "%"))
        parts.append(F.when(F.expr(cond), say))
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def confirmed(rows: DataFrame, categories: Sequence[str] = tuple(RULES)) -> DataFrame:
    return rows.withColumns({c: confirmations(RULES[c]) for c in categories})


def typical_rows(rows: DataFrame, by: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """One row per bounded group (an instance): medians of numbers, most frequent of categories."""
    return rows.groupBy(*by).agg(*[F.median(c).alias(c) for c in numeric], *[F.mode(c, True).alias(c) for c in categorical])


def playbook(segment_rows: DataFrame, by: Sequence[str] = ("pair", "timeframe", "seg_start")) -> DataFrame:
    """Per structure: the rules its instances' typical rows confirm, on the side of their price change."""
    t = typical_rows(segment_rows, by, ["close", *INPUTS])
    ends = segment_rows.groupBy(*by).agg(((F.max_by("close", "pos") / F.min_by("close", "pos") - 1) * 100).alias("change_pct"))
    x = confirmed(t.join(ends, list(by)))
    side = F.when(F.col("adx") < 20, "ranging").when(F.col("change_pct") > 0, "bullish").otherwise("bearish")
    texts = F.when(side == "ranging", F.concat("ranging", "ranging_patterns")).when(side == "bullish", F.concat("momentum_bull", "trend_bull", "volume_bull", "volatility_bull")).otherwise(
        F.concat("momentum_bear", "trend_bear", "volume_bear", "volatility_bear"))
    # The printed values differ per instance; the rule is the text before them.
    names = F.transform(texts, lambda s: F.regexp_replace(s, r" \([^()]*\d%?\) - ", " - "))
    names = F.transform(names, lambda s: F.trim(F.regexp_replace(s, r"[(:][^)]*-?\d[^)]*\)?$", "")))
    y = x.withColumn("regime_name", side).withColumn("name", F.explode(names))
    n = x.withColumn("regime_name", side).groupBy("regime_name").agg(F.count(F.lit(1)).alias("instances"))
    g = y.groupBy("regime_name", "name").agg(F.count(F.lit(1)).alias("hits")).join(n, "regime_name")
    return g.withColumn("share", F.col("hits") / F.col("instances"))


def playbook_rows(shares: DataFrame, least: float = 0.5) -> DataFrame:
    """One JSON row per regime with the rules at least half its instances share."""
    keep = shares.where(F.col("share") >= least).groupBy("regime_name").agg(
        F.max("instances").alias("instances"), F.array_sort(F.collect_list(F.struct("name", "share"))).alias("rules"))
    return keep.select("regime_name", "instances", F.to_json("rules").alias("confirming_indicators_json"))
