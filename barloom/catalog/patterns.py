"""Price action, chart patterns, states and labels with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import (
    KEYS, bars, bars_cte, ema_spec, ewm_cte, frame, prev, query, roll, rounded, sql_flags, sql_select,
)
from barloom.catalog.indicators import (
    ADX, B, BB, CLV, CUM, DC, ET, FIBSQL, MACD, MFI, OBV, RSI, STOCH, SWALL, VORTEX, feature_query, fl, lastv, roc, step,
)
from barloom.functions.charts import FRAME_PATTERNS, PEAK_PATTERNS, TROUGH_PATTERNS
from barloom.functions.labels import known_returns
from barloom.functions.registry import compute
from barloom.functions.states import all_signals, state_table, unmapped_features
from barloom.plans.price_action import price_structure, structure_score, support_resistance

S5 = ("high", "low")


def piv(side: str) -> str:
    op = ">" if side == "high" else "<"
    return " AND ".join(f"{prev(side, 5)} {op} {side if k == 0 else prev(side, k)}" for k in range(11) if k != 5)


def peek(side: str) -> str:
    op = ">" if side == "high" else "<"
    look = [prev(side, k) for k in range(1, 6)] + [f"lead({side}, {k}) OVER (PARTITION BY pair, timeframe ORDER BY ts)" for k in range(1, 6)]
    return " AND ".join(f"{side} {op} {x}" for x in look)


PIV = [step("p0", {f"sw_{s}": f"CASE WHEN {piv(s)} THEN 1 ELSE 0 END" for s in S5} | {f"p5_{s}": prev(s, 5) for s in S5}
            | {f"pk_{s}": f"CASE WHEN {peek(s)} THEN 1 ELSE 0 END" for s in S5}),
       step("p1", {"lh": lastv("sw_high = 1", "p5_high"), "ll": lastv("sw_low = 1", "p5_low"),
                   "vm": roll("avg", "volume", 20), "rn": "row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts)"}, "p0")]
feature_query("pa1_pivots", ["pa_swing_high", "pa_swing_low", "pa_pivot_high", "pa_pivot_low", "pa_level_high", "pa_level_low"],
              f"WITH {', '.join([B, *PIV])} SELECT pair, timeframe, ts, sw_high AS pa_swing_high, sw_low AS pa_swing_low,"
              " pk_high AS pa_pivot_high, pk_low AS pa_pivot_low, round(lh, 6) AS pa_level_high, round(ll, 6) AS pa_level_low FROM p1")


def over(lo: int, hi: int) -> str:
    b = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING" if hi < 0 else f"{hi} FOLLOWING"
    a = "CURRENT ROW" if lo == 0 else f"{-lo} PRECEDING" if lo < 0 else f"{lo} FOLLOWING"
    return f"OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN {a} AND {b})"


NOW, OLD = over(-20, 0), over(-40, -21)


def ext(side, agg, op):
    return f"(count({side}) {OLD} = 20 AND {side} = {agg}({side}) {NOW} AND {side} {op} {agg}({side}) {OLD})"


STRUCT = {"higher_highs": ext("high", "max", ">"), "higher_lows": ext("low", "max", ">"),
          "lower_highs": ext("high", "min", "<"), "lower_lows": ext("low", "min", "<")}
ST0 = [step("z", {k: f"CASE WHEN {v} THEN 1 ELSE 0 END" for k, v in STRUCT.items()}
            | {"h10": fl(f"high = ({roll('max', 'high', 10)})"), "l10": fl(f"low = ({roll('min', 'low', 10)})"),
               "hl10": fl(f"count(low) {over(-10, -1)} = 10 AND low > min(low) {over(-10, -1)}"),
               "lh10": fl(f"count(high) {over(-10, -1)} = 10 AND high < max(high) {over(-10, -1)}")}),
       "zz AS (SELECT *, sum(higher_highs + lower_lows) OVER (PARTITION BY pair, timeframe) AS hits FROM z)"]
query("pa2_trend_structure_frames", f"WITH {B}, {', '.join(ST0)} SELECT pair, timeframe, ts,"
      " CASE WHEN hits > 0 THEN higher_highs ELSE h10 END AS higher_highs, CASE WHEN hits > 0 THEN higher_lows ELSE hl10 END AS higher_lows,"
      " CASE WHEN hits > 0 THEN lower_highs ELSE lh10 END AS lower_highs, CASE WHEN hits > 0 THEN lower_lows ELSE l10 END AS lower_lows,"
      " round((higher_highs + higher_lows - lower_highs - lower_lows) / 4.0::DOUBLE, 6) AS trend_strength FROM zz")(
    lambda spark, sf: rounded(price_structure(bars(spark, sf))))
RS11 = [*RSI, step("d", {"n11": f"count(rsi) OVER {frame(11)}"}, "rs")]
P10 = over(-10, -1)
feature_query("pa3_momentum_divergence", ["momentum_divergence_bullish", "momentum_divergence_bearish"], sql_flags([B, *RS11], {
    "momentum_divergence_bullish": f"n11 = 11 AND low < min(low) {P10} AND rsi > min(rsi) {P10}",
    "momentum_divergence_bearish": f"n11 = 11 AND high > max(high) {P10} AND rsi < max(rsi) {P10}"}, "d"))
RNB = "rb AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn FROM bars)"
feature_query("pa4_volume_breakout", ["volume_breakout", "volume_divergence"], sql_flags([B, RNB], {
    "volume_breakout": f"rn > 20 AND volume > ({roll('avg', 'volume', 20, True)}) * 1.3::DOUBLE AND abs(close - {prev('close')}) / nullif({prev('close')}, 0) > 0.002::DOUBLE",
    "volume_divergence": f"rn > 20 AND close < {prev('close', 5)} AND avg(volume) {over(-5, 0)} < avg(volume) {over(-10, -6)} * 0.8::DOUBLE"}, "rb"))
TS = [ET, "t5 AS (SELECT bars.*, CASE WHEN close > e50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ab FROM bars LEFT JOIN e USING (pair, timeframe, ts))",
      step("t6", {"sh": roll("avg", "ab", 20)}, "t5")]
TSX = ("CASE WHEN sh > 0.7::DOUBLE THEN 'strong_uptrend' WHEN sh >= 0.55::DOUBLE THEN 'uptrend' WHEN sh < 0.3::DOUBLE THEN 'strong_downtrend'"
       " WHEN sh < 0.45::DOUBLE THEN 'downtrend' ELSE 'neutral' END")
feature_query("pa5_trend_structure", ["trend_structure"], f"WITH {B}, {', '.join(TS)} SELECT pair, timeframe, ts, {TSX} AS trend_structure FROM t6")
feature_query("pa6_market_structure", ["market_structure", "market_structure_strict"],
              f"WITH {B}, {', '.join(ADX)} SELECT pair, timeframe, ts, CASE WHEN adx > 30 THEN 'strong_trend' WHEN adx >= 20 THEN 'trending' ELSE 'ranging' END AS market_structure,"
              " CASE WHEN adx > 35 THEN 'strong_trend' WHEN adx >= 25 THEN 'trending' ELSE 'ranging' END AS market_structure_strict FROM bars LEFT JOIN z USING (pair, timeframe, ts)")
feature_query("pa7_structure_break", ["structure_break_bullish", "structure_break_bearish"], sql_flags([B, *PIV], {
    "structure_break_bullish": "close > lh AND volume > vm * 1.2::DOUBLE", "structure_break_bearish": "close < ll AND volume > vm * 1.2::DOUBLE"}, "p1"))
feature_query("pa8_false_breakout", ["false_breakout_bullish", "false_breakout_bearish"], sql_flags([B, *PIV], {
    "false_breakout_bullish": f"low < ll AND close > {prev('ll', 2)} * 1.003::DOUBLE",
    "false_breakout_bearish": f"high > lh AND close < {prev('lh', 2)} * 0.997::DOUBLE"}, "p1"))
feature_query("pa9_momentum_continuation", ["momentum_continuation"],
              f"WITH {B}, {', '.join(RSI)}, {step('d', {'r5': roll('avg', 'rsi', 5)}, 'rs')} SELECT pair, timeframe, ts,"
              f" CASE WHEN r5 > 50 AND close > {prev('close')} THEN 1 WHEN r5 < 50 AND close < {prev('close')} THEN -1 ELSE 0 END AS momentum_continuation FROM d")
RP = [step("d", {"rp": f"(({roll('max', 'high', 10)}) - ({roll('min', 'low', 10)})) / nullif(close, 0)"})]
feature_query("pa10_equal_highs_lows", ["equal_highs_lows"], sql_flags([B, *RP], {"equal_highs_lows": f"rp < ({roll('avg', 'rp', 20)}) * 0.5"}, "d"))
feature_query("pa11_swing_failure", ["swing_failure"], f"WITH {B}, {', '.join(PIV)} SELECT pair, timeframe, ts,"
              " CASE WHEN low < ll AND close > ll THEN 1 WHEN high > lh AND close < lh THEN -1 ELSE 0 END AS swing_failure FROM p1")
VC = [step("d", {"p": roc("close", 1), "vm": roll("avg", "volume", 20)}), step("d1", {"sd": roll("stddev_samp", "p", 20)}, "d")]
feature_query("pa12_volume_confirmation", ["volume_breakout_confirmation"], f"WITH {B}, {', '.join(VC)} SELECT pair, timeframe, ts,"
              f" CASE WHEN volume > vm * 1.5 AND abs(p) > sd AND close > {prev('close')} THEN 1 WHEN volume > vm * 1.5 AND abs(p) > sd AND close < {prev('close')} THEN -1 ELSE 0 END"
              " AS volume_breakout_confirmation FROM d1")
E20 = ewm_cte("e20", "bars", "close", [ema_spec("m20", 20)])
J20 = "j20 AS (SELECT bars.*, m20 FROM bars LEFT JOIN e20 USING (pair, timeframe, ts))"
feature_query("pa13_pullback_fallbacks", ["simple_pullback_complete_bull", "simple_pullback_complete_bear", "simple_healthy_bull", "simple_healthy_bear"],
              sql_flags([B, E20, J20], {
                  "simple_pullback_complete_bull": f"abs(close - m20) / nullif(m20, 0) < 0.01::DOUBLE AND close > {prev('close')}",
                  "simple_pullback_complete_bear": f"abs(close - m20) / nullif(m20, 0) < 0.01::DOUBLE AND close < {prev('close')}",
                  "simple_healthy_bull": f"close < {prev('close', 5)} AND volume < ({roll('avg', 'volume', 10)})",
                  "simple_healthy_bear": f"close > {prev('close', 5)} AND volume < ({roll('avg', 'volume', 10)})"}, "j20"))
PA14 = [*BB, "w0 AS (SELECT b1.*, 4 * s / nullif(m, 0) AS bw FROM b1)", *MACD[:1], *MACD[1:2], MACD[2].replace("s AS (", "sg AS (", 1), *RSI,
        "w1 AS (SELECT w0.*, e12 - e26 AS macd, sig, rsi FROM w0 JOIN e USING (pair, timeframe, ts) LEFT JOIN sg USING (pair, timeframe, ts) JOIN rs USING (pair, timeframe, ts))"]
PA14[3] = PA14[3].replace("m AS (", "mm AS (", 1)
PA14[4] = PA14[4].replace("FROM m WHERE", "FROM mm WHERE")
feature_query("pa14_squeeze_and_extremes", ["bb_squeeze", "rsi_extreme", "momentum_confirmation", "volume_price_mismatch", "volume_below_trend"],
              sql_flags([B, *PA14], {
                  "bb_squeeze": f"bw < ({roll('avg', 'bw', 20)}) * 0.7::DOUBLE",
                  "rsi_extreme": "rsi < 30 OR rsi > 70",
                  "momentum_confirmation": "(macd > sig AND macd > 0) OR (macd < sig AND macd < 0)",
                  "volume_price_mismatch": f"count(close) OVER {frame(10)} = 10 AND (close > {prev('close', 9)}) <> (volume > {prev('volume', 9)})",
                  "volume_below_trend": f"volume < ({roll('avg', 'volume', 10)}) * 0.9::DOUBLE"}, "w1"))
feature_query("pa16_hh_ll", ["hh_ll"], f"WITH {B}, {', '.join(ST0)} SELECT pair, timeframe, ts,"
              " CASE WHEN higher_highs = 1 THEN 1 WHEN lower_lows = 1 THEN -1 ELSE 0 END AS hh_ll FROM z")
LEVELS = f"""WITH {B}, {PIV[0]},
 pv AS (SELECT pair, timeframe, ts, 'resistance' AS kind, high AS price FROM p0 WHERE pk_high = 1
   UNION ALL SELECT pair, timeframe, ts, 'support', low FROM p0 WHERE pk_low = 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe, kind ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY pair, timeframe, kind) AS n FROM pv),
 t AS (SELECT *, lag(price) OVER (PARTITION BY pair, timeframe, kind ORDER BY price, ts) AS pp FROM r WHERE k <= 5 AND n >= 2),
 c AS (SELECT *, sum(CASE WHEN pp IS NULL OR abs(price - pp) / pp > 0.005::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY pair, timeframe, kind ORDER BY price, ts ROWS UNBOUNDED PRECEDING) AS g FROM t)
 SELECT pair, timeframe, kind, round(avg(price), 6) AS level, count(*) AS touches FROM c GROUP BY pair, timeframe, kind, g"""
query("pa17_support_resistance", LEVELS)(lambda spark, sf: rounded(support_resistance(bars(spark, sf))))
SCORE = f"""WITH {B}, {PIV[0]}, {ST0[0]}, {ST0[1]},
 d AS (SELECT pair, timeframe, sum(pk_high + pk_low) / count(*)::DOUBLE AS dens FROM p0 GROUP BY 1, 2),
 q AS (SELECT pair, timeframe, abs((higher_highs + higher_lows - lower_highs - lower_lows) / 4.0::DOUBLE) AS s,
   row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts DESC) AS k FROM zz),
 m AS (SELECT pair, timeframe, avg(s) AS ms FROM q WHERE k <= 20 GROUP BY 1, 2)
 SELECT pair, timeframe, round((CASE WHEN dens BETWEEN 0.1::DOUBLE AND 0.3::DOUBLE THEN 1.0 WHEN dens < 0.1::DOUBLE THEN dens / 0.1::DOUBLE ELSE 0.3::DOUBLE / dens END * 0.4::DOUBLE
   + least(ms * 2, 1.0) * 0.6::DOUBLE) * 100, 6) AS structure_score FROM d JOIN m USING (pair, timeframe)"""
query("pa18_structure_score", SCORE)(lambda spark, sf: rounded(structure_score(bars(spark, sf))))

# ---- charts ----
feature_query("ch1_6_peak_patterns", [*PEAK_PATTERNS, *TROUGH_PATTERNS])
CH = [step("x0", {"m20": roll("avg", "close", 20), "s20": roll("stddev_samp", "close", 20), "r20": roc("close", 20),
                  "w20": f"({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)})", "hx": roll("max", "high", 30), "hn": roll("min", "high", 30),
                  "lx": roll("max", "low", 30), "ln": roll("min", "low", 30), "cx": roll("max", "close", 50), "cn": roll("min", "close", 50), "c10": prev("close", 10)}),
      step("x1", {"w20d": f"w20 - {prev('w20')}", "hrd": f"(hx - hn) - {prev('(hx - hn)')}", "lrd": f"(lx - ln) - {prev('(lx - ln)')}",
                  "wd": f"(hx - ln) - {prev('(hx - ln)')}", "hxd": f"hx - {prev('hx')}", "lnd": f"ln - {prev('ln')}"}, "x0"),
      step("x2", {"n20": roll("avg", "w20d", 3), "ht": roll("avg", "hrd", 3), "lt": roll("avg", "lrd", 3), "nw": roll("avg", "wd", 3)}, "x1")]
CHX = {
    "pattern_bullish_flag": "r20 > 0.08::DOUBLE AND s20 < m20 * 0.02::DOUBLE", "pattern_bearish_flag": "r20 < -0.08::DOUBLE AND s20 < m20 * 0.02::DOUBLE",
    "pattern_bullish_pennant": "r20 > 0.08::DOUBLE AND n20 < 0", "pattern_bearish_pennant": "r20 < -0.08::DOUBLE AND n20 < 0",
    "pattern_rectangle": "w20 / nullif(m20, 0) < 0.02::DOUBLE", "pattern_triangle": "ht < 0 AND lt <> 0",
    "pattern_falling_wedge": "hxd < 0 AND lnd < 0 AND nw < 0", "pattern_rising_wedge": "hxd > 0 AND lnd > 0 AND nw < 0",
    "pattern_cup_and_handle": "(cx - cn) / nullif(cx, 0) BETWEEN 0.12::DOUBLE AND 0.5 AND close > cx * 0.95::DOUBLE AND close < c10",
    "pattern_inverted_cup_and_handle": "(cx - cn) / nullif(cn, 0) BETWEEN 0.12::DOUBLE AND 0.5 AND close < cn * 1.05::DOUBLE AND close > c10",
}
feature_query("ch7_16_frame_patterns", list(FRAME_PATTERNS), sql_flags([B, *CH], {c: CHX[c] for c in FRAME_PATTERNS}, "x2"))

# ---- states ----


def state_query(name: str, signals: list[str], ctes: list[str], exprs: dict[str, tuple[str, str]], source="bars", joins=(), timeframe="1h"):
    """``exprs``: signal -> (bullish condition, bearish condition)."""
    cols = ", ".join(f"CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END AS state_{s}" for s, (u, d) in exprs.items())
    tail = "".join(f" LEFT JOIN {j} USING (pair, timeframe, ts)" for j in joins)
    query(name, f"WITH {', '.join(ctes)} SELECT pair, timeframe, ts, {cols} FROM {source}{tail}")(
        lambda spark, sf, s=tuple(signals): state_table(bars(spark, sf, timeframe), list(s)).select(*KEYS, *[f"state_{x}" for x in s]))


NO = "false"
MAV = [step("ma", {f"s{n}": roll("avg", "close", n) for n in (7, 20, 50, 100, 200)})]
state_query("st1_price_vs_average", [f"sma_{n}" for n in (7, 20, 50, 100, 200)], [B, *MAV],
            {f"sma_{n}": (f"close > s{n}", f"close < s{n}") for n in (7, 20, 50, 100, 200)}, "ma")
OSC = [*RSI, STOCH[0].replace("FROM bars", "FROM rs"), STOCH[1], MFI[0].replace("FROM bars", "FROM k1"), MFI[1],
       step("o", {"w": "-100 * (hh - close) / nullif(hh - ll, 0)",
                  "mfi": f"100 * ({roll('sum', 'up', 14)}) / nullif(({roll('sum', 'up', 14)}) + ({roll('sum', 'dn', 14)}), 0)"}, "q1")]
state_query("st2_bounded_oscillators", ["rsi", "rsi_30", "stoch_k", "williams_r", "mfi"], [B, *OSC], {
    "rsi": ("rsi < 30", "rsi > 70"), "rsi_30": ("rsi_30 < 30", "rsi_30 > 70"), "stoch_k": ("k < 20", "k > 80"),
    "williams_r": ("w < -80", "w > -20"), "mfi": ("mfi < 20", "mfi > 80")}, "o")
SGN = [step("q0", {"r10": roc("close", 10), "mp": "(high + low) / 2"}), step("q1", {"ao": f"({roll('avg', 'mp', 5)}) - ({roll('avg', 'mp', 34)})"}, "q0")]
state_query("st3_sign_oscillators", ["roc", "momentum", "ao", "bop"], [B, *SGN], {
    "roc": ("r10 > 0", "r10 < 0"), "momentum": (f"close > {prev('close', 10)}", f"close < {prev('close', 10)}"), "ao": ("ao > 0", "ao < 0"),
    "bop": ("(close - open) / nullif(high - low, 0) > 0", "(close - open) / nullif(high - low, 0) < 0")}, "q1")
state_query("st4_line_vs_line", ["adx", "di_plus", "di_minus"], [B, *ADX], {
    "adx": ("adx > 25 AND di_plus > di_minus", "adx > 25 AND di_minus > di_plus"), "di_plus": ("di_plus > di_minus", "di_plus < di_minus"),
    "di_minus": ("di_minus < di_plus", "di_minus > di_plus")}, joins=["y", "z"])
state_query("st4_ichimoku_vortex", ["vortex_pos", "vortex_neg", "vortex_diff", "ichimoku_conversion", "ichimoku_base", "ichimoku_a", "ichimoku_lagging"],
            [B, *VORTEX, f"i AS (SELECT q.*, (({roll('max', 'high', 9)}) + ({roll('min', 'low', 9)})) / 2 AS c, (({roll('max', 'high', 26)}) + ({roll('min', 'low', 26)})) / 2 AS bs,"
             f" (({roll('max', 'high', 52)}) + ({roll('min', 'low', 52)})) / 2 AS d FROM q)",
             f"i2 AS (SELECT *, ({prev('c', 26)} + {prev('bs', 26)}) / 2 AS sa, {prev('d', 26)} AS sb FROM i)"], {
    "vortex_pos": ("a > b", "a < b"), "vortex_neg": ("a > b", "a < b"), "vortex_diff": ("a > b", "a < b"),
    "ichimoku_conversion": ("c > bs", "c < bs"), "ichimoku_base": ("close > bs", "close < bs"),
    "ichimoku_a": ("close > greatest(sa, sb)", "close < least(sa, sb)"), "ichimoku_lagging": (NO, NO)}, "i2")
BND = [*DC, "q2 AS (SELECT *, (close - l) / nullif(u - l, 0) AS dp FROM q)", f"q3 AS (SELECT *, list(high) OVER {frame(25)} AS lh, list(low) OVER {frame(25)} AS lw FROM q2)",
       "q4 AS (SELECT *, CASE WHEN len(lh) = 25 THEN list_position(lh, list_max(lh)) * 4 END AS au, CASE WHEN len(lw) = 25 THEN list_position(lw, list_min(lw)) * 4 END AS ad FROM q3)"]
state_query("st5_bands_and_aroon", ["dc_pct", "dc_upper", "dc_lower", "aroon_up", "aroon_down", "aroon_osc"], [B, *BND], {
    "dc_pct": ("dp < 0.2::DOUBLE", "dp > 0.8::DOUBLE"), "dc_upper": ("close > u", NO), "dc_lower": (NO, "close < l"),
    "aroon_up": ("au > 70", "au < 30"), "aroon_down": ("ad < 30", "ad > 70"), "aroon_osc": ("au - ad > 50", "au - ad < -50")}, "q4")
MED = [*BB, "w0 AS (SELECT b1.*, 4 * s / nullif(m, 0) AS bw FROM b1)", step("w1", {"mx": roll("max", "close", 14, True)}, "w0"),
       step("w2", {"dd": "pow((close - mx) / nullif(mx, 0) * 100, 2)"}, "w1"), step("w3", {"ui": f"sqrt({roll('avg', 'dd', 14, True)})"}, "w2"),
       "w4 AS (SELECT *, median(bw) OVER (PARTITION BY pair, timeframe) AS mb, median(ui) OVER (PARTITION BY pair, timeframe) AS mu FROM w3)"]
state_query("st6_relative_to_median", ["bb_width", "ulcer_index"], [B, *MED], {
    "bb_width": ("bw > mb * 1.5", NO), "ulcer_index": ("ui < mu * 0.7::DOUBLE", "ui > mu * 1.3::DOUBLE")}, "w4")
DS = [*OBV, CLV[0].replace("FROM bars", "FROM q1").replace("q AS (", "q5 AS (", 1), step("q6", {"ad": f"sum(cv) {CUM}"}, "q5"),
      step("q7", {"dob": f"round(obv - {prev('obv')}, 6)", "dad": "cv"}, "q6")]
state_query("st7_direction_of_change", ["obv"], [B, *DS], {"obv": ("dob > 0", "dob < 0")}, "q7")
state_query("st8_flags", ["swing_high", "swing_low", "last_swing_high", "pullback_depth", "near_fib_382"], SWALL, {
    "swing_high": (NO, "swing_high = 1"), "swing_low": ("swing_low = 1", NO), "last_swing_high": ("close > lh", "close < lh"),
    "pullback_depth": ("pfh BETWEEN -10 AND -1", "pfh < -10"),
    "near_fib_382": (f"abs(close - {FIBSQL['38_2']}) / nullif(close, 0) < 0.005::DOUBLE", NO)}, "s2")
state_query("st9_structure_states", ["trend_structure"], [B, *TS], {
    "trend_structure": ("sh >= 0.55::DOUBLE", "sh < 0.45::DOUBLE")}, "t6")
HELD = [*PIV, step("h0", {"e": "CASE WHEN low < ll AND close > ll THEN 1 WHEN high > lh AND close < lh THEN -1 ELSE 0 END"}, "p1"),
        step("h1", {"lastrn": f"max(CASE WHEN e <> 0 THEN rn END) OVER {frame(6)}", "lastev": f"last_value(CASE WHEN e <> 0 THEN e END IGNORE NULLS) OVER {frame(6)}"}, "h0")]
state_query("st10_held_events", ["swing_failure"], [B, *HELD], {
    "swing_failure": ("rn - lastrn <= 4 AND lastev = 1", "rn - lastrn <= 4 AND lastev = -1")}, "h1")
state_query("st10_held_events_15m", ["swing_failure"], [bars_cte("15m"), *HELD], {
    "swing_failure": ("rn - lastrn <= 3 AND lastev = 1", "rn - lastrn <= 3 AND lastev = -1")}, "h1", timeframe="15m")
state_query("st11_pattern_states", list(FRAME_PATTERNS), [B, *CH], {
    c: ((CHX[c], NO) if c in ("pattern_bullish_flag", "pattern_bullish_pennant", "pattern_falling_wedge", "pattern_cup_and_handle")
        else (NO, NO) if c in ("pattern_rectangle", "pattern_triangle") else (NO, CHX[c])) for c in FRAME_PATTERNS}, "x2")


@query("st12_mapping_coverage")
def _coverage(spark, sf):
    """Signals with a rule, and how often each fires over the whole series (1 h bars)."""
    names = all_signals()
    wide = state_table(bars(spark, sf), names)
    from barloom.functions.states import state_long

    return state_long(wide, names).groupBy("signal").agg(
        F.count(F.lit(1)).alias("bars"), F.sum((F.col("code") == 1).cast("int")).alias("bullish"),
        F.sum((F.col("code") == -1).cast("int")).alias("bearish"), F.lit(len(unmapped_features([]))).alias("unmapped"))


query("st13_state_scores", f"WITH {B}, {', '.join(RSI)} SELECT pair, timeframe, sum(CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END) AS score,"
      " count(rsi) AS known, sum(CASE WHEN rsi < 30 OR rsi > 70 THEN 1 ELSE 0 END) AS active FROM rs GROUP BY 1, 2")(
    lambda spark, sf: state_table(bars(spark, sf), ["rsi"], extra=["rsi"]).groupBy("pair", "timeframe").agg(
        F.sum("state_rsi").alias("score"), F.count("rsi").alias("known"), F.sum(F.abs("state_rsi")).alias("active")))
query("st14_signal_diagnostics", f"WITH {B}, {', '.join(PIV)} SELECT pair, timeframe, count(*) AS bars, sum(sw_high) AS swing_highs, sum(sw_low) AS swing_lows,"
      " count(lh) AS with_level, sum(CASE WHEN lh IS NULL THEN 1 ELSE 0 END) AS missing_level FROM p1 GROUP BY 1, 2")(
    lambda spark, sf: compute(bars(spark, sf), ["pa_swing_high", "pa_swing_low", "pa_level_high"]).groupBy("pair", "timeframe").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("pa_swing_high").alias("swing_highs"), F.sum("pa_swing_low").alias("swing_lows"),
        F.count("pa_level_high").alias("with_level"), F.sum(F.col("pa_level_high").isNull().cast("int")).alias("missing_level")))


@query("st15_debounced_states", f"WITH {B}, {', '.join(RSI)}, {step('d', {'s': 'CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END'}, 'rs')}"
       f" SELECT pair, timeframe, ts, CASE WHEN s = {prev('s')} THEN s ELSE 0 END AS state_rsi_held FROM d")
def _debounced(spark, sf):
    from barloom.functions.registry import REGISTRY, native
    from barloom.functions.states import debounced

    if "state_rsi_held" not in REGISTRY:
        native("state_rsi_held", ["state_rsi"], lambda: debounced("state_rsi", 2), back=1)
    return compute(bars(spark, sf), ["state_rsi_held"]).select(*KEYS, "state_rsi_held")


# ---- labels ----
def ahead(k):
    return f"lead(close, {k}) OVER (PARTITION BY pair, timeframe ORDER BY ts)"


LB = [step("l0", {f"f{h}": f"CASE WHEN {ahead(h)} IS NULL THEN NULL WHEN close = 0 THEN 0 ELSE ({ahead(h)} / close - 1) * 100 END" for h in (1, 5, 24)})]
feature_query("lb1_forward_labels", [x for h in (1, 5, 24) for x in (f"future_return_{h}", f"price_state_{h}")],
              f"WITH {B}, {LB[0]} SELECT pair, timeframe, ts, " + ", ".join(
                  f"round(f{h}, 6) AS future_return_{h}, CASE WHEN f{h} IS NULL THEN 'unknown' WHEN f{h} > 0.005::DOUBLE THEN 'bullish' WHEN f{h} < -0.005::DOUBLE THEN 'bearish' ELSE 'neutral' END AS price_state_{h}"
                  for h in (1, 5, 24)) + " FROM l0")
feature_query("lb3_log_forward", ["log_forward_return", "abs_log_forward_return"],
              sql_select([B], {"log_forward_return": f"ln({ahead(1)} / close)", "abs_log_forward_return": f"abs(ln({ahead(1)} / close))"}))
EXCURSIONS = ["max_favorable_excursion_1d", "max_adverse_excursion_1d", "future_return_24", "future_return_72", "future_return_168"]
query("lb4_excursions", sql_select([B], {
    "max_favorable_excursion_1d": f"(max(high) {over(0, 23)} - close) / nullif(close, 0) * 100",
    "max_adverse_excursion_1d": f"(min(low) {over(0, 23)} - close) / nullif(close, 0) * 100",
    **{f"future_return_{h}": f"({ahead(h)} / nullif(close, 0) - 1) * 100" for h in (24, 72, 168)}}))(
    lambda spark, sf: rounded(known_returns(compute(bars(spark, sf), EXCURSIONS)).select(*KEYS, *EXCURSIONS)))
