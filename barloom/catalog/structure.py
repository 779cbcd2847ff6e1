"""Trend classes, pullback quality and structure over timeframes, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import KEYS, SQL, bars, bars_cte, ema_spec, ewm_cte, frame, prev, query, roll, rounded
from barloom.catalog.indicators import (
    ABC, ADX, ATRJ, B, CANDLE_FLAGS, CANDLE_SQL, CCI, CTX, CUM, FIBSQL, MACD, OBV, RSI, SHAPE, SMALL, STOCH, SW, SW1, SW2, feature_query, roc, step,
)
from barloom.catalog.patterns import PIV, RS11, TS
from barloom.functions.candles import PLACEHOLDERS
from barloom.functions.pullback_quality import ADVICE, GRADES, PULLBACK_QUALITY, WEIGHTS
from barloom.functions.registry import compute
from barloom.functions.trend_class import ALIGNMENT_POINTS, LABELS, MOMENTUM_POINTS, QUALITY_POINTS, TREND_CLASS, VOLUME_POINTS
from barloom.operators.touch import first_touch
from barloom.plans import confluence as C
from barloom.plans import discovery as D
from barloom.plans import playbook as P
from barloom.plans import structure as S
from barloom.plans.mtf import mtf_table
from barloom.plans.structure import CLASSES, LOOK, PARTS, SHARES, TOLERANCE, TREND_SCORES


def case(x: str, table: dict, other="0") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"


def ladder(x: str, table: dict, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {k} THEN '{v}'" for k, v in sorted(table.items(), reverse=True)) + f" ELSE '{other}' END"


def one(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def rises(xs: str, op: str = ">") -> str:
    return f"len(list_filter(range(1, len({xs})), lambda i: {xs}[i + 1] {op} {xs}[i]))"


def average_ctes() -> list[str]:
    return [ewm_cte("em3", "bars", "close", [ema_spec("e20", 20), ema_spec("e50", 50), ema_spec("e200", 200)])]


def vote_sql(mean: str) -> str:
    parts = [("swing_trend", 4), (mean, 3), ("CASE WHEN osc_strength = 'strong' THEN 'strong_' ELSE '' END || CASE osc WHEN 'bullish' THEN 'uptrend' ELSE 'downtrend' END", 2),
             ("CASE vt WHEN 'bullish_confirmation' THEN 'uptrend' WHEN 'bearish_confirmation' THEN 'downtrend' WHEN 'neutral' THEN 'neutral' END", 1)]
    scores = ", ".join(f"{{'n': {' + '.join(one(f'({c}) = {chr(39)}{label}{chr(39)}') + f' * {w}' for c, w in parts)}, 'o': {-i}, 'label': '{label}'}}" for i, label in enumerate(LABELS))
    return f"CASE WHEN rn < 50 THEN 'neutral' ELSE list_max([{scores}]).label END"


def strength_sql(aligned: str) -> str:
    return (f"CASE WHEN rn < 50 THEN 0.0 ELSE (({case('quality', QUALITY_POINTS)}) * 6 + ({case(aligned, ALIGNMENT_POINTS)}) * 5"
            f" + ({case('osc_strength', MOMENTUM_POINTS)}) * 5 + ({case('vt', VOLUME_POINTS)}) * 4) / 20.0 END")


TREND = [
    *MACD[:2], *RSI, *STOCH, *CCI[:3], *ADX, *OBV, *average_ctes(), SW,
    step("p0", {"h8": f"(list(high) FILTER (swing_high = 1) {CUM})[-5:]", "l8": f"(list(low) FILTER (swing_low = 1) {CUM})[-5:]",
                "s50": roll("avg", "close", 50), "s200": roll("avg", "close", 200), "v20": roll("avg", "volume", 20)}, "s0"),
    "p1 AS (SELECT p0.*, rs.rsi, m.macd, k1.k, c2.cci, z.adx, q1.obv, e20, e50, e200 FROM p0 LEFT JOIN rs USING (pair, timeframe, ts) LEFT JOIN m USING (pair, timeframe, ts)"
    " LEFT JOIN k1 USING (pair, timeframe, ts) LEFT JOIN c2 USING (pair, timeframe, ts) LEFT JOIN z USING (pair, timeframe, ts) LEFT JOIN q1 USING (pair, timeframe, ts)"
    " LEFT JOIN em3 USING (pair, timeframe, ts))",
    step("p2", {"three": "len(h8) >= 3 AND len(l8) >= 3", "above": " + ".join(one(f"close > {x}") for x in ("e20", "e50", "e200", "s50", "s200")),
                "half": f"2 * ({one('rsi > 30 AND rsi < 50')} + {one('macd > 0')} + {one('k > 20 AND k < 50')} + {one('cci > -100 AND cci < 0')}) + {one('adx > 25')}",
                "pch": f"(close - {prev('close', 4)}) / nullif({prev('close', 4)}, 0)", "vch": f"(volume - {prev('volume', 4)}) / nullif({prev('volume', 4)}, 0)",
                "o19": prev("obv", 19), "sl20": f"e20 / nullif({prev('e20', 4)}, 0) - 1", "sl50": f"e50 / nullif({prev('e50', 9)}, 0) - 1",
                "hm": "max(high) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)", "rm10": f"max(rsi) OVER {frame(10)}"}, "p1"),
    step("p3", {"hh": f"CASE WHEN three THEN {rises('h8')} ELSE 0 END", "hl": f"CASE WHEN three THEN {rises('l8')} ELSE 0 END",
                "lh": f"CASE WHEN three THEN {rises('h8', '<=')} ELSE 0 END", "ll": f"CASE WHEN three THEN {rises('l8', '<=')} ELSE 0 END"}, "p2"),
    step("p4", {"swing_trend": "CASE WHEN NOT coalesce(three, false) THEN 'neutral' WHEN hh >= 3 AND hl >= 3 THEN 'strong_uptrend' WHEN hh >= 2 AND hl >= 2 THEN 'uptrend'"
                " WHEN lh >= 3 AND ll >= 3 THEN 'strong_downtrend' WHEN lh >= 2 AND ll >= 2 THEN 'downtrend' ELSE 'ranging' END",
                "quality": "CASE WHEN hh + hl + lh + ll >= 8 AND greatest(hh + hl, lh + ll) / (hh + hl + lh + ll) >= 0.8 THEN 'excellent'"
                " WHEN hh + hl + lh + ll >= 8 AND greatest(hh + hl, lh + ll) / (hh + hl + lh + ll) >= 0.6 THEN 'good' ELSE 'poor' END",
                "ma": "CASE WHEN above >= 4 THEN 'strong_uptrend' WHEN above = 3 THEN 'uptrend' WHEN above <= 1 THEN 'strong_downtrend' ELSE 'downtrend' END",
                "osc": "CASE WHEN half >= 5 THEN 'bullish' ELSE 'bearish' END", "osc_strength": "CASE WHEN half >= 7 OR half <= 3 THEN 'strong' ELSE 'moderate' END",
                "vt": "CASE WHEN pch > 0.02::DOUBLE AND vch > 0.3::DOUBLE THEN 'bullish_confirmation' WHEN pch < -0.02::DOUBLE AND vch > 0.3::DOUBLE THEN 'bearish_confirmation'"
                " WHEN pch > 0.02::DOUBLE AND vch < -0.2::DOUBLE THEN 'divergence_warning' ELSE 'neutral' END"}, "p3"),
]
TREND_COLUMNS = {
    "higher_highs_count": "hh", "higher_lows_count": "hl", "lower_highs_count": "lh", "lower_lows_count": "ll", "swing_trend": "swing_trend",
    "swing_trend_quality": "quality", "average_trend": "ma",
    "average_slope": "CASE WHEN sl20 > 0.001::DOUBLE AND sl50 > 0.001::DOUBLE THEN 'rising' WHEN sl20 < -0.001::DOUBLE AND sl50 < -0.001::DOUBLE THEN 'falling' ELSE 'flat' END",
    "average_distance": "round((abs(close - e50) / e50 + abs(close - e200) / e200) / 2, 6)", "oscillator_trend": "osc", "oscillator_strength": "osc_strength",
    "oscillator_divergence": "coalesce(rn >= 20 AND high > hm AND rsi < rm10 * 0.95::DOUBLE, false)",
    "volume_level": "CASE WHEN volume / nullif(v20, 0) > 1.5 THEN 'high_volume' WHEN volume / nullif(v20, 0) < 0.7::DOUBLE THEN 'low_volume' ELSE 'normal' END",
    "money_flow": "CASE WHEN o19 <> 0 AND (obv - o19) / o19 > 0.05::DOUBLE THEN 'accumulation' WHEN o19 <> 0 AND (obv - o19) / o19 < -0.05::DOUBLE THEN 'distribution'"
                  " WHEN o19 = 0 AND obv > 0 THEN 'accumulation' WHEN o19 = 0 AND obv < 0 THEN 'distribution' ELSE 'neutral' END",
    "volume_agreement": "vt", "primary_trend": vote_sql("'neutral'"), "primary_trend_strength": strength_sql("'mixed'"),
    "primary_trend_averages": vote_sql("ma"), "primary_trend_strength_averages": strength_sql("CASE WHEN above >= 3 THEN 'bullish' ELSE 'bearish' END"),
}
assert list(TREND_COLUMNS) == TREND_CLASS
feature_query("mt1_trend_classes", TREND_CLASS, f"WITH {B}, {', '.join(TREND)} SELECT pair, timeframe, ts, " + ", ".join(f"{e} AS {c}" for c, e in TREND_COLUMNS.items()) + " FROM p4")

# ---- pullback quality ----
NEARBY = " + ".join([*[one(f"abs(close - {e}) / nullif(close, 0) < 0.005::DOUBLE") for e in FIBSQL.values()],
                     *[one(f"abs(close - {one(f'abs(close - {e}) / nullif(close, 0) < 0.005::DOUBLE')}) / nullif(close, 0) < 0.005::DOUBLE") for e in FIBSQL.values()],
                     *[one(f"abs(close - {x}) / nullif(close, 0) < 0.01::DOUBLE") for x in ("e50", "s50", "s200")]])
QUALITY = [
    *MACD, *RSI, *STOCH, *ATRJ, *average_ctes(), SW, SW1, SW2,
    step("p0", {"s50": roll("avg", "close", 50), "s200": roll("avg", "close", 200), "hx": f"max(high) OVER {frame(10)}", "ln": f"min(low) OVER {frame(10)}",
                "swing_lows": f"count(*) FILTER (swing_low = 1) {CUM}", "v10": f"avg(volume) OVER {frame(10)}",
                "v20": "avg(volume) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING)"}, "s2"),
    "p1 AS (SELECT p0.*, rs.rsi, m.macd, s.sig, k1.k, atj.atr, e50 FROM p0 LEFT JOIN rs USING (pair, timeframe, ts) LEFT JOIN m USING (pair, timeframe, ts) LEFT JOIN s USING (pair, timeframe, ts)"
    " LEFT JOIN k1 USING (pair, timeframe, ts) LEFT JOIN atj USING (pair, timeframe, ts) LEFT JOIN em3 USING (pair, timeframe, ts))",
    step("p2", {"valid": "coalesce(rn >= 30 AND lh > ll, false)", "retr": "CASE WHEN rn >= 30 AND lh > ll THEN (lh - close) / (lh - ll) * 100 ELSE 0.0 END",
                "ratio": "CASE WHEN rn >= 30 AND lh > ll AND close > ll THEN (lh - close) / (close - ll) ELSE 1.0 END", "supports": NEARBY,
                "age": "CASE WHEN rh IS NULL THEN rn - 1 + 9999 ELSE rn - rh END",
                "pcl": prev("close"), "pc9": prev("close", 9), "pv": prev("volume"), "pl4": prev("low", 4), "pr4": prev("rsi", 4), "pm2": prev("macd", 2)}, "p1"),
    step("p3", {
        "depth": "CASE WHEN NOT valid THEN 0 WHEN retr BETWEEN 38.2::DOUBLE AND 61.8::DOUBLE THEN 100 WHEN retr BETWEEN 23.6::DOUBLE AND 78.6::DOUBLE THEN 75 WHEN retr < 23.6::DOUBLE THEN 50 ELSE 25 END",
        "structure": f"CASE WHEN rn < 30 THEN 0 ELSE least(100, greatest(0, {one('atr > 0 AND ((hx - ln) / nullif(ln, 0)) / nullif(atr / nullif(close, 0), 0) < 2.0')} * 25 + supports * 15 - {one('swing_lows >= 2 AND close < ll')} * 20)) END",
        "vol": f"CASE WHEN rn < 30 THEN 0 ELSE {one('v10 < v20 * 0.8::DOUBLE')} * 40 + {one('close < pc9 AND v10 < v20')} * 30 + {one('close > pcl AND volume > pv * 1.2::DOUBLE')} * 30 END",
        "mom": f"CASE WHEN rn < 30 THEN 0 ELSE least(100, {one('rsi < 30')} * 25 + {one('low < pl4 AND rsi > pr4')} * 35 + {one('macd > sig AND pm2 <= sig')} * 40 + {one('k < 20')} * 20 + {one('k > 20 AND k < 50')} * 10) END",
        "tm": "CASE WHEN rn < 30 THEN 0 WHEN age BETWEEN 3 AND 8 THEN 100 WHEN age BETWEEN 2 AND 12 THEN 75 WHEN age = 1 THEN 50 ELSE 25 END",
        "rr": "CASE WHEN NOT valid OR NOT close > ll THEN 0 WHEN ratio >= 3 THEN 100 WHEN ratio >= 2 THEN 80 WHEN ratio >= 1.5 THEN 60 WHEN ratio >= 1 THEN 40 ELSE 20 END"}, "p2"),
    step("p4", {"total": "round_even((depth * 20 + structure * 25 + vol * 15 + mom * 15 + tm * 10 + rr * 5)::DOUBLE / 100, 1)"}, "p3"),
]
assert list(WEIGHTS.values()) == [20, 25, 15, 15, 10, 10, 5]
QUALITY_COLUMNS = {
    "pullback_depth_score": "depth", "pullback_structure_score": "structure", "pullback_volume_score": "vol", "pullback_momentum_score": "mom", "pullback_fibonacci_score": "0",
    "pullback_time_score": "tm", "pullback_risk_reward_score": "rr", "pullback_retracement": "round(retr, 6)", "pullback_supports": "supports", "pullback_reward_ratio": "round(ratio, 6)",
    "pullback_overall": "total", "pullback_grade": ladder("total", GRADES, "F"), "pullback_recommendation": ladder("total", ADVICE, "avoid"),
    "pullback_confidence": f"CASE WHEN {one('depth >= 70')} + {one('structure >= 70')} + {one('vol >= 60')} + {one('mom >= 70')} >= 4 THEN 'medium' ELSE 'low' END",
}
assert list(QUALITY_COLUMNS) == PULLBACK_QUALITY
feature_query("mt3_pullback_quality", PULLBACK_QUALITY, f"WITH {B}, {', '.join(QUALITY)} SELECT pair, timeframe, ts, " + ", ".join(f"{e} AS {c}" for c, e in QUALITY_COLUMNS.items()) + " FROM p4")

# ---- three timeframes ----
TF = ("4h", "1h", "15m")
BARS3 = [bars_cte("15m", "b15"), bars_cte("1h", "b60"), bars_cte("4h", "b240"), "bars AS (SELECT * FROM b15 UNION ALL SELECT * FROM b60 UNION ALL SELECT * FROM b240)"]


def aligned_sql(source: str, cols: dict[str, str]) -> list[str]:
    """The columns of each timeframe as of the close of every fast bar: CTE ``al`` with h_, t_ and l_ columns."""
    sel = ", ".join(f"{e} AS {c}" for c, e in cols.items())
    put = lambda p, x: ", ".join(f"{x}.{c} AS {p}_{c}" for c in cols)
    return [f"side AS (SELECT pair, timeframe, ts, {sel} FROM {source})", *[f"side_{p} AS (SELECT * FROM side WHERE timeframe = '{tf}')" for p, tf in zip("htl", TF)],
            f"a1 AS (SELECT l.pair, l.timeframe, l.ts, {put('l', 'l')}, {put('t', 't')} FROM side_l l ASOF LEFT JOIN side_t t ON l.pair = t.pair AND l.ts >= t.ts + INTERVAL 45 MINUTE)",
            f"al AS (SELECT a1.*, {put('h', 'h')} FROM a1 ASOF LEFT JOIN side_h h ON a1.pair = h.pair AND a1.ts >= h.ts + INTERVAL 225 MINUTE)"]


def agreement(x: str, values: tuple) -> str:
    a, b, c, d = (f"'{v}'" if isinstance(v, str) else v for v in values)
    return f"CASE WHEN {x} <= 0.5 THEN {a} WHEN {x} <= 1.0 THEN {b} WHEN {x} <= 1.5 THEN {c} ELSE {d} END"


def trend_points(x: str) -> str:
    return f"({case(x, TREND_SCORES)})"


SYNTHESIS = [*TREND, *aligned_sql("p4", {"trend": TREND_COLUMNS["primary_trend"], "strength": TREND_COLUMNS["primary_trend_strength"], "quality": "quality", "osc": "osc"}),
             "y0 AS (SELECT *, coalesce(h_trend, 'neutral') AS th, coalesce(t_trend, 'neutral') AS tt, coalesce(l_trend, 'neutral') AS tl FROM al)",
             step("y1", {"sd": f"list_stddev_pop([{trend_points('th')}, {trend_points('tt')}, {trend_points('tl')}])",
                         "same": "CASE WHEN th = tt AND tt = tl THEN 3 WHEN th = tt OR tt = tl OR th = tl THEN 2 ELSE 1 END",
                         "up": " + ".join(one(f"{p}_osc = 'bullish'") for p in "htl"), "down": " + ".join(one(f"{p}_osc = 'bearish'") for p in "htl"),
                         "primary_trend": "list_max([" + ", ".join(f"{{'n': {one(f'th = {chr(39)}{x}{chr(39)}')} * 5 + {one(f'tt = {chr(39)}{x}{chr(39)}')} * 3 + {one(f'tl = {chr(39)}{x}{chr(39)}')} * 2, 'o': {-i}, 'label': '{x}'}}"
                                                                     for i, x in enumerate(LABELS)) + "]).label"}, "y0")]
SYNTHESIS_COLUMNS = {
    "htf_trend": "th", "ttf_trend": "tt", "ltf_trend": "tl", "primary_trend": "primary_trend",
    "trend_strength": "round((coalesce(h_strength, 0) * 5 + coalesce(t_strength, 0) * 3 + coalesce(l_strength, 0) * 2) / 10, 6)",
    "alignment": agreement("sd", ("perfect_alignment", "good_alignment", "partial_alignment", "conflicting")), "trend_alignment_score": "round(same / 3.0 * 100, 6)",
    "structure_quality_score": "round((" + " + ".join("(" + case(f"coalesce({p}_quality, 'poor')", QUALITY_POINTS) + f") * {w}" for p, w in SHARES.items()) + ") / 10.0, 6)",
    "momentum_alignment": "CASE WHEN up >= 2 THEN 'bullish_alignment' WHEN down >= 2 THEN 'bearish_alignment' ELSE 'mixed_momentum' END",
}
query("mt2_trend_synthesis", f"WITH {', '.join([*BARS3, *SYNTHESIS])} SELECT pair, timeframe, ts, " + ", ".join(f"{e} AS {c}" for c, e in SYNTHESIS_COLUMNS.items()) + " FROM y1")(
    lambda spark, sf: rounded(S.trend_synthesis(bars(spark, sf, *TF), TF)))

PIVOTS = f"""WITH {bars_cte('1h', 'b60')}, {bars_cte('4h', 'b240')}, bars AS (SELECT * FROM b60 UNION ALL SELECT * FROM b240), {SW},
  slow AS (SELECT pair, timeframe, ts, low AS price FROM s0 WHERE timeframe = '4h' AND swing_low = 1), fast AS (SELECT pair, ts, high FROM s0 WHERE timeframe = '1h' AND swing_low = 1),
  m AS (SELECT slow.*, f.ts AS near_ts, f.high AS near_high, row_number() OVER (PARTITION BY slow.pair, slow.ts ORDER BY abs(epoch_us(f.ts) - epoch_us(slow.ts)), f.ts) AS k
    FROM slow LEFT JOIN fast f ON f.pair = slow.pair)
  SELECT pair, timeframe, ts, round(price, 6) AS price, near_ts, round(near_high, 6) AS near_high, round(abs(epoch_us(near_ts) - epoch_us(ts)) / 1e6::DOUBLE, 6) AS seconds,
    round((near_high - price) / nullif(price, 0), 6) AS price_diff, coalesce(abs((near_high - price) / nullif(price, 0)) < 0.01::DOUBLE, false) AS agrees FROM m WHERE k = 1"""
query("jn7_nearest_pivot", PIVOTS)(lambda spark, sf: rounded(S.nearest_pivots(bars(spark, sf, "1h", "4h"), "4h", "1h", "low")))

ORDER = ("CASE WHEN coalesce(len(h8) < 3, true) OR coalesce(len(l8) < 3, true) THEN 'neutral' WHEN h8[-1].high < h8[-2].high AND h8[-2].high < h8[-3].high AND l8[-1].low < l8[-2].low AND l8[-2].low < l8[-3].low THEN 'strong_downtrend'"
         " WHEN h8[-1].high < h8[-2].high AND h8[-2].high < h8[-3].high THEN 'weak_downtrend'"
         " WHEN h8[-1].high > h8[-2].high AND h8[-2].high > h8[-3].high AND l8[-1].low > l8[-2].low AND l8[-2].low > l8[-3].low THEN 'strong_uptrend'"
         " WHEN h8[-1].high > h8[-2].high AND h8[-2].high > h8[-3].high THEN 'weak_uptrend' ELSE 'neutral' END")
STATE = {"rsi": ("rsi < 30", "rsi > 70"), "macd": ("macd > 0", "macd < 0"), "stoch_k": ("k < 20", "k > 80"), "momentum_continuation": ("r5 > 50 AND close > pcl", "r5 < 50 AND close < pcl")}
ALIGNED = [
    *MACD[:2], *RSI, *STOCH, SW,
    step("p0", {"h8": f"(list({{'ts': ts, 'high': high, 'low': low}}) FILTER (swing_high = 1) {CUM})[-8:]", "l8": f"(list({{'ts': ts, 'high': high, 'low': low}}) FILTER (swing_low = 1) {CUM})[-8:]",
                "swings": f"sum(swing_high + swing_low) {CUM}", "pcl": prev("close"), "vm": roll("avg", "volume", 20), "pr": roc("close", 1),
                "seen": one(f"rn >= 16 AND {prev('close', 5)} > max(close) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING) AND close < {prev('close', 5)} * 0.98::DOUBLE"),
                "vd": one(f"rn > 20 AND close < {prev('close', 5)} AND avg(volume) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
                          " < avg(volume) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING) * 0.8::DOUBLE")}, "s0"),
    "p1 AS (SELECT p0.*, rs.rsi, m.macd, k1.k FROM p0 LEFT JOIN rs USING (pair, timeframe, ts) LEFT JOIN m USING (pair, timeframe, ts) LEFT JOIN k1 USING (pair, timeframe, ts))",
    step("p2", {"r5": roll("avg", "rsi", 5), "sd": roll("stddev_samp", "pr", 20), "pullbacks": f"sum(seen) {CUM}"}, "p1"),
    step("p3", {"vc": "CASE WHEN volume > vm * 1.5 AND abs(pr) > sd AND close > pcl THEN 1 WHEN volume > vm * 1.5 AND abs(pr) > sd AND close < pcl THEN -1 ELSE 0 END", "ord": ORDER,
                "strength": "CASE WHEN rn < 20 THEN 0.0 ELSE least(1.0, swings / greatest(1, rn // 20)) END",
                **{f"st_{s}": f"CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END" for s, (u, d) in STATE.items()}}, "p2"),
    *aligned_sql("p3", {c: c for c in ("h8", "l8", "ord", "strength", "pullbacks", "vc", "vd", *[f"st_{s}" for s in STATE])}),
]


def met_sql(p: str, ring: str, side: str) -> str:
    near = f"{p}_{ring}[-{LOOK[p]}:]"
    best = f"list_min(list_transform({near}, lambda x: {{'d': abs(epoch_us(x.ts) - epoch_us(s.ts)), 'ts': x.ts, 'high': x.high}})).high"
    return f"coalesce(len(list_filter(h_{ring}[-3:], lambda s: coalesce(abs(({best} - s.{side}) / nullif(s.{side}, 0)) < {TOLERANCE[p]}::DOUBLE, false))), 0)"


_met = " + ".join(met_sql(p, r, side) for r, side in (("h8", "high"), ("l8", "low")) for p in "tl")
_asked = "2 * (coalesce(len(h_h8[-3:]), 0) + coalesce(len(h_l8[-3:]), 0))"
_back = "[coalesce(h_pullbacks, 0), coalesce(t_pullbacks, 0), coalesce(l_pullbacks, 0)]"
SCORES = {
    "trend_score": agreement(f"list_stddev_pop([{', '.join(trend_points(f'coalesce({p}_ord, {chr(39)}neutral{chr(39)})') for p in 'htl')}])", (1.0, 0.75, 0.5, 0.25)),
    "swing_score": f"CASE WHEN {_asked} > 0 THEN ({_met}) / ({_asked}) ELSE 0.0 END",
    "pullback_score": f"CASE WHEN list_min({_back}) > 0 THEN list_min({_back}) / list_max({_back}) ELSE 0.0 END",
    "structure_score": "(coalesce(h_strength, 0) + coalesce(t_strength, 0) + coalesce(l_strength, 0)) / 3",
    "momentum_score": "(" + " + ".join(one(f"coalesce(h_st_{s}, 0) = coalesce(t_st_{s}, 0) AND coalesce(t_st_{s}, 0) = coalesce(l_st_{s}, 0)") for s in STATE) + ") / 4.0",
    "volume_score": "(" + " + ".join(one(f"(coalesce(h_{c}, 0) > 0 AND coalesce(t_{c}, 0) > 0 AND coalesce(l_{c}, 0) > 0) OR (coalesce(h_{c}, 0) < 0 AND coalesce(t_{c}, 0) < 0 AND coalesce(l_{c}, 0) < 0)") for c in ("vc", "vd")) + ") / 3.0",
}
_total = " + ".join(f"{p}_score::DOUBLE * {w}::DOUBLE" for p, w in PARTS.items())
query("mt6_structure_alignment", f"WITH {', '.join([*BARS3, *ALIGNED])}, z0 AS (SELECT pair, timeframe, ts, {', '.join(f'{e} AS {c}' for c, e in SCORES.items())} FROM al),"
      f" z1 AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_total})) AS score FROM z0) SELECT pair, timeframe, ts, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in SCORES)}, round(score + 1e-9::DOUBLE, 6) AS alignment_score,"
      f" {ladder('(score + 1e-9::DOUBLE)', CLASSES, 'conflicting')} AS alignment_class FROM z1")(
    # scores fall on exact half units of the last place; a fixed nudge settles them on both sides
    lambda spark, sf: rounded(S.structure_alignment(bars(spark, sf, *TF), TF).withColumn("alignment_score", F.col("alignment_score") + 1e-9)))

# ---- first touch ----
TOUCH = f"""WITH {B}, e AS (SELECT pair, timeframe, ts, high, low, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn,
    max(high) OVER {frame(50)} AS target, min(low) OVER {frame(50)} AS stop FROM bars),
  hit AS (SELECT e.pair, e.timeframe, e.ts, arg_min(b.rn, b.rn) AS t, arg_min(b.ts, b.rn) AS touch_ts, arg_min(b.low <= e.stop, b.rn) AS stopped
    FROM e JOIN e b ON b.pair = e.pair AND b.timeframe = e.timeframe AND b.rn > e.rn AND (b.high >= e.target OR b.low <= e.stop) GROUP BY ALL)
  SELECT pair, timeframe, ts, round(target, 6) AS target, round(stop, 6) AS stop, touch_ts, CASE WHEN stopped THEN 'stop' WHEN NOT stopped THEN 'target' END AS touch_side, t - rn AS bars_held
  FROM e LEFT JOIN hit USING (pair, timeframe, ts)"""


@query("jn12_first_touch", TOUCH)
def _touch(spark, sf):
    """From every bar, the first later one that leaves the range of the 50 bars up to it."""
    b = bars(spark, sf)
    framed = compute(b, ["_high_50", "_low_50"])
    entries = framed.select(*KEYS, F.col("_high_50").alias("target"), F.col("_low_50").alias("stop"))
    return rounded(first_touch(entries, b))

# ---- confluence ----
CONFIG = {"h": ("macd", "obv"), "t": ("rsi", "macd", "roc"), "l": ("rsi", "bb_pct", "swing_low", "momentum")}


def mean_sql(parts) -> str:
    parts = list(parts)
    return f"(({' + '.join(parts)}) / {float(len(parts))}::DOUBLE)"


def strength_of(s: str) -> str:
    if "rsi" in s:
        return f"CASE WHEN {s} < 40 THEN 0.8::DOUBLE - {s} / 100 ELSE 0.5::DOUBLE END"
    if "macd" in s:
        return f"coalesce(least(0.9::DOUBLE, abs({s} - sig) * 10), 0.9::DOUBLE)"
    if "bb" in s:
        return f"CASE WHEN abs({s}) > 0.8::DOUBLE THEN 0.8::DOUBLE WHEN abs({s}) > 0.5 THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END"
    if "swing" in s:
        return f"CASE WHEN {s} <> 0 THEN 0.7::DOUBLE + abs({s}) * 0.3::DOUBLE ELSE 0.5::DOUBLE END"
    return "0.5::DOUBLE"


_SIGNALS = list(dict.fromkeys(s for g in CONFIG.values() for s in g))
_STATES = {"macd": ("macd > 0", "macd < 0"), "obv": (f"round(obv - {prev('obv')}, 6) > 0", "false"), "rsi": ("rsi < 30", "rsi > 70"), "roc": ("roc > 0", "roc < 0"),
           "bb_pct": ("bb_pct < 0.2::DOUBLE", "bb_pct > 0.8::DOUBLE"), "swing_low": ("swing_low = 1", "false"), "momentum": ("momentum > 0", "momentum < 0")}
CONF = [
    *MACD, *RSI, *OBV, *ADX, *ATRJ[2:], SW,
    step("p0", {"vm": roll("avg", "volume", 20), "pr": roc("close", 1), "pcl": prev("close"), "pc9": prev("close", 9), "roc": f"{roc('close', 10)} * 100",
                "momentum": f"close - {prev('close', 10)}", "bm": roll("avg", "close", 20), "bs": roll("stddev_samp", "close", 20),
                "rp": f"(({roll('max', 'high', 10)}) - ({roll('min', 'low', 10)})) / nullif(close, 0)",
                "v5": f"avg(volume) OVER {frame(5)}", "w5": "avg(volume) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING)",
                "swings": f"sum(swing_high + swing_low) OVER {frame(20)}"}, "s0"),
    "p1 AS (SELECT p0.*, rs.rsi, m.macd, s.sig, q1.obv, z.adx, atj.atr, (p0.close - (bm - 2 * bs)) / nullif(4 * bs, 0) AS bb_pct FROM p0 LEFT JOIN rs USING (pair, timeframe, ts) LEFT JOIN m USING (pair, timeframe, ts)"
    " LEFT JOIN s USING (pair, timeframe, ts) LEFT JOIN q1 USING (pair, timeframe, ts) LEFT JOIN z USING (pair, timeframe, ts) LEFT JOIN atj USING (pair, timeframe, ts))",
    step("p2", {"sdp": roll("stddev_samp", "pr", 20), "eq": one(f"rp < ({roll('avg', 'rp', 20)}) * 0.5"), "am": roll("avg", "atr", 20)}, "p1"),
    step("p3", {"vc": "CASE WHEN volume > vm * 1.5 AND abs(pr) > sdp AND close > pcl THEN 1 ELSE 0 END", "eqs": f"sum(eq) OVER {frame(10)}",
                **{f"sy_{s}": f"CASE WHEN rn < 10 THEN 0.3::DOUBLE ELSE sum({one(f'{s} > 0')}) OVER {frame(10)} / 10.0::DOUBLE END" for s in _SIGNALS},
                **{f"sg_{s}": strength_of(s) for s in _SIGNALS}, **{f"on_{s}": one(f"{s} > 0") for s in _SIGNALS},
                **{f"st_{s}": f"CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END" for s, (u, d) in _STATES.items()}}, "p2"),
    step("p4", {"c_volume": f"least(1.0::DOUBLE, CASE WHEN volume > vm * 1.2::DOUBLE THEN 0.4::DOUBLE WHEN volume > vm THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + {one('rn >= 10 AND v5 > w5')} * 0.3::DOUBLE + {one('vc > 0')} * 0.3::DOUBLE)",
                "c_rsi": "CASE WHEN rsi > 30 AND rsi < 70 THEN 0.7::DOUBLE WHEN rsi > 50 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END",
                "c_macd": "CASE WHEN macd > sig THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END",
                "c_dir": "CASE WHEN rn < 10 THEN 0.5::DOUBLE WHEN close > pc9 THEN 0.8::DOUBLE ELSE 0.3::DOUBLE END",
                "c_structure": f"{one('swings BETWEEN 3 AND 8')} * 0.4::DOUBLE + {one('eqs >= 2')} * 0.3::DOUBLE",
                "c_regime": "least(1.0::DOUBLE, CASE WHEN atr > am * 1.3::DOUBLE OR atr < am * 0.7::DOUBLE THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END + CASE WHEN adx > 25 THEN 0.4::DOUBLE WHEN adx > 20 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END)",
                "c_vol": "atr / nullif(close, 0)"}, "p3"),
    *aligned_sql("p4", {c: c for c in ("c_volume", "c_rsi", "c_macd", "c_dir", "c_structure", "c_regime", "c_vol", *[f"{k}_{s}" for s in _SIGNALS for k in ("sy", "sg", "on", "st")])}),
]


def over(c: str, other: float) -> str:
    return mean_sql(f"coalesce({p}_{c}, {other}::DOUBLE)" for p in "htl")


_pairs = [(p, s) for p, g in CONFIG.items() for s in g]
_shares = [mean_sql(f"CASE WHEN {p}_st_{s} = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for s in g) for p, g in CONFIG.items()]
COMPONENTS = {
    "timeframe_alignment": "0.0::DOUBLE",
    "signal_strength": f"least(100.0::DOUBLE, ({mean_sql(f'coalesce({p}_sg_{s}, 0.5::DOUBLE)' for p, s in _pairs)} * 0.6::DOUBLE + {mean_sql(f'coalesce({p}_sy_{s}, 0.3::DOUBLE)' for p, s in _pairs)} * 0.4::DOUBLE) * 100)",
    "volume_confirmation": f"{over('c_volume', 0.0)} * 100", "momentum_alignment": f"{mean_sql([over('c_rsi', 0.3), over('c_macd', 0.3)])} * 100",
    "structure_quality": f"{over('c_structure', 0.0)} * 100", "regime_alignment": f"{over('c_regime', 0.8)} * 100",
}
assert list(COMPONENTS) == list(C.WEIGHTS)
_share = f"least(100.0::DOUBLE, ({mean_sql(_shares)} * 0.8::DOUBLE + CASE WHEN list_min([{', '.join(_shares)}]) >= 0.8::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * 0.2::DOUBLE) * {1 - (max(0.0, 1 - 10 / len(_pairs)) if len(_pairs) < 10 else 0.0)}::DOUBLE * 100)"
_NUDGED = [*C.WEIGHTS, "state_alignment", "confluence_score"]
_parts = lambda cond: "list_filter([" + ", ".join(f"CASE WHEN {n} {cond} THEN '{n}' END" for n in C.WEIGHTS) + "], lambda x: x IS NOT NULL)"


def nudged(df):
    """Shares of few signals fall on exact half units of the last place; a fixed nudge settles them on both sides."""
    return rounded(df.withColumns({c: F.col(c) + 1e-9 for c in df.columns if c in _NUDGED}))


query("mt4_confluence_scores", f"WITH {', '.join([*BARS3, *CONF])}, y0 AS (SELECT pair, timeframe, ts, {', '.join(f'{e} AS {c}' for c, e in COMPONENTS.items())}, {_share} AS state_alignment FROM al),"
      f" y1 AS (SELECT *, least(100.0::DOUBLE, {' + '.join(f'{n} * {w}::DOUBLE' for n, w in C.WEIGHTS.items())}) AS confluence_score FROM y0)"
      f" SELECT pair, timeframe, ts, {', '.join(f'round({c} + 1e-9::DOUBLE, 6) AS {c}' for c in _NUDGED)}, "
      + ", ".join(f"{ladder('(confluence_score + 1e-9::DOUBLE)', {k: v[i] for k, v in C.GRADES.items()}, C.LOWEST[i])} AS {n}" for i, n in enumerate(("grade", "recommendation", "confidence_level")))
      + f", {_parts('+ 1e-9::DOUBLE >= 80')} AS strengths, {_parts('- 1e-9::DOUBLE <= 40')} AS weaknesses FROM y1")(
    lambda spark, sf: nudged(C.confluence_scores(bars(spark, sf, *TF), TF, CONFIG)))
_known = " + ".join(one(f"{p}_c_vol IS NOT NULL") for p in "htl")
BREAKDOWN = {
    **{f"{p}_{k}": e for p, g in CONFIG.items() for k, e in (("active", " + ".join(f"coalesce({p}_on_{s}, 0)" for s in g)), ("activation_rate", "round((" + " + ".join(f"coalesce({p}_on_{s}, 0)" for s in g) + f") / {len(g)}.0::DOUBLE, 6)"))},
    **{f"{k}_{w}": f"{v}::DOUBLE" if w == "coverage" else str(v) for k, (n, cov) in C.categories(CONFIG).items() for w, v in (("signals", n), ("coverage", round(cov, 6)))},
    "timeframe_confirmation": f"round({over('c_dir', 0.5)}, 6)", "signal_density": "1.0::DOUBLE",
    "risk_adjusted_score": f"round(greatest(0.0::DOUBLE, 1 - CASE WHEN {_known} > 0 THEN (coalesce(h_c_vol, 0) + coalesce(t_c_vol, 0) + coalesce(l_c_vol, 0)) / ({_known}) ELSE 0.02::DOUBLE END), 6)",
}
query("mt5_confluence_breakdown", f"WITH {', '.join([*BARS3, *CONF])} SELECT pair, timeframe, ts, {', '.join(f'{e} AS {c}' for c, e in BREAKDOWN.items())} FROM al")(
    lambda spark, sf: rounded(C.confluence_breakdown(bars(spark, sf, *TF), TF, CONFIG)))


# ---- modes H and I ----
def held(up: str, down: str) -> str:
    """The newest of two events while it is at most its timeframe's hold old."""
    e = f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"
    return (f"CASE WHEN rn - max(CASE WHEN {e} <> 0 THEN rn END) OVER {frame(6)} <= CASE timeframe WHEN '15m' THEN 3 ELSE 4 END"
            f" THEN last_value(CASE WHEN {e} <> 0 THEN {e} END IGNORE NULLS) OVER {frame(6)} ELSE 0 END")


P10 = "OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
SIGNAL_SQL = [
    f"x_tr AS (WITH {', '.join(TREND)} SELECT pair, timeframe, ts, {', '.join(f'{TREND_COLUMNS[c]} AS {c}' for c in ('primary_trend', 'primary_trend_strength', 'oscillator_trend', 'swing_trend_quality'))} FROM p4)",
    f"x_pq AS (WITH {', '.join(QUALITY)} SELECT pair, timeframe, ts, total, round_even((structure * 25 + vol * 15 + mom * 15 + tm * 10)::DOUBLE / 100, 1) AS total_bear FROM p4)",
    f"x_cx AS (WITH {', '.join(CTX[1:])} SELECT pair, timeframe, ts, pcb, pcs FROM u3)",
    f"x_ts AS (WITH {', '.join(TS)} SELECT pair, timeframe, ts, CASE WHEN sh >= 0.55::DOUBLE THEN 1 WHEN sh < 0.45::DOUBLE THEN -1 ELSE 0 END AS structure FROM t6)",
    f"x_pv AS (WITH {', '.join(PIV)} SELECT pair, timeframe, ts, {held('coalesce(close > lh AND volume > vm * 1.2::DOUBLE, false)', 'false')} AS break_up, {held('false', 'coalesce(close < ll AND volume > vm * 1.2::DOUBLE, false)')} AS break_down FROM p1)",
    f"x_md AS (WITH {', '.join(RS11)}, dd AS (SELECT *, coalesce(n11 = 11 AND low < min(low) {P10} AND rsi > min(rsi) {P10}, false) AS up, coalesce(n11 = 11 AND high > max(high) {P10} AND rsi < max(rsi) {P10}, false) AS down,"
    f" row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn FROM d) SELECT pair, timeframe, ts, {held('up', 'false')} AS div_up, {held('false', 'down')} AS div_down FROM dd)",
    "x_rt AS (SELECT pair, timeframe, ts, (lead(close, 5) OVER (PARTITION BY pair, timeframe ORDER BY ts) / nullif(close, 0) - 1) * 100 AS ret FROM bars)",
    "x AS (SELECT * FROM x_tr " + " ".join(f"JOIN x_{n} USING (pair, timeframe, ts)" for n in ("pq", "cx", "ts", "pv", "md", "rt")) + ")",
    *aligned_sql("x", {c: c for c in ("primary_trend", "primary_trend_strength", "total", "total_bear", "pcb", "pcs", "structure", "break_up", "break_down", "div_up", "div_down", "ret")}),
    step("w0", {"th": "coalesce(h_primary_trend, 'neutral')", "tt": "coalesce(t_primary_trend, 'neutral')", "tl": "coalesce(l_primary_trend, 'neutral')"}, "al"),
    step("w1", {"trend": SYNTHESIS[-1][SYNTHESIS[-1].index("list_max(["):SYNTHESIS[-1].rindex("]).label")] + "]).label",
                "strength": "(coalesce(h_primary_trend_strength, 0) * 5 + coalesce(t_primary_trend_strength, 0) * 3 + coalesce(l_primary_trend_strength, 0) * 2) / 10"}, "w0"),
]
_H = {"uptrend_pullback": ("bullish", "strength >= 50", "h_structure = 1 AND t_pcb = 1 AND l_break_up = 1", "strength"),
      "downtrend_rally": ("bearish", "strength >= 50", "h_structure = -1 AND t_pcs = 1 AND l_break_down = -1", "strength")}
_I = {"hq_bullish_pullback": ("bullish", "coalesce(l_total, 0) >= 80", "h_structure = 1 AND t_pcb = 1 AND l_div_up = 1", "l_total"),
      "hq_bearish_pullback": ("bearish", "coalesce(l_total_bear, 0) >= 80", "h_structure = -1 AND t_pcs = 1 AND l_div_down = -1", "l_total_bear")}


def gate_sql(setups: dict, bonus: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT pair, l_ret AS ret, '{n}' AS setup, '{d}' AS direction, {g} AS grade, trend IN ({', '.join(repr(t) for t in D.TRENDS[1 if d == 'bullish' else -1])}) AND {cond} AS gate, coalesce({on}, false) AS sig FROM w1"
        for n, (d, cond, on, g) in setups.items())
    return (f"WITH {', '.join([*BARS3, *SIGNAL_SQL])}, v AS ({rows}), g AS (SELECT pair, setup, direction, sum(gate::INT) AS gated_bars, sum(sig::INT) AS signal_bars, sum((gate AND sig)::INT) AS sample_size,"
            " avg(CASE WHEN gate AND sig THEN CASE WHEN coalesce(CASE direction WHEN 'bullish' THEN ret > 0 ELSE ret < 0 END, false) THEN 1.0 ELSE 0.0 END END) AS acc, avg(CASE WHEN gate AND sig THEN grade END) AS gs FROM v GROUP BY ALL)"
            f" SELECT pair, setup, direction, gated_bars, signal_bars, sample_size, round(acc, 6) AS discovered_accuracy, round(gs, 6) AS gate_score, round(acc * {bonus}, 6) AS performance_score FROM g")


def gate_query(name: str, mode: str, sql: str):
    @query(name, sql)
    def run(spark, sf):
        states, raw = D.signals_of(mode)
        return rounded(D.gate_report(mtf_table(bars(spark, sf, *TF), TF, states, [*raw, *D.CONTEXT_EXTRA]), mode, "bar"))


gate_query("dsc10_mode_h", "h", gate_sql(_H, "1.1"))
gate_query("dsc11_mode_i", "i", gate_sql(_I, "(1 + gs / 100)"))

# ---- rule categories over averages, levels, price action, pullbacks, patterns and anomalies ----
_NAMES = {"23_6": "236", "38_2": "382", "50_0": "500", "61_8": "618", "78_6": "786"}
_STAGE = SQL["sw17_pullback_stage"].rsplit("SELECT pair, timeframe, ts, ", 1)[1].split(" AS pullback_stage", 1)[0]
RULE_SQL = [
    f"x_av AS (WITH {ewm_cte('em4', 'bars', 'close', [ema_spec('ema_9', 9), ema_spec('ema_26', 26), ema_spec('ema_50', 50), ema_spec('ema_200', 200)])},"
    f" q AS (SELECT *, {roll('avg', 'close', 50)} AS sma_50, {roll('avg', 'close', 200)} AS sma_200, ({roll('sum', 'close * volume', 20)}) / nullif({roll('sum', 'volume', 20)}, 0) AS vwma,"
    f" sum((high + low + close) / 3 * volume) {CUM} / nullif(sum(volume) {CUM}, 0) AS vwap FROM bars) SELECT * FROM q LEFT JOIN em4 USING (pair, timeframe, ts))",
    f"x_cx AS (WITH {', '.join(CTX[1:])} SELECT pair, timeframe, ts, tshort AS trend_short, tmed AS trend_medium, tlong AS trend_long, swing_high, swing_low, sr AS sr_confluence_score, q AS pullback_quality_score,"
    f" pcb AS pullback_complete_bull, pcs AS pullback_complete_bear, pfh AS pullback_from_high_pct, {', '.join(f'f{k} AS near_fib_{v}' for k, v in _NAMES.items())},"
    f" {one('tmed = 1 AND mid AND close < pc')} AS healthy_bull_pullback, {one('tmed = -1 AND mid AND close > pc')} AS healthy_bear_pullback,"
    f" {one('rn > 20 AND len(l3) >= 3 AND l3[-2] > l3[-3] AND l3[-1] > l3[-2] AND tmed = 1')} AS higher_lows_pattern, {one('rn > 20 AND len(h3) >= 3 AND h3[-2] < h3[-3] AND h3[-1] < h3[-2] AND tmed = -1')} AS lower_highs_pattern,"
    f" {', '.join(one(f'abs(close - {c}) / nullif({c}, 0) < 0.01::DOUBLE') + f' AS pullback_to_{n}' for c, n in (('m9', 'ema9'), ('m26', 'ema20'), ('s50', 'sma50')))},"
    f" {one('tmed = -1 AND close > lh AND volume > v5')} AS failed_pullback_bear, (lh + rng - close) / nullif(close, 0) * 100 AS distance_to_bull_target_pct,"
    f" (close - (ll - rng)) / nullif(close, 0) * 100 AS distance_to_bear_target_pct, {_STAGE} AS pullback_stage FROM u3)",
    f"x_ab AS (WITH {', '.join(ABC)} SELECT pair, timeframe, ts, {one('len(lo) = 21 AND pa - 1 < 16 AND pb - 1 < (22 - pa) - 2 AND list_min(lo[pa + pb - 1:]) > list_min(lo) * 1.005::DOUBLE')} AS abc_pullback_bull,"
    f" {one('len(hi) = 21 AND qa - 1 < 16 AND qb - 1 < (22 - qa) - 2 AND list_max(hi[qa + qb - 1:]) < list_max(hi) * 0.995::DOUBLE')} AS abc_pullback_bear FROM l2)",
    f"x_sh AS (WITH r AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn FROM bars), q AS (SELECT *, CASE WHEN {roc('close', 1)} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS u,"
    f" CASE WHEN count(*) OVER {frame(5)} > 1 THEN regr_slope(close, rn) OVER {frame(5)} ELSE 0 END AS s FROM r)"
    f" SELECT pair, timeframe, ts, ({roll('avg', 'u', 10)}) - 0.5 AS directional_persistence, {roll('avg', 's', 3, True)} AS local_slope FROM q)",
    f"x_cd AS (WITH {SHAPE}, {SMALL}, {CANDLE_FLAGS} SELECT pair, timeframe, ts, {', '.join(f'{c} AS pattern_{c}' for c in CANDLE_SQL)}, {', '.join(f'0 AS pattern_{p}' for p in PLACEHOLDERS)},"
    f" ({roll('sum', '(hammer + bullish_engulfing + morning_star + inverted_hammer)', 5)})::BIGINT AS recent_bullish_patterns,"
    f" ({roll('sum', '(shooting_star + bearish_engulfing + evening_star + hanging_man)', 5)})::BIGINT AS recent_bearish_patterns,"
    f" ({roll('sum', '(doji + dragonfly_doji + gravestone_doji + long_legged_doji)', 5)})::BIGINT AS recent_doji FROM fl)",
    f"x_an AS (WITH {', '.join(ATRJ)} SELECT pair, timeframe, ts, abs(open - {prev('close')}) / nullif({prev('close')}, 0) AS gap_intensity, (high - low) / nullif(atr, 0) AS extended_bar_ratio,"
    f" {one('volume > 2 * v20')} AS volume_spike FROM (SELECT *, {roll('avg', 'volume', 20)} AS v20 FROM atj))",
    "x AS (SELECT * FROM x_av " + " ".join(f"JOIN x_{n} USING (pair, timeframe, ts)" for n in ("cx", "ab", "sh", "cd", "an")) + ")",
]
_COLUMNS = ["open", "close", *P.PATTERN_INPUTS, *[f"pattern_{c}" for c in (*CANDLE_SQL, *PLACEHOLDERS)]]


def counted_rules(name: str, *categories: str):
    rules = {c: P.applicable(P.PATTERN_RULES[c], _COLUMNS) for c in categories}
    sums = ", ".join((" + ".join(one(r[2]) for r in rules[c]) or "0") + f" AS {c}" for c in categories)

    @query(name, f"WITH {B}, {', '.join(RULE_SQL)} SELECT pair, timeframe, ts, {sums} FROM x")
    def run(spark, sf):
        wanted = [n for n in _COLUMNS if n not in ("open", "close")]
        return compute(bars(spark, sf), wanted).select(*KEYS, *[F.size(P.confirmations(rules[c])).alias(c) for c in categories])


counted_rules("rl5_average_confirmations", "average_bull", "average_bear")
counted_rules("rl6_level_confirmations", "fibonacci_bull", "fibonacci_bear")
counted_rules("rl7_action_confirmations", "action_bull", "action_bear")
counted_rules("rl8_pullback_confirmations", "pullback_bull", "pullback_bear")
counted_rules("rl9_pattern_confirmations", "candle_bull", "candle_bear", "candle_neutral", "chart_bull", "chart_bear", "chart_neutral")
counted_rules("rl10_anomaly_confirmations", "anomaly_bull", "anomaly_bear")


@query("rl12_entry_points")
def _entries(spark, sf):
    """All categories of a side together, as a sorted list of texts."""
    x = P.entry_points(compute(bars(spark, sf), [*dict.fromkeys([*P.INPUTS, *P.PATTERN_INPUTS, *[n for n in _COLUMNS if n.startswith("pattern_")]])]))
    return x.select(*KEYS, *[F.size(f"{s}_{k}").alias(f"{s}_{k}") for s in P.ENTRY_POINTS for k in ("indicators", "patterns")])
