"""Indicator queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import (
    KEYS, bars, bars_cte, ema_spec, ewm_cte, features, frame, prev, query, rma_spec, roll, rounded, sql_flags, sql_select,
)
from barloom.functions.candles import CANDLES, PLACEHOLDERS
from barloom.functions.registry import compute
from barloom.functions.swings import FIB, LOOKBACK_BY_TIMEFRAME

B = bars_cte("1h")


def feature_query(name: str, cols: list[str], sql: str | None = None):
    query(name, sql)(lambda spark, sf, c=tuple(cols): features(spark, sf, list(c)))


def closed(name: str, cols: dict[str, str], ctes=(), source="bars", joins=()):
    feature_query(name, list(cols), sql_select([B, *ctes], cols, source, joins))


def step(name: str, cols: dict[str, str], source: str = "bars") -> str:
    """A CTE that adds columns."""
    return f"{name} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {source})"


def wma_sql(x: str, n: int) -> str:
    parts = " + ".join(f"{n - k} * " + (f"{x}" if k == 0 else prev(x, k)) for k in range(n))
    return f"({parts}) / {n * (n + 1) / 2}"


def nz(x: str) -> str:
    return f"nullif({x}, 0)"


def roc(x: str, k: int) -> str:
    return f"(({x} - {prev(x, k)}) / {nz(prev(x, k))})"


TR = f"greatest(high - low, abs(high - {prev('close')}), abs(low - {prev('close')}))"
TP = "((high + low + close) / 3)"

# ---- moving averages ----
closed("ma1_sma", {f"sma_{n}": roll("avg", "close", n) for n in (7, 20, 50, 100, 200)})
closed("ma2_ema", {f"ema_{n}": f"ema_{n}" for n in (9, 12, 26, 50, 200)},
       [ewm_cte("e", "bars", "close", [ema_spec(f"ema_{n}", n) for n in (9, 12, 26, 50, 200)])], joins=["e"])
closed("ma3_wma", {"wma_20": wma_sql("close", 20)})
closed("ma4_smma", {"smma": "smma"}, [ewm_cte("e", "bars", "close", [rma_spec("smma", 14)])], joins=["e"])
E3 = [ewm_cte("e1", "bars", "close", [ema_spec("a1", 20)]), ewm_cte("e2", "e1", "a1", [ema_spec("a2", 20)]),
      ewm_cte("e3", "e2", "a2", [ema_spec("a3", 20)])]
closed("ma5_dema", {"dema": "2 * a1 - a2"}, E3[:2], joins=["e1", "e2"])
closed("ma6_tema", {"tema": "3 * a1 - 3 * a2 + a3"}, E3, joins=["e1", "e2", "e3"])
closed("ma7_hma", {"hma": wma_sql("raw", 4)},
       [step("h", {"raw": f"2 * ({wma_sql('close', 10)}) - ({wma_sql('close', 20)})"})], "h")
closed("ma8_lsma", {"lsma": f"CASE WHEN rn >= 25 THEN regr_slope(close, rn) OVER {frame(25)} * rn"
                            f" + regr_intercept(close, rn) OVER {frame(25)} END"},
       ["r AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn FROM bars)"], "r")
feature_query("ma9_mcginley", ["mcginley"])
closed("ma10_vwma", {"vwma": f"({roll('sum', 'close * volume', 20)}) / {nz(roll('sum', 'volume', 20))}"})
KAMA = f"""k0 AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn,
    abs(close - {prev('close')}) AS ch FROM bars),
  k1 AS (SELECT *, pow(coalesce(abs(close - {prev('close', 10)}) / nullif(sum(ch) OVER {frame(10)}, 0), 0)
    * (2.0/3 - 2.0/31) + 2.0/31, 2) AS sc FROM k0),
  k AS (SELECT pair, timeframe, ts, rn, close AS kama FROM k1 WHERE rn = 1
    UNION ALL SELECT n.pair, n.timeframe, n.ts, n.rn, CASE WHEN n.rn <= 10 THEN k.kama ELSE k.kama + n.sc * (n.close - k.kama) END
    FROM k JOIN k1 n ON n.pair = k.pair AND n.timeframe = k.timeframe AND n.rn = k.rn + 1)"""
feature_query("ma11_kama", ["kama"], f"WITH RECURSIVE {B}, {KAMA} SELECT pair, timeframe, ts, round(kama, 6) AS kama FROM k")

# ---- trend ----
E1226 = ewm_cte("e", "bars", "close", [ema_spec("e12", 12), ema_spec("e26", 26)])
MACD = [E1226, "m AS (SELECT *, e12 - e26 AS macd FROM e)", ewm_cte("s", "m", "macd", [ema_spec("sig", 9)])]
closed("tr1_macd", {"macd": "macd", "macd_signal": "sig", "macd_hist": "macd - sig",
                    "macd_mean": f"coalesce({roll('avg', 'macd', 50, True)}, 0)"}, MACD, joins=["m", "s"])
ADX = [
    step("d", {"tr": TR, "dp": f"CASE WHEN high - {prev('high')} > {prev('low')} - low AND high - {prev('high')} > 0 THEN high - {prev('high')} ELSE 0 END",
               "dm": f"CASE WHEN {prev('low')} - low > high - {prev('high')} AND {prev('low')} - low > 0 THEN {prev('low')} - low ELSE 0 END"}),
    ewm_cte("ra", "d", "tr", [rma_spec("atr", 14)]), ewm_cte("rp", "d", "dp", [rma_spec("p", 14)]),
    ewm_cte("rm", "d", "dm", [rma_spec("m", 14)]),
    "x AS (SELECT pair, timeframe, ts, 100 * p / nullif(atr, 0) AS di_plus, 100 * m / nullif(atr, 0) AS di_minus FROM ra JOIN rp USING (pair, timeframe, ts) JOIN rm USING (pair, timeframe, ts))",
    "y AS (SELECT *, 100 * abs(di_plus - di_minus) / nullif(di_plus + di_minus, 0) AS dx FROM x)",
    ewm_cte("z", "y", "dx", [rma_spec("adx", 14)]),
]
closed("tr2_adx", {"di_plus": "di_plus", "di_minus": "di_minus", "adx": "adx"}, ADX, joins=["y", "z"])
_hi = f"list(high) OVER {frame(25)}"
_lo = f"list(low) OVER {frame(25)}"
AROON = [step("l", {"lh": _hi, "ll": _lo}),
         "a AS (SELECT pair, timeframe, ts, CASE WHEN len(lh) = 25 THEN list_position(lh, list_max(lh)) / 25.0 * 100 END AS up,"
         " CASE WHEN len(ll) = 25 THEN list_position(ll, list_min(ll)) / 25.0 * 100 END AS down FROM l)"]
closed("tr3_aroon", {"aroon_up": "up::DOUBLE", "aroon_down": "down::DOUBLE", "aroon_osc": "(up - down)::DOUBLE"}, AROON, "a")


def mid(n):
    return f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"


closed("tr4_ichimoku", {"ichimoku_conversion": "c", "ichimoku_base": "b",
                        "ichimoku_a": f"({prev('c', 26)} + {prev('b', 26)}) / 2", "ichimoku_b": prev("d", 26),
                        "ichimoku_lagging": prev("close", 26)},
       [f"i AS (SELECT *, (({roll('max', 'high', 9)}) + ({roll('min', 'low', 9)})) / 2 AS c,"
        f" (({roll('max', 'high', 26)}) + ({roll('min', 'low', 26)})) / 2 AS b,"
        f" (({roll('max', 'high', 52)}) + ({roll('min', 'low', 52)})) / 2 AS d FROM bars)"], "i")
PSAR = """w AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn FROM bars),
  p AS (SELECT pair, timeframe, ts, rn, close AS sar, true AS up, 0.02::DOUBLE AS acc, high AS ext, low AS l1, NULL::DOUBLE AS l2, high AS h1, NULL::DOUBLE AS h2 FROM w WHERE rn = 1
    UNION ALL SELECT n.pair, n.timeframe, n.ts, n.rn, CASE WHEN u2 THEN least(s2, p.l1, p.l2) ELSE greatest(s2, p.h1, p.h2) END, u2,
      CASE WHEN rev THEN 0.02::DOUBLE WHEN e2 <> p.ext THEN least(p.acc + 0.02::DOUBLE, 0.2::DOUBLE) ELSE p.acc END, e2, n.low, p.l1, n.high, p.h1
    FROM p JOIN w n ON n.pair = p.pair AND n.timeframe = p.timeframe AND n.rn = p.rn + 1,
      LATERAL (SELECT p.sar + p.acc * (p.ext - p.sar) AS s1) a, LATERAL (SELECT CASE WHEN p.up THEN n.low < s1 ELSE n.high > s1 END AS rev) b,
      LATERAL (SELECT CASE WHEN rev THEN p.ext ELSE s1 END AS s2, CASE WHEN rev THEN NOT p.up ELSE p.up END AS u2,
        CASE WHEN rev THEN CASE WHEN p.up THEN n.low ELSE n.high END WHEN p.up THEN greatest(p.ext, n.high) ELSE least(p.ext, n.low) END AS e2) c)"""
feature_query("tr5_psar", ["psar"], f"WITH RECURSIVE {B}, {PSAR} SELECT pair, timeframe, ts, round(sar, 6) AS psar FROM p")
TRIX = [ewm_cte("e1", "bars", "close", [ema_spec("a1", 15)]), ewm_cte("e2", "e1", "a1", [ema_spec("a2", 15)]),
        ewm_cte("e3", "e2", "a2", [ema_spec("a3", 15)]),
        "t AS (SELECT bars.*, a3 FROM bars LEFT JOIN e3 USING (pair, timeframe, ts))", step("u", {"trix": f"{roc('a3', 1)} * 100"}, "t")]
closed("tr6_trix", {"trix": "trix", "trix_signal": roll("avg", "trix", 9)}, TRIX, "u")
MASS = [step("r", {"hl": "high - low"}), ewm_cte("e1", "r", "hl", [ema_spec("a1", 9)]), ewm_cte("e2", "e1", "a1", [ema_spec("a2", 9)]),
        "m AS (SELECT bars.*, a1 / nullif(a2, 0) AS ratio FROM bars LEFT JOIN e1 USING (pair, timeframe, ts) LEFT JOIN e2 USING (pair, timeframe, ts))"]
closed("tr7_mass_index", {"mass_index": roll("sum", "ratio", 25)}, MASS, "m")
closed("tr8_dpo", {"dpo": f"{prev('close', 11)} - ({roll('avg', 'close', 20)})"})
KST = [step("k", {f"r{k}": f"{roc('close', k)} * 100" for k in (10, 15, 20, 30)}),
       f"q AS (SELECT *, ({roll('avg', 'r10', 10)}) + ({roll('avg', 'r15', 10)}) * 2 + ({roll('avg', 'r20', 10)}) * 3"
       f" + ({roll('avg', 'r30', 15)}) * 4 AS kst FROM k)"]
closed("tr9_kst", {"kst": "kst", "kst_signal": roll("avg", "kst", 9)}, KST, "q")
VORTEX = [step("v", {"tr": TR, "vp": f"abs(high - {prev('low')})", "vm": f"abs(low - {prev('high')})"}),
          f"q AS (SELECT *, ({roll('sum', 'vp', 14)}) / {nz(roll('sum', 'tr', 14))} AS a, ({roll('sum', 'vm', 14)}) / {nz(roll('sum', 'tr', 14))} AS b FROM v)"]
closed("tr10_vortex", {"vortex_pos": "a", "vortex_neg": "b", "vortex_diff": "a - b"}, VORTEX, "q")
ET = ewm_cte("e", "bars", "close", [ema_spec("e9", 9), ema_spec("e50", 50), ema_spec("e200", 200)])
feature_query("tr11_trend_flags", ["trend_short", "trend_medium", "trend_long"],
              f"WITH {B}, {ET} SELECT pair, timeframe, ts, CASE WHEN close > e9 THEN 1 ELSE -1 END AS trend_short,"
              " CASE WHEN close > e50 THEN 1 ELSE -1 END AS trend_medium, CASE WHEN close > e200 THEN 1 ELSE -1 END AS trend_long"
              " FROM bars LEFT JOIN e USING (pair, timeframe, ts)")

# ---- oscillators ----
GL = [step("g", {"d": f"close - {prev('close')}"}),
      "g2 AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss FROM g)",
      ewm_cte("ga", "g2", "gain", [rma_spec("g14", 14), rma_spec("g30", 30)]),
      ewm_cte("lo", "g2", "loss", [rma_spec("l14", 14), rma_spec("l30", 30)])]
RSI = [*GL, "rs AS (SELECT bars.*, 100 * g14 / nullif(g14 + l14, 0) AS rsi, 100 * g30 / nullif(g30 + l30, 0) AS rsi_30"
       " FROM bars LEFT JOIN ga USING (pair, timeframe, ts) LEFT JOIN lo USING (pair, timeframe, ts))"]
closed("os1_rsi", {"rsi": "rsi", "rsi_30": "rsi_30"}, RSI, "rs")
CONNORS = [
    *RSI, step("c0", {"dir": f"coalesce(sign(close - {prev('close')}), 0)", "roc": roc("close", 1)}, "rs"),
    step("c1", {"brk": f"CASE WHEN dir IS DISTINCT FROM {prev('dir')} THEN 1 ELSE 0 END"}, "c0"),
    step("c2", {"isl": f"sum(brk) OVER ({'PARTITION BY pair, timeframe ORDER BY ts'})"}, "c1"),
    step("c3", {"streak": "dir * row_number() OVER (PARTITION BY pair, timeframe, isl ORDER BY ts)"}, "c2"),
    step("c4", {"sd": f"coalesce(streak - {prev('streak')}, 0)"}, "c3"),
    step("c5", {"sg": "greatest(sd, 0)", "sl": "greatest(-sd, 0)", "w": f"list(roc) FILTER (roc IS NOT NULL) OVER {frame(100)}"}, "c4"),
    ewm_cte("cg", "c5", "sg", [("ag", 0.5, 1)]), ewm_cte("cl", "c5", "sl", [("al", 0.5, 1)]),
    "c6 AS (SELECT c5.*, ag, al, CASE WHEN roc IS NOT NULL THEN (len(list_filter(w, lambda x: x < roc)) + (len(list_filter(w, lambda x: x = roc)) + 1) / 2.0)"
    " / len(w) * 100 END AS rk FROM c5 JOIN cg USING (pair, timeframe, ts) JOIN cl USING (pair, timeframe, ts))",
]
closed("os2_connors_rsi", {"connors_rsi": "(rsi + 100 * ag / nullif(ag + al, 0) + rk) / 3"}, CONNORS, "c6")
STOCH = [step("k0", {"hh": roll("max", "high", 14), "ll": roll("min", "low", 14)}),
         step("k1", {"k": "100 * (close - ll) / nullif(hh - ll, 0)"}, "k0")]
closed("os3_stochastic", {"stoch_k": "k", "stoch_d": roll("avg", "k", 3)}, STOCH, "k1")
SRSI = [*RSI, step("s1", {"s": f"(rsi - ({roll('min', 'rsi', 14)})) / nullif(({roll('max', 'rsi', 14)}) - ({roll('min', 'rsi', 14)}), 0)"}, "rs"),
        step("s2", {"k": f"({roll('avg', 's', 3)}) * 100"}, "s1")]
closed("os4_stoch_rsi", {"stoch_rsi": "s", "stoch_rsi_k": "k", "stoch_rsi_d": roll("avg", "k", 3)}, SRSI, "s2")
SMI = [STOCH[0], "k2 AS (SELECT *, hh - ll AS df, close - (hh + ll) / 2 AS rd FROM k0)",
       ewm_cte("r1", "k2", "rd", [ema_spec("x1", 3)]), ewm_cte("r2", "r1", "x1", [ema_spec("x2", 3)]),
       ewm_cte("d1", "k2", "df", [ema_spec("y1", 3)]), ewm_cte("d2", "d1", "y1", [ema_spec("y2", 3)]),
       "sm AS (SELECT pair, timeframe, ts, CASE WHEN y2 <> 0 THEN x2 / (y2 / 2) * 100 WHEN y2 = 0 THEN 0 END AS smi FROM r2 JOIN d2 USING (pair, timeframe, ts))",
       ewm_cte("sg", "sm", "smi", [ema_spec("s3", 3), ema_spec("s5", 5)])]
closed("os5_smi", {"smi": "smi", "smi_signal": "s3", "smi_ergodic": "smi", "smi_ergodic_signal": "s5"}, SMI, joins=["sm", "sg"])
closed("os6_williams_r", {"williams_r": "-100 * (hh - close) / nullif(hh - ll, 0)"}, STOCH[:1], "k0")
closed("os7_roc", {"roc": f"{roc('close', 10)} * 100", "roc_20": f"{roc('close', 20)} * 100"})
closed("os8_ao", {"ao": f"({roll('avg', '(high + low) / 2', 5)}) - ({roll('avg', '(high + low) / 2', 34)})"})
PPO = [E1226, "m AS (SELECT *, (e12 - e26) / nullif(e26, 0) * 100 AS ppo FROM e)", ewm_cte("s", "m", "ppo", [ema_spec("sig", 9)])]
closed("os9_ppo", {"ppo": "ppo", "ppo_signal": "sig", "ppo_hist": "ppo - sig",
                   "ppo_mean": f"coalesce({roll('avg', 'ppo', 50, True)}, 0)"}, PPO, joins=["m", "s"])
ULT = [step("u", {"tr": TR, "bp": f"close - least(low, {prev('close')})"})]


def ratio(n):
    return f"({roll('sum', 'bp', n)}) / {nz(roll('sum', 'tr', n))}"


closed("os10_ultimate", {"ultimate_osc": f"100 * (4 * {ratio(7)} + 2 * {ratio(14)} + {ratio(28)}) / 7"}, ULT, "u")
TSI = [GL[0], "t0 AS (SELECT *, abs(d) AS ad FROM g)", ewm_cte("a1", "t0", "d", [ema_spec("x1", 25)]), ewm_cte("a2", "a1", "x1", [ema_spec("x2", 13)]),
       ewm_cte("b1", "t0", "ad", [ema_spec("y1", 25)]), ewm_cte("b2", "b1", "y1", [ema_spec("y2", 13)])]
closed("os11_tsi", {"tsi": "100 * (x2 / nullif(y2, 0))"}, TSI, joins=["a2", "b2"])
CCI = [step("c0", {"tp": TP}), step("c1", {"m": roll("avg", "tp", 20), "w": f"list(tp) OVER {frame(20)}"}, "c0"),
       "c2 AS (SELECT *, (tp - m) / nullif(0.015 * list_avg(list_transform(w, lambda x: abs(x - m))), 0) AS cci FROM c1)",
       ewm_cte("cs", "c2", "cci", [ema_spec("sig", 6)])]
closed("os12_cci", {"cci": "cci", "woodies_cci": "cci", "woodies_cci_signal": "sig"}, CCI, "c2", ["cs"])
closed("os13_momentum", {"momentum": f"close - {prev('close', 10)}", "momentum_pct": f"(close / {nz(prev('close', 10))} - 1) * 100"})
closed("os14_bop", {"bop": "(close - open) / nullif(high - low, 0)"})
closed("os15_bull_bear_power", {"bull_power": "high - e13", "bear_power": "low - e13"},
       [ewm_cte("e", "bars", "close", [ema_spec("e13", 13)])], joins=["e"])

# ---- volatility ----
BB = [step("b0", {"m": roll("avg", "close", 20), "s": roll("stddev_samp", "close", 20)}),
      step("b1", {"a50": roll("avg", "m", 50, True), "nxt": "first(m IGNORE NULLS) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}, "b0")]
BB[1] = BB[1].replace("first(m IGNORE NULLS)", "first_value(m IGNORE NULLS)")
_BB = ["bb_middle", "bb_upper", "bb_lower", "bb_width", "bb_pct", "bb_bandwidth", "bb_mean"]
# Short frames of the mean fall on exact half units of the last place; a fixed nudge settles them on both sides.
query("vo1_bollinger", sql_select([B, *BB], {"bb_middle": "m", "bb_upper": "m + 2 * s", "bb_lower": "m - 2 * s", "bb_width": "4 * s / nullif(m, 0)",
                         "bb_pct": "(close - (m - 2 * s)) / nullif(4 * s, 0)", "bb_bandwidth": "4 * s / nullif(m, 0)",
                         "bb_mean": "coalesce(a50, nxt, 0) + 1e-9"}, "b1"))(
    lambda spark, sf: rounded(compute(bars(spark, sf), _BB).select(*KEYS, *_BB[:-1], (F.col("bb_mean") + 1e-9).alias("bb_mean"))))
ATR = [step("d", {"tr": TR}), ewm_cte("ra", "d", "tr", [rma_spec("atr", 14)])]
ATRJ = [*ATR, "atj AS (SELECT d.*, atr FROM d LEFT JOIN ra USING (pair, timeframe, ts))"]
closed("vo2_atr", {"atr": "atr", "atr_ratio": "coalesce(atr / nullif(close, 0), 0)", "atr_mean": roll("avg", "atr", 100, True),
                   "atr_percent": "atr / nullif(close, 0) * 100"}, ATRJ, "atj")
closed("vo3_low_mean", {"low_mean": roll("avg", "low", 50, True)})
closed("vo4_keltner", {"kc_middle": "m", "kc_upper": "m + 2 * atr", "kc_lower": "m - 2 * atr", "kc_width": "4 * atr / nullif(m, 0)",
                       "kc_pct": "(close - (m - 2 * atr)) / nullif(4 * atr, 0)"},
       [*ATR, ewm_cte("e", "bars", "close", [ema_spec("m", 20)])], joins=["ra", "e"])
DC = [step("q", {"u": roll("max", "high", 20), "l": roll("min", "low", 20)})]
closed("vo5_donchian", {"dc_upper": "u", "dc_lower": "l", "dc_middle": "(u + l) / 2", "dc_width": "(u - l) / nullif((u + l) / 2, 0)",
                        "dc_pct": "(close - l) / nullif(u - l, 0)"}, DC, "q")
closed("vo6_ulcer", {"ulcer_index": f"sqrt({roll('avg', 'dd', 14, True)})"},
       [step("q0", {"mx": roll("max", "close", 14, True)}), step("q1", {"dd": "pow((close - mx) / nullif(mx, 0) * 100, 2)"}, "q0")], "q1")
closed("vo7_choppiness", {"choppiness": "100 * log10(sa / nullif(hh - ll, 0)) / log10(14)"},
       [*ATRJ, step("q", {"sa": roll("sum", "atr", 14), "hh": roll("max", "high", 14), "ll": roll("min", "low", 14)}, "atj")], "q")
closed("vo8_normalized_variance", {"normalized_variance": roll("stddev_samp", "p", 20)}, [step("q", {"p": roc("close", 1)})], "q")

# ---- volume ----
CUM = "OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING)"
OBV = [step("q", {"v": f"coalesce(sign(close - {prev('close')}), 0) * volume"}), step("q1", {"obv": f"sum(v) {CUM}"}, "q")]
closed("vl1_obv", {"obv": "obv", "obv_mean": roll("avg", "obv", 50, True), "obv_change": f"obv - {prev('obv')}"}, OBV, "q1")
CLV = [step("q", {"cv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"})]
closed("vl2_cmf", {"cmf": f"({roll('sum', 'cv', 20)}) / {nz(roll('sum', 'volume', 20))}"}, CLV, "q")
FI = [step("q", {"f": f"(close - {prev('close')}) * volume"}), ewm_cte("e", "q", "f", [ema_spec("fe", 13)])]
closed("vl3_force", {"force_index": "f", "force_index_ema": "fe"}, FI, "q", ["e"])
EOM = [step("q", {"mp": "(high + low) / 2"}), step("q1", {"eom": f"(mp - {prev('mp')}) / nullif((volume / 100000000) / nullif(high - low, 0), 0)"}, "q")]

# These reach 1e9 to 1e14 here, so they are compared in units that keep about 12 significant digits.
query("vl4_eom", sql_select([B, *EOM], {"eom": "eom / 1e6", "eom_sma": f"({roll('avg', 'eom', 14)}) / 1e6"}, "q1"))(
    lambda spark, sf: rounded(compute(bars(spark, sf), ["eom", "eom_sma"]).select(
        *KEYS, (F.col("eom") / 1e6).alias("eom"), (F.col("eom_sma") / 1e6).alias("eom_sma"))))
query("vl5_vpt", sql_select([B, step("q", {"x": f"coalesce({roc('close', 1)}, 0) * volume"})], {"vpt": f"sum(x) {CUM} / 1e3"}, "q"))(
    lambda spark, sf: rounded(compute(bars(spark, sf), ["vpt"]).select(*KEYS, (F.col("vpt") / 1e3).alias("vpt"))))
query("vl6_nvi", sql_select([B, step("q", {"g": f"CASE WHEN volume < {prev('volume')} THEN 1 + coalesce({roc('close', 1)}, 0) ELSE 1.0 END"})], {"nvi_ln": f"ln(1000 * product(g) {CUM})"}, "q"))(
    lambda spark, sf: rounded(compute(bars(spark, sf), ["nvi"]).select(*KEYS, F.ln("nvi").alias("nvi_ln"))))
closed("vl7_ad", {"ad": "ad", "chaikin_osc": "a3 - a10"},
       [*CLV, step("q1", {"ad": f"sum(cv) {CUM}"}, "q"), ewm_cte("e", "q1", "ad", [ema_spec("a3", 3), ema_spec("a10", 10)])], "q1", ["e"])
MFI = [step("q", {"tp": TP}), step("q1", {"up": f"CASE WHEN tp > {prev('tp')} THEN tp * volume ELSE 0 END",
                                          "dn": f"CASE WHEN tp < {prev('tp')} THEN tp * volume ELSE 0 END"}, "q")]
closed("vl8_mfi", {"mfi": f"100 * ({roll('sum', 'up', 14)}) / nullif(({roll('sum', 'up', 14)}) + ({roll('sum', 'dn', 14)}), 0)"}, MFI, "q1")
closed("vl9_vwap", {"vwap": f"(sum({TP} * volume) {CUM}) / nullif(sum(volume) {CUM}, 0)"})
feature_query("vl10_volume_ma5", ["volume_ma5", "volume_decreasing"],
              f"WITH {B}, {step('q', {'m': roll('avg', 'volume', 5)})} SELECT pair, timeframe, ts, round(m, 6) AS volume_ma5,"
              " CASE WHEN volume < m THEN 1 ELSE 0 END AS volume_decreasing FROM q")
feature_query("vl11_volume_stats", ["volume_roc", "volume_zscore", "volume_spike"],
              f"WITH {B}, {step('q', {'m': roll('avg', 'volume', 20), 's': roll('stddev_samp', 'volume', 20)})}"
              f" SELECT pair, timeframe, ts, round({roc('volume', 5)}, 6) AS volume_roc, round((volume - m) / nullif(s, 0), 6) AS volume_zscore,"
              " CASE WHEN volume > 2 * m THEN 1 ELSE 0 END AS volume_spike FROM q")

# ---- regime helpers ----
closed("rg1_return_gradient", {"return_gradient": roll("avg", "dp", 5)},
       [step("q", {"p": roc("close", 1)}), step("q1", {"dp": f"p - {prev('p')}"}, "q")], "q1")
closed("rg2_directional_persistence", {"directional_persistence": f"({roll('avg', 'u', 10)}) - 0.5"},
       [step("q", {"u": f"CASE WHEN {roc('close', 1)} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE"})], "q")
closed("rg3_gap_intensity", {"gap_intensity": f"abs(open - {prev('close')}) / {nz(prev('close'))}"})
closed("rg4_extended_bar_ratio", {"extended_bar_ratio": "(high - low) / nullif(atr, 0)"}, ATR, joins=["ra"])

# ---- candles ----
SHAPE = step("q", {"body": "abs(close - open)", "hl": "high - low", "up": "high - greatest(open, close)", "lo": "least(open, close) - low",
                   "bull": "close > open", "bear": "close < open"})


def b(k):
    return prev("bear", k)


def u(k):
    return prev("bull", k)


c1, c2, o1, o2 = prev("close"), prev("close", 2), prev("open"), prev("open", 2)
CANDLE_SQL = {
    "hammer": "lo > 2 * body AND up <= body", "inverted_hammer": "up > 2 * body AND lo <= body AND bull",
    "hanging_man": "lo > 2 * body AND up <= body AND bear", "shooting_star": "up > 2 * body AND lo <= body",
    "doji": "body <= 0.1::DOUBLE * hl",
    "long_legged_doji": "body <= 0.1::DOUBLE * hl AND up >= 0.4::DOUBLE * hl AND lo >= 0.4::DOUBLE * hl",
    "dragonfly_doji": "body <= 0.1::DOUBLE * hl AND lo >= 0.6::DOUBLE * hl AND up <= 0.1::DOUBLE * hl",
    "gravestone_doji": "body <= 0.1::DOUBLE * hl AND up >= 0.6::DOUBLE * hl AND lo <= 0.1::DOUBLE * hl",
    "marubozu_bull": "bull AND up <= 0.05::DOUBLE * hl AND lo <= 0.05::DOUBLE * hl",
    "marubozu_bear": "bear AND up <= 0.05::DOUBLE * hl AND lo <= 0.05::DOUBLE * hl",
    "bullish_engulfing": f"{b(1)} AND bull AND close >= {o1} AND open <= {c1}",
    "bearish_engulfing": f"{u(1)} AND bear AND open >= {c1} AND close <= {o1}",
    "morning_star": f"{b(2)} AND {prev('small')} AND bull AND close >= ({o2} + {c2}) / 2",
    "evening_star": f"{u(2)} AND {prev('small')} AND bear AND close <= ({o2} + {c2}) / 2",
    "three_white_soldiers": f"bull AND {u(1)} AND {u(2)} AND close > {c1} AND {c1} > {c2}",
    "three_black_crows": f"bear AND {b(1)} AND {b(2)} AND close < {c1} AND {c1} < {c2}",
}
SMALL = step("q2", {"small": "body <= 0.25 * hl"}, "q")
feature_query("cs1_16_candlesticks", [f"pattern_{c}" for c in CANDLES],
              sql_flags([B, SHAPE, SMALL], {f"pattern_{c}": CANDLE_SQL[c] for c in CANDLES}, "q2"))
feature_query("cs17_placeholders", [f"pattern_{p}" for p in PLACEHOLDERS],
              sql_flags([B], {f"pattern_{p}": "false" for p in PLACEHOLDERS}))
CANDLE_FLAGS = "fl AS (SELECT *, " + ", ".join(
    f"CASE WHEN {CANDLE_SQL[c]} THEN 1 ELSE 0 END AS {c}" for c in CANDLES) + " FROM q2)"
closed("rg5_recent_patterns", {
    "recent_bullish_patterns": f"({roll('sum', '(hammer + bullish_engulfing + morning_star + inverted_hammer)', 5)})::BIGINT",
    "recent_bearish_patterns": f"({roll('sum', '(shooting_star + bearish_engulfing + evening_star + hanging_man)', 5)})::BIGINT",
    "recent_doji": f"({roll('sum', '(doji + dragonfly_doji + gravestone_doji + long_legged_doji)', 5)})::BIGINT"}, [SHAPE, SMALL, CANDLE_FLAGS], "fl")
closed("rg6_local_slope", {"local_slope": roll("avg", "s", 3, True)},
       ["r AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn FROM bars)",
        step("q", {"s": f"CASE WHEN count(*) OVER {frame(5)} > 1 THEN regr_slope(close, rn) OVER {frame(5)} ELSE 0 END"}, "r")], "q")

# ---- swings ----


def pivot_sql(side: str) -> str:
    op = ">" if side == "high" else "<"
    mid_ = prev(side, 2)
    others = [side, prev(side, 1), prev(side, 3), prev(side, 4)]
    return " AND ".join(f"{mid_} {op} {o}" for o in others)


SW = step("s0", {f"swing_{s}": f"CASE WHEN {pivot_sql(s)} THEN 1 ELSE 0 END" for s in ("high", "low")}
          | {"rn": "row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts)"})


def lastv(cond: str, x: str) -> str:
    return f"last_value(CASE WHEN {cond} THEN {x} END IGNORE NULLS) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS UNBOUNDED PRECEDING)"


SW1 = step("s1", {"lh": lastv("swing_high = 1", "high"), "ll": lastv("swing_low = 1", "low"),
                  "rh": lastv("swing_high = 1", "rn"), "rl": lastv("swing_low = 1", "rn")}, "s0")
SW2 = step("s2", {"pfh": "(close - lh) / nullif(lh, 0) * 100", "pfl": "(close - ll) / nullif(ll, 0) * 100", "rng": "lh - ll"}, "s1")
SWALL = [B, SW, SW1, SW2]
feature_query("sw1_swings", ["swing_high", "swing_low"], f"WITH {B}, {SW} SELECT pair, timeframe, ts, swing_high, swing_low FROM s0")
query("sw2_pivot_lookback", f"WITH {bars_cte('15m', 'a')}, {bars_cte('1h', 'b')}, {bars_cte('4h', 'c')},"
      " t AS (SELECT timeframe FROM a UNION ALL SELECT timeframe FROM b UNION ALL SELECT timeframe FROM c)"
      " SELECT timeframe, CASE timeframe WHEN '15m' THEN 2 WHEN '1h' THEN 3 WHEN '4h' THEN 3 ELSE 2 END AS lookback, count(*) AS bars FROM t GROUP BY 1")(
    lambda spark, sf: bars(spark, sf, "15m", "1h", "4h").groupBy("timeframe").agg(F.count(F.lit(1)).alias("bars")).withColumn(
        "lookback", F.coalesce(F.create_map(*[F.lit(x) for kv in LOOKBACK_BY_TIMEFRAME.items() for x in kv])[F.col("timeframe")], F.lit(2))))
feature_query("sw3_last_swings", ["last_swing_high", "last_swing_low"],
              sql_select(SWALL, {"last_swing_high": "lh", "last_swing_low": "ll"}, "s2"))
feature_query("sw4_pullback_pct", ["pullback_from_high_pct", "pullback_from_low_pct"],
              sql_select(SWALL, {"pullback_from_high_pct": "pfh", "pullback_from_low_pct": "pfl"}, "s2"))
FIBSQL = {s: f"(lh - rng * {r}::DOUBLE)" for s, r in FIB.items()}
feature_query("sw5_fibonacci", [f"fib_{s}" for s in FIB] + [f"near_fib_{s.replace('_', '')}" for s in FIB],
              f"WITH {', '.join(SWALL)} SELECT pair, timeframe, ts, "
              + ", ".join(f"round({e}, 6) AS fib_{s}" for s, e in FIBSQL.items()) + ", "
              + ", ".join(f"CASE WHEN abs(close - {e}) / nullif(close, 0) < 0.005::DOUBLE THEN 1 ELSE 0 END AS near_fib_{s.replace('_', '')}" for s, e in FIBSQL.items())
              + " FROM s2")
feature_query("sw6_pullback_depth", ["pullback_depth"],
              f"WITH {', '.join(SWALL)} SELECT pair, timeframe, ts, CASE WHEN pfh < -10 THEN 'deep' WHEN pfh BETWEEN -10 AND -5 THEN 'moderate'"
              " WHEN pfh BETWEEN -5 AND -1 THEN 'shallow' ELSE 'none' END AS pullback_depth FROM s2")
THREE = [*SWALL, ET,
         "t0 AS (SELECT s2.*, CASE WHEN close > e9 THEN 1 ELSE -1 END AS tshort, CASE WHEN close > e50 THEN 1 ELSE -1 END AS tmed,"
         " CASE WHEN close > e200 THEN 1 ELSE -1 END AS tlong, e9 FROM s2 LEFT JOIN e USING (pair, timeframe, ts))",
         step("t1", {"l3": f"list(low) FILTER (swing_low = 1) OVER {frame(51)}", "h3": f"list(high) FILTER (swing_high = 1) OVER {frame(51)}"}, "t0")]
feature_query("sw7_higher_lows", ["higher_lows_pattern", "lower_highs_pattern"], sql_flags(THREE, {
    "higher_lows_pattern": "rn > 20 AND len(l3) >= 3 AND l3[-2] > l3[-3] AND l3[-1] > l3[-2] AND tmed = 1",
    "lower_highs_pattern": "rn > 20 AND len(h3) >= 3 AND h3[-2] < h3[-3] AND h3[-1] < h3[-2] AND tmed = -1"}, "t1"))
EM = ewm_cte("em", "bars", "close", [ema_spec("m9", 9), ema_spec("m26", 26)])
MAS = ["ma AS (SELECT bars.*, m9, m26, " + roll("avg", "close", 50) + " AS s50 FROM bars LEFT JOIN em USING (pair, timeframe, ts))"]
feature_query("sw8_pullback_to_ma", ["pullback_to_ema9", "pullback_to_ema20", "pullback_to_sma50"], sql_flags([B, EM, *MAS], {
    "pullback_to_ema9": "abs(close - m9) / nullif(m9, 0) < 0.01::DOUBLE", "pullback_to_ema20": "abs(close - m26) / nullif(m26, 0) < 0.01::DOUBLE",
    "pullback_to_sma50": "abs(close - s50) / nullif(s50, 0) < 0.01::DOUBLE"}, "ma"))
CTX = [*THREE, EM, *[x for x in RSI], *MAS,
       "u0 AS (SELECT t1.*, rs.rsi, ma.m9, ma.m26, ma.s50, " + roll("avg", "t1.volume", 5).replace("PARTITION BY pair, timeframe ORDER BY ts", "PARTITION BY t1.pair, t1.timeframe ORDER BY t1.ts")
       + " AS v5 FROM t1 JOIN rs USING (pair, timeframe, ts) JOIN ma USING (pair, timeframe, ts))",
       step("u1", {"mid": "coalesce(rsi > 40 AND rsi < 60, false)", "vd": "CASE WHEN volume < v5 THEN 1 ELSE 0 END",
                   "pc": prev("close"), "pc10": prev("close", 10),
                   "age_h": "CASE WHEN rh IS NULL THEN rn - 1 + 9999 ELSE rn - rh END", "age_l": "CASE WHEN rl IS NULL THEN rn - 1 + 9999 ELSE rn - rl END",
                   **{f"f{s}": f"CASE WHEN abs(close - {e}) / nullif(close, 0) < 0.005::DOUBLE THEN 1 ELSE 0 END" for s, e in FIBSQL.items()}}, "u0"),
       step("u2", {"q": "CASE WHEN tshort = tmed AND tmed = tlong THEN 30 ELSE 0 END + CASE WHEN pfh BETWEEN -12 AND -3 THEN 30 ELSE 0 END + vd * 20 + CASE WHEN mid THEN 20 ELSE 0 END",
                   "sr": " + ".join(f"CASE WHEN abs(close - {x}) / nullif(close, 0) < 0.01::DOUBLE THEN 1 ELSE 0 END" for x in ("m9", "m26", "s50", "ll"))
                   + " + f38_2 + f50_0 + f61_8"}, "u1"),
       step("u3", {"pcb": "CASE WHEN tmed = 1 AND q >= 50 AND rsi < 50 AND sr >= 2 AND vd = 1 AND close > open THEN 1 ELSE 0 END",
                   "pcs": "CASE WHEN tmed = -1 AND q >= 50 AND rsi > 50 AND sr >= 2 AND vd = 1 AND close < open THEN 1 ELSE 0 END"}, "u2")]


def ctx(name: str, cols: dict[str, str]):
    feature_query(name, list(cols), f"WITH {', '.join(CTX)} SELECT pair, timeframe, ts, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + " FROM u3")


def fl(e):
    return f"CASE WHEN {e} THEN 1 ELSE 0 END"


ctx("sw9_healthy_pullback", {"healthy_bull_pullback": fl("tmed = 1 AND mid AND close < pc"), "healthy_bear_pullback": fl("tmed = -1 AND mid AND close > pc")})
ctx("sw10_bars_since_swing", {"bars_since_swing_high": "age_h", "bars_since_swing_low": "age_l"})
ABC = [step("l0", {"lo": f"list(low) OVER {frame(21)}", "hi": f"list(high) OVER {frame(21)}"}),
       "l1 AS (SELECT *, list_position(lo, list_min(lo)) AS pa, list_position(hi, list_max(hi)) AS qa FROM l0)",
       "l2 AS (SELECT *, list_position(hi[pa:], list_max(hi[pa:])) AS pb, list_position(lo[qa:], list_min(lo[qa:])) AS qb FROM l1)"]
feature_query("sw11_abc_pullback", ["abc_pullback_bull", "abc_pullback_bear"], sql_flags([B, *ABC], {
    "abc_pullback_bull": "len(lo) = 21 AND pa - 1 < 16 AND pb - 1 < (22 - pa) - 2 AND list_min(lo[pa + pb - 1:]) > list_min(lo) * 1.005::DOUBLE",
    "abc_pullback_bear": "len(lo) = 21 AND qa - 1 < 16 AND qb - 1 < (22 - qa) - 2 AND list_max(hi[qa + qb - 1:]) < list_max(hi) * 0.995::DOUBLE"}, "l2"))
ctx("sw12_pullback_quality", {"pullback_quality_score": "q"})
ctx("sw13_sr_confluence", {"sr_confluence_score": "sr"})
ctx("sw14_pullback_complete", {"pullback_complete_bull": "pcb", "pullback_complete_bear": "pcs"})
ctx("sw15_failed_pullback", {"failed_pullback_bull": fl("tmed = 1 AND close < ll AND volume > v5"), "failed_pullback_bear": fl("tmed = -1 AND close > lh AND volume > v5")})
feature_query("sw16_measured_move", ["measured_move_bull_target", "measured_move_bear_target", "distance_to_bull_target_pct", "distance_to_bear_target_pct"],
              sql_select(SWALL, {"measured_move_bull_target": "lh + rng", "measured_move_bear_target": "ll - rng",
                                 "distance_to_bull_target_pct": "(lh + rng - close) / nullif(close, 0) * 100",
                                 "distance_to_bear_target_pct": "(close - (ll - rng)) / nullif(close, 0) * 100"}, "s2"))
ctx("sw17_pullback_stage", {"pullback_stage": "CASE WHEN rn <= 10 THEN 'neutral' WHEN pcb = 1 THEN 'resumption_bull' WHEN pcs = 1 THEN 'resumption_bear'"
    " WHEN tmed = 1 AND close < pc AND age_h <= 3 THEN 'pullback_early' WHEN tmed = 1 AND close < pc AND age_h <= 7 AND abs(pfh) < 8 THEN 'pullback_mid'"
    " WHEN tmed = 1 AND close < pc AND abs(pfh) >= 5 THEN 'pullback_late' WHEN tmed = 1 AND close > pc10 * 1.03::DOUBLE THEN 'impulse_up'"
    " WHEN tmed = -1 AND close < pc10 * 0.97::DOUBLE THEN 'impulse_down' ELSE 'neutral' END"})
