"""Timeframe alignment and strategy discovery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import bars, bars_cte, prev, query, roll, rounded
from barloom.catalog.indicators import step
from barloom.plans import discovery as D
from barloom.plans.mtf import align, contexts, mtf_table, valid_group

TF = ("4h", "1h", "15m")
SIG = ("sma_20", "roc", "bop")
# These walks have no drift to find, so the accuracy floor (a parameter) is set where results remain.
MIN_WIN = 0.3
ALL = ", ".join([bars_cte("15m", "b15"), bars_cte("1h", "b60"), bars_cte("4h", "b240")])


def st(src: str, out: str, label: bool = False) -> str:
    lab = f", CASE WHEN lead(close, 5) OVER (PARTITION BY pair, timeframe ORDER BY ts) IS NULL THEN NULL ELSE (lead(close, 5) OVER (PARTITION BY pair, timeframe ORDER BY ts) / nullif(close, 0) - 1) * 100 END AS ret" if label else ""
    return f"""{out}0 AS (SELECT *, {roll('avg', 'close', 20)} AS m, (close - {prev('close', 10)}) / nullif({prev('close', 10)}, 0) AS r,
      (close - open) / nullif(high - low, 0) AS bp{lab} FROM {src}),
  {out} AS (SELECT pair, timeframe, ts, {'ret, ' if label else ''}CASE WHEN close > m THEN 1 WHEN close < m THEN -1 ELSE 0 END AS sma_20,
      CASE WHEN r > 0 THEN 1 WHEN r < 0 THEN -1 ELSE 0 END AS roc, CASE WHEN bp > 0 THEN 1 WHEN bp < 0 THEN -1 ELSE 0 END AS bop FROM {out}0)"""


MTF = f"""{ALL}, {st('b15', 's15', True)}, {st('b60', 's60')}, {st('b240', 's240')},
  a1 AS (SELECT l.pair, l.ts, l.ret, l.sma_20 AS l_sma_20, l.roc AS l_roc, l.bop AS l_bop, t.sma_20 AS t_sma_20, t.roc AS t_roc, t.bop AS t_bop
    FROM s15 l ASOF LEFT JOIN s60 t ON l.pair = t.pair AND l.ts >= t.ts + INTERVAL 45 MINUTE),
  al AS (SELECT a1.*, h.sma_20 AS h_sma_20, h.roc AS h_roc, h.bop AS h_bop
    FROM a1 ASOF LEFT JOIN s240 h ON a1.pair = h.pair AND a1.ts >= h.ts + INTERVAL 225 MINUTE)"""


def aligned(spark, sf, signals=SIG, extra=()):
    return mtf_table(bars(spark, sf, *TF), TF, list(signals), list(extra))


@query("jn1_asof_close", f"WITH {ALL} SELECT l.pair, l.timeframe, l.ts, round(l.close, 6) AS close, round(h.close, 6) AS h_close, h.ts AS h_ts"
       " FROM b15 l ASOF LEFT JOIN b240 h ON l.pair = h.pair AND l.ts >= h.ts + INTERVAL 225 MINUTE")
def _asof(spark, sf):
    b = bars(spark, sf, "15m", "4h")
    low = b.where("timeframe = '15m'").select("pair", "timeframe", "ts", "close")
    return rounded(align(low, b.where("timeframe = '4h'").select("pair", "timeframe", "ts", "close"), "4h", "15m", "h_"))


@query("jn1_asof_open", f"WITH {ALL} SELECT l.pair, l.timeframe, l.ts, round(l.close, 6) AS close, round(h.close, 6) AS h_close, h.ts AS h_ts"
       " FROM b15 l ASOF LEFT JOIN b60 h ON l.pair = h.pair AND l.ts >= h.ts")
def _asof_open(spark, sf):
    b = bars(spark, sf, "15m", "1h")
    low = b.where("timeframe = '15m'").select("pair", "timeframe", "ts", "close")
    return rounded(align(low, b.where("timeframe = '1h'").select("pair", "timeframe", "ts", "close"), "1h", "15m", "h_", at="open"))


query("jn1_mtf_states", f"WITH {MTF} SELECT pair, ts, round(ret, 6) AS future_return, " + ", ".join(
    f"{p}_{s} AS {p}_state_{s}" for p in "htl" for s in SIG) + " FROM al")(
    lambda spark, sf: rounded(aligned(spark, sf).select("pair", "ts", "future_return", *[f"{p}_state_{s}" for p in "htl" for s in SIG])))
query("prj10_timeframe_groups")(lambda spark, sf: bars(spark, sf, *TF).groupBy("pair").agg(
    F.collect_set("timeframe").alias("t")).select("pair", F.lit(valid_group(*TF)).alias("valid"), F.size("t").alias("timeframes")))
query("pai_direction_confirmation", f"WITH {ALL}, " + ", ".join(f"d{n} AS (SELECT *, sign(close - {prev('close')}) AS d FROM b{n})" for n in (15, 60, 240)) +
      """, x AS (SELECT l.pair, l.ts, l.d AS ld, t.d AS td FROM d15 l ASOF LEFT JOIN d60 t ON l.pair = t.pair AND l.ts >= t.ts + INTERVAL 45 MINUTE),
      y AS (SELECT x.*, h.d AS hd FROM x ASOF LEFT JOIN d240 h ON x.pair = h.pair AND x.ts >= h.ts + INTERVAL 225 MINUTE)
      SELECT pair, ts, CASE WHEN hd = td THEN 1 ELSE 0 END AS htf_ttf, CASE WHEN td = ld THEN 1 ELSE 0 END AS ttf_ltf FROM y""")(
    lambda spark, sf: _direction(spark, sf))


def _direction(spark, sf):
    from barloom.functions.registry import compute

    df = compute(bars(spark, sf, *TF), ["_delta"]).select("pair", "timeframe", "ts", F.signum("_delta").alias("d"))
    out = df.where("timeframe = '15m'").withColumnRenamed("d", "ld")
    for tf, p in (("1h", "t"), ("4h", "h")):
        out = align(out, df.where(F.col("timeframe") == tf), tf, "15m", p)
    one = lambda c: F.when(c, 1).otherwise(0)
    return out.select("pair", "ts", one(F.col("hd") == F.col("td")).alias("htf_ttf"), one(F.col("td") == F.col("ld")).alias("ttf_ltf"))


# ---- discovery ----
LONG = f"""WITH {ALL}, {st('b60', 's', True)},
  u AS (SELECT pair, timeframe, 'sma_20' AS signal, sma_20 AS code, ret FROM s UNION ALL SELECT pair, timeframe, 'roc', roc, ret FROM s
    UNION ALL SELECT pair, timeframe, 'bop', bop, ret FROM s)"""
query("dsc1_single_signals", LONG + """, g AS (SELECT pair, timeframe, signal, CASE code WHEN 1 THEN 'bullish' ELSE 'bearish' END AS direction, count(*) AS sample_size,
   sum(CASE WHEN (code = 1 AND ret > 0.005) OR (code = -1 AND ret < -0.005) THEN 1 ELSE 0 END) / count(*)::DOUBLE AS acc FROM u WHERE code <> 0 GROUP BY ALL)
  SELECT pair, timeframe, signal, direction, round(acc, 6) AS discovered_accuracy, sample_size FROM g WHERE sample_size > 20 AND acc > 0.3""")(
    lambda spark, sf: rounded(D.single_signals(bars(spark, sf), SIG, min_win=MIN_WIN)))
query("dsc2_combinations", f"WITH {ALL}, {st('b60', 's', True)}" + """,
  a AS (SELECT pair, timeframe, 'bullish' AS direction, ret > 0 AS hit, list_filter([CASE WHEN sma_20 = 1 THEN 'sma_20' END, CASE WHEN roc = 1 THEN 'roc' END, CASE WHEN bop = 1 THEN 'bop' END], lambda x: x IS NOT NULL) AS act FROM s
   UNION ALL SELECT pair, timeframe, 'bearish', ret < 0, list_filter([CASE WHEN sma_20 = -1 THEN 'sma_20' END, CASE WHEN roc = -1 THEN 'roc' END, CASE WHEN bop = -1 THEN 'bop' END], lambda x: x IS NOT NULL) FROM s),
  g AS (SELECT pair, timeframe, direction, array_to_string(list_sort(act), '+') AS combo, count(*) AS n, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS acc, len(first(act)) AS k FROM a WHERE len(act) >= 2 GROUP BY ALL)
  SELECT pair, timeframe, direction, combo, n AS sample_size, round(acc, 6) AS discovered_accuracy, round(acc * (1 + k * 0.05), 6) AS performance_score
  FROM g WHERE n >= 10 AND acc > 0.5""".replace("act AS", "act AS"))(
    lambda spark, sf: rounded(D.combinations(bars(spark, sf), SIG, least=2, min_win=0.5)))
TRI = "h3 AS (SELECT a.pair, a.ret, u.* FROM al a, LATERAL (VALUES " + ", ".join(
    f"('{h}', '{t}', '{low}', h_{h}, t_{t}, l_{low})" for h in SIG for t in SIG for low in SIG) + ") u(hs, ts_, ls, h, t, l))"
TRI_TAIL = "SELECT pair, hs AS htf_signal, ts_ AS ttf_signal, ls AS ltf_signal, direction"
query("dsc3_mode_a", f"WITH {MTF}, {TRI}, g AS (SELECT pair, hs, ts_, ls, CASE WHEN h = 1 THEN 'bullish' ELSE 'bearish' END AS direction, count(*) AS n,"
      " avg(CASE WHEN h * ret > 0 THEN 1.0 ELSE 0.0 END) AS acc FROM h3 WHERE h <> 0 AND h = t AND t = l GROUP BY ALL) "
      f"{TRI_TAIL}, n AS sample_size, round(acc, 6) AS discovered_accuracy, round(acc, 6) AS performance_score FROM g WHERE n > 10 AND acc > 0.3")(
    lambda spark, sf: rounded(D.triples(aligned(spark, sf), SIG, "a", MIN_WIN)))
query("dsc4_mode_b", f"WITH {MTF}, {TRI}, v AS (SELECT pair, hs, ts_, ls, ret, 'HTF+TTF' AS confluence, h AS d FROM h3 WHERE h = t AND h <> 0"
      " UNION ALL SELECT pair, hs, ts_, ls, ret, 'HTF+LTF', h FROM h3 WHERE h = l AND h <> 0 UNION ALL SELECT pair, hs, ts_, ls, ret, 'TTF+LTF', t FROM h3 WHERE t = l AND t <> 0),"
      " g AS (SELECT pair, hs, ts_, ls, confluence, CASE WHEN d = 1 THEN 'bullish' ELSE 'bearish' END AS direction, count(*) AS n, avg(CASE WHEN d * ret > 0 THEN 1.0 ELSE 0.0 END) AS acc FROM v GROUP BY ALL) "
      f"{TRI_TAIL}, confluence, n AS sample_size, round(acc, 6) AS discovered_accuracy, round(acc * 0.9, 6) AS performance_score FROM g"
      " WHERE n > CASE WHEN direction = 'bullish' THEN 10 ELSE 25 END AND acc > 0.3")(
    lambda spark, sf: rounded(D.triples(aligned(spark, sf), SIG, "b", MIN_WIN)))
query("dsc5_mode_c", f"WITH {MTF}, {TRI}, v AS (SELECT *, coalesce(h, 0) * 5 + coalesce(t, 0) * 3 + l * 2 AS sc FROM h3), g AS (SELECT pair, hs, ts_, ls, th AS threshold, CASE WHEN sc > 0 THEN 'bullish' ELSE 'bearish' END AS direction,"
      " count(*) AS n, avg(CASE WHEN sign(sc) * ret > 0 THEN 1.0 ELSE 0.0 END) AS acc FROM v, (VALUES (6), (7), (8)) w(th) WHERE abs(sc) >= th GROUP BY ALL) "
      f"{TRI_TAIL}, threshold, n AS sample_size, round(acc, 6) AS discovered_accuracy, round(acc * (1 + threshold / 10.0), 6) AS performance_score FROM g WHERE n > 12 AND acc > 0.3")(
    lambda spark, sf: rounded(D.triples(aligned(spark, sf), SIG, "c", MIN_WIN)))


def mode(name: str, key: str, fn, ctx: bool = False):
    @query(name)
    def run(spark, sf):
        s, r = D.signals_of(key)
        b = bars(spark, sf, *TF)
        a = mtf_table(b, TF, s, r)
        return rounded(fn(a, contexts(b, TF)) if ctx else fn(a))


mode("dsc6_mode_d", "d", lambda a: D.multi_signal(a, 0, 0.0))
mode("dsc7_mode_e", "e", lambda a: D.plain_setups(a, "e", (0, 0.0)))
mode("dsc8_mode_f", "f", lambda a: D.plain_setups(a, "f", (0, 0.0)))
mode("dsc9_mode_g", "g", lambda a: D.plain_setups(a, "g", (0, 0.0)))
query("dsc12_setup_template", f"WITH {MTF}, x AS (SELECT pair, ret, CASE WHEN h_sma_20 = 1 AND t_roc = 1 AND l_bop = 1 THEN 'my_bull' WHEN h_sma_20 = -1 AND t_roc = -1 AND l_bop = -1 THEN 'my_bear' END AS setup FROM al),"
      " g AS (SELECT pair, setup, CASE setup WHEN 'my_bull' THEN 'bullish' ELSE 'bearish' END AS direction, count(*) AS n,"
      " avg(CASE WHEN (setup = 'my_bull' AND ret > 0) OR (setup = 'my_bear' AND ret < 0) THEN 1.0 ELSE 0.0 END) AS acc FROM x WHERE setup IS NOT NULL GROUP BY ALL)"
      " SELECT pair, setup, direction, n AS sample_size, round(acc, 6) AS discovered_accuracy, round(acc * 1.2, 6) AS performance_score FROM g WHERE n >= 5 AND acc >= 0.3")(
    lambda spark, sf: rounded(D.custom_setups(aligned(spark, sf), {
        "my_bull": (("sma_20",), ("roc",), ("bop",)), "my_bear": (("sma_20",), ("roc",), ("bop",))}, 1.2, min_win=MIN_WIN)))
mode("dsc14_mode_k", "k", D.adaptive, True)
mode("dsc15_mode_l", "l", D.structure_aligned, True)
mode("dsc16_mode_m", "m", D.volatility_adaptive, True)
mode("dsc17_mode_n", "n", D.momentum_cascade, True)
query("dsc18_mode_combo")(lambda spark, sf: rounded(D.top_pairs(bars(spark, sf, *TF), TF, list(SIG) + ["rsi", "macd", "obv"], min_n=5, min_win=MIN_WIN)))
query("dsc20_filter_rank", LONG + """, g AS (SELECT pair, timeframe, signal, CASE code WHEN 1 THEN 'bullish' ELSE 'bearish' END AS direction, count(*) AS n,
   sum(CASE WHEN (code = 1 AND ret > 0.005) OR (code = -1 AND ret < -0.005) THEN 1 ELSE 0 END) / count(*)::DOUBLE AS acc FROM u WHERE code <> 0 GROUP BY ALL)
  SELECT pair, timeframe, signal, direction, round(acc, 6) AS discovered_accuracy, n AS sample_size, round(acc, 6) AS performance_score, round(acc * 100, 6) AS quality_score
  FROM g WHERE n > 20 AND acc >= 0.52""")(
    lambda spark, sf: rounded(D.filter_and_rank(D.single_signals(bars(spark, sf), SIG).withColumn("performance_score", F.col("discovered_accuracy")))))
query("dsc21_all_modes")(lambda spark, sf: rounded(D.all_modes(bars(spark, sf, *TF), {"Group_3": TF})))
query("dsc22_quality_score", f"WITH {ALL}, {st('b60', 's', True)}" + """, g AS (SELECT pair, timeframe, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS w, count(*) AS n,
   sum(CASE WHEN ret > 0 THEN ret END) AS gain, sum(CASE WHEN ret <= 0 THEN ret END) AS loss FROM s WHERE sma_20 = 1 GROUP BY ALL)
  SELECT pair, timeframe, n AS sample_size, round(CASE WHEN n < 10 THEN 0 ELSE least(40, (w - 0.5) * 200) + least(20, n / 100.0 * 20) + coalesce(least(20, (abs(gain / nullif(loss, 0)) - 1) * 10), 0) + 10 END, 6) AS quality_score FROM g""")(
    lambda spark, sf: _quality(spark, sf))


def _quality(spark, sf):
    from barloom.functions.states import state_table

    df = state_table(bars(spark, sf), ["sma_20"], extra=["future_return_5"]).where("state_sma_20 = 1")
    r = F.col("future_return_5")
    g = df.groupBy("pair", "timeframe").agg(F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("w"), F.count(F.lit(1)).alias("sample_size"),
                                            F.sum(F.when(r > 0, r)).alias("g"), F.sum(F.when(r <= 0, r)).alias("l"))
    q = D.quality_score(F.col("w"), F.col("sample_size"), F.col("g"), F.col("l"))
    return rounded(g.select("pair", "timeframe", "sample_size", q.alias("quality_score")))


query("mt8_10_contexts")(lambda spark, sf: rounded(contexts(bars(spark, sf, *TF), TF)))
SIDE = f"WITH {bars_cte('1h')}, {step('a', {'tr': 'greatest(high - low, abs(high - lag(close) OVER (PARTITION BY pair, timeframe ORDER BY ts)), abs(low - lag(close) OVER (PARTITION BY pair, timeframe ORDER BY ts)))'})}"
query("prj8_sideways", SIDE + f", b AS (SELECT *, ({roll('avg', 'tr', 14)}) / nullif(close, 0) * 100 AS p, (({roll('max', 'high', 20, True)}) - ({roll('min', 'low', 20, True)})) / nullif(close, 0) * 100 AS r FROM a)"
      " SELECT pair, timeframe, ts, round(p, 6) AS atr_percent_simple, coalesce(p < 0.5, false) OR coalesce(r < 1.0, false) AS sideways FROM b")(
    lambda spark, sf: _side(spark, sf))


def _side(spark, sf):
    from barloom.functions.registry import compute

    return rounded(compute(bars(spark, sf), ["atr_percent_simple", "sideways"]).select("pair", "timeframe", "ts", "atr_percent_simple", "sideways"))
