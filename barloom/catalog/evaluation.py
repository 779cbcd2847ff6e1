"""Backtest, risk and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.session import scratch

from barloom.catalog.base import KEYS, bars, bars_cte, load, query, roll, rounded
from barloom.catalog.discovery import MTF, aligned
from barloom.catalog.indicators import ATRJ, B, SWALL, step
from barloom.catalog.patterns import PIV
from barloom.functions.labels import known_returns
from barloom.functions.registry import compute
from barloom.functions.states import state_table
from barloom.plans import backtest as BT
from barloom.plans import portfolio as PF
from barloom.plans import reports as R
from barloom.plans import risk as RK

LEAD = "lead(close, {0}) OVER (PARTITION BY pair, timeframe ORDER BY ts)"
RET = "CASE WHEN " + LEAD + " IS NULL THEN NULL ELSE (" + LEAD + " / nullif(close, 0) - 1) * 100 END"
SIDE = "CASE WHEN close > m THEN 1 WHEN close < m THEN -1 ELSE 0 END"
ROWS = [step("r0", {"m": roll("avg", "close", 20), **{f"f{h}": RET.replace("{0}", str(h)) for h in (3, 5, 10)}}),
        step("r1", {"side": SIDE, "rn": "row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts)", "n": "count(*) OVER (PARTITION BY pair, timeframe)"}, "r0")]


def sided(spark, sf, extra=("future_return_5",)):
    return known_returns(state_table(bars(spark, sf), ["sma_20"], extra=list(extra))).withColumnRenamed("state_sma_20", "side")


AGG = ("count(*) AS signals, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END)::BIGINT AS wins, round(avg(r), 4) AS avg_return, round(coalesce(avg(CASE WHEN r > 0 THEN r END), 0), 4) AS avg_win,"
       " round(coalesce(avg(CASE WHEN r <= 0 THEN r END), 0), 6) AS avg_loss, round(abs(sum(CASE WHEN r > 0 THEN r END) / nullif(sum(CASE WHEN r <= 0 THEN r END), 0)), 6) AS profit_factor,"
       " round(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS win_rate")


def coarse(df):
    return df.withColumns({"avg_return": F.round("avg_return", 4), "avg_win": F.round("avg_win", 4)})


query("bt1_mask_backtest", f"WITH {MTF}, x AS (SELECT pair, ret, CASE WHEN h_sma_20 = t_sma_20 AND t_sma_20 = l_sma_20 THEN l_sma_20 ELSE 0 END AS side FROM al), y AS (SELECT *, ret * side AS r FROM x WHERE side <> 0) SELECT pair, {AGG} FROM y GROUP BY 1")(
    lambda spark, sf: coarse(rounded(BT.mask_backtest(aligned(spark, sf, ["sma_20"]).withColumn("side", F.when(
        (F.col("h_state_sma_20") == F.col("t_state_sma_20")) & (F.col("t_state_sma_20") == F.col("l_state_sma_20")), F.col("l_state_sma_20")).otherwise(0)), ["pair"]))))
query("bt2_3_trend_filtered")(lambda spark, sf: rounded(BT.mask_backtest(BT.with_trend_filter(
    aligned(spark, sf, ["sma_20"], ["trend_structure"]).withColumn("side", F.col("l_state_sma_20"))), ["pair"])))
query("bt4_regime_robustness", f"WITH {B}, {', '.join(ROWS)}, x AS (SELECT pair, timeframe, CASE WHEN volume > 250 THEN 'busy' WHEN volume > 100 THEN 'normal' ELSE 'quiet' END AS regime, f5 * side AS r FROM r1 WHERE side <> 0),"
      " g AS (SELECT pair, timeframe, regime, count(*) AS n, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS wr FROM x GROUP BY ALL HAVING count(*) > 10)"
      " SELECT pair, timeframe, count(*) AS regimes, round(avg(wr), 6) AS mean_win_rate, round(avg(wr) * (1 - stddev_pop(wr)), 6) AS robustness FROM g GROUP BY 1, 2")(
    lambda spark, sf: rounded(BT.regime_robustness(sided(spark, sf).withColumn("regime", F.when(F.col("volume") > 250, "busy").when(F.col("volume") > 100, "normal").otherwise("quiet")),
                                                   ["pair", "timeframe"], "regime", "future_return_5")))
LEDGER = f"""WITH RECURSIVE {B}, {', '.join(ROWS)}, l AS (
  SELECT pair, timeframe, ts, rn, close, CASE WHEN side <> 0 THEN close ELSE 0 END AS entry, CASE WHEN side <> 0 THEN rn ELSE 0 END AS er, side, NULL::DOUBLE AS growth, NULL::DOUBLE AS ep, NULL::BIGINT AS eo FROM r1 WHERE rn = 1
  UNION ALL SELECT n.pair, n.timeframe, n.ts, n.rn, n.close,
    CASE WHEN l.entry = 0 THEN CASE WHEN n.side <> 0 THEN n.close ELSE 0 END WHEN g <= -0.02 OR g >= 0.04 THEN 0 ELSE l.entry END,
    CASE WHEN l.entry = 0 THEN CASE WHEN n.side <> 0 THEN n.rn ELSE 0 END WHEN g <= -0.02 OR g >= 0.04 THEN 0 ELSE l.er END,
    CASE WHEN l.entry = 0 THEN n.side WHEN g <= -0.02 OR g >= 0.04 THEN 0 ELSE l.side END,
    CASE WHEN l.entry <> 0 AND (g <= -0.02 OR g >= 0.04) THEN g END, CASE WHEN l.entry <> 0 AND (g <= -0.02 OR g >= 0.04) THEN l.entry END, CASE WHEN l.entry <> 0 AND (g <= -0.02 OR g >= 0.04) THEN l.er END
  FROM l JOIN r1 n ON n.pair = l.pair AND n.timeframe = l.timeframe AND n.rn = l.rn + 1, LATERAL (SELECT 0.1::DOUBLE * l.side * (n.close / nullif(l.entry, 0) - 1) - 0.001::DOUBLE AS g))
  SELECT pair, timeframe, ts, eo AS entry_row, rn AS exit_row, round(ep, 6) AS entry_price, round(close, 6) AS exit_price, round(growth, 6) AS growth FROM l WHERE growth IS NOT NULL"""
query("bt5_ledger", LEDGER)(lambda spark, sf: rounded(BT.ledger(sided(spark, sf)).drop("capital", "pnl")))
query("bt6_stop_ledger")(lambda spark, sf: rounded(BT.stop_ledger(state_table(bars(spark, sf), ["sma_20"], extra=["atr"]).withColumn("side", F.col("state_sma_20")).withColumn(
    "stop", F.col("close") - F.col("side") * 2 * F.col("atr"))), 4))
WF = f"""WITH {B}, {', '.join(ROWS)}, x AS (SELECT pair, timeframe, rn, floor((rn - 1 - 500) / 100)::BIGINT AS fold, side, h, (CASE h WHEN 3 THEN f3 WHEN 5 THEN f5 ELSE f10 END - 0.05::DOUBLE) * side AS r, n
   FROM r1, (VALUES (3), (5), (10)) v(h) WHERE rn - 1 >= 500 AND rn - 1 < n - 10 AND side <> 0),
  y AS (SELECT *, sum(r) OVER w AS c FROM x WHERE r IS NOT NULL AND fold * 100 < n - 510 WINDOW w AS (PARTITION BY pair, timeframe, fold, h, side ORDER BY rn ROWS UNBOUNDED PRECEDING)),
  z AS (SELECT *, max(c) OVER (PARTITION BY pair, timeframe, fold, h, side ORDER BY rn ROWS UNBOUNDED PRECEDING) AS p FROM y)
  SELECT pair, timeframe, fold, h AS horizon, CASE WHEN side > 0 THEN 'bull' ELSE 'bear' END AS side, count(*) AS signals, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
   round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) * sqrt(6048) END, 3) AS sharpe,
   round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(avg(r) / nullif(stddev_pop(CASE WHEN r < 0 THEN r END), 0), 0) * sqrt(6048) END, 3) AS sortino,
   round(min(CASE WHEN p = 0 THEN 0 ELSE (c - p) / p END), 4) AS max_drawdown FROM z GROUP BY ALL"""
query("bt7_walk_forward", WF)(lambda spark, sf: rounded(BT.walk_forward(sided(spark, sf, ["future_return_3", "future_return_5", "future_return_10"]), "side")).withColumns(
    {"sharpe": F.round("sharpe", 3), "sortino": F.round("sortino", 3), "max_drawdown": F.round("max_drawdown", 4)}))
MET = f"""WITH {B}, {', '.join(ROWS)}, x AS (SELECT pair, timeframe, ts, f5 * side AS r FROM r1 WHERE side <> 0 AND f5 IS NOT NULL), y AS (SELECT *, sum(r) OVER (PARTITION BY pair, timeframe ORDER BY ts) AS c FROM x),
  z AS (SELECT *, c - max(c) OVER (PARTITION BY pair, timeframe ORDER BY ts) AS dd, quantile_cont(r, 0.05) OVER (PARTITION BY pair, timeframe) AS v FROM y)
  SELECT pair, timeframe, count(*) AS n, round(avg(r), 4) AS avg_return, round(stddev_pop(r), 3) AS volatility, round(min(dd), 2) AS max_drawdown, round(max(v), 4) AS var_95, round(avg(CASE WHEN r <= v THEN r END), 4) AS cvar_95,
   round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM z GROUP BY 1, 2"""
query("bt8_metrics", MET)(lambda spark, sf: (lambda m: m.select("pair", "timeframe", "n", F.round("avg_return", 4).alias("avg_return"), F.round("volatility", 3).alias("volatility"),
      F.round("max_drawdown", 2).alias("max_drawdown"), F.round("var_95", 4).alias("var_95"), F.round("cvar_95", 4).alias("cvar_95"), F.round("win_rate", 6).alias("win_rate")))(_metrics(spark, sf)))
query("bt8_9_ratios_and_streaks")(lambda spark, sf: rounded(_metrics(spark, sf).select(
    "pair", "sharpe_ratio", "sortino_ratio", "kelly_criterion", "calmar_ratio", "profit_factor", "max_winning_streak", "max_losing_streak"), 4))


def _metrics(spark, sf):
    x = sided(spark, sf).where("side <> 0 and future_return_5 is not null").withColumn("r", F.col("future_return_5") * F.col("side"))
    return BT.comprehensive_metrics(x, "r")


query("bt10_regime_aware", f"WITH {B}, {step('q', {'m': roll('avg', 'close', 50), 'lf': f'ln({LEAD.format(1)} / close)', 'g': 'CASE WHEN volume > 250 THEN 2 WHEN volume < 50 THEN 1 ELSE 0 END'})},"
      " x AS (SELECT *, CASE WHEN close > m THEN 1 ELSE 0 END AS b FROM q WHERE m IS NOT NULL AND lf IS NOT NULL), y AS (SELECT *, CASE g WHEN 2 THEN 1 WHEN 1 THEN 0 ELSE b END AS a FROM x)"
      " SELECT pair, timeframe, round(sum(b * lf), 6) AS base_return, round(sum(a * lf), 6) AS aware_return, sum(b)::BIGINT AS base_bars, sum(a)::BIGINT AS aware_bars FROM y GROUP BY 1, 2")(
    lambda spark, sf: rounded(BT.regime_aware_comparison(compute(bars(spark, sf), ["sma_50", "log_forward_return"]).withColumn(
        "regime", F.when(F.col("volume") > 250, 2).when(F.col("volume") < 50, 1).otherwise(0)))))

# ---- risk ----
LV = ", ".join([B, PIV[0], "lv AS (SELECT pair, ts, list(p5_low) FILTER (sw_low = 1) OVER (PARTITION BY pair ORDER BY ts) AS lo, list(p5_high) FILTER (sw_high = 1) OVER (PARTITION BY pair ORDER BY ts) AS hi, close FROM p0)"])
query("rk1_swing_plan", f"WITH {LV} SELECT pair, ts, round(coalesce(list_max(list_filter(lo[-50:], lambda x: x < close)), close * 0.98::DOUBLE) * 0.995::DOUBLE, 8) AS sl,"
      " round(coalesce(list_min(list_filter(hi[-50:], lambda x: x > close)), close * 1.02::DOUBLE) * 0.995::DOUBLE, 8) AS tp FROM lv")(
    lambda spark, sf: _swing_plan(spark, sf))


def _swing_plan(spark, sf):
    b = bars(spark, sf)
    x = RK.entries_with_levels(b.select("pair", "ts", F.col("close").alias("entry")), b, 50, "")
    return rounded(x.select("pair", "ts", RK.swing_plan(F.col("entry")).alias("p")).select("pair", "ts", "p.sl", "p.tp"), 8)


@query("rk2_hierarchical_plan")
def _rk2(spark, sf):
    b = bars(spark, sf, "15m", "1h", "4h")
    x = b.where("timeframe = '15m'").select("pair", "ts", F.col("close").alias("entry"))
    for tf, k, p in (("4h", 10, "h_"), ("1h", 20, "t_"), ("15m", 30, "l_")):
        x = RK.entries_with_levels(x, b.where(F.col("timeframe") == tf), k, p)
    return rounded(x.select("pair", "ts", "entry", RK.hierarchical_plan(F.col("entry")).alias("p")).select("pair", "ts", "entry", "p.*"))


query("rk3_5_range_and_average_plans", f"WITH {B}, {step('q', {'a': roll('avg', 'high - low', 14), 'g': '(' + roll('max', 'high', 14) + ') - (' + roll('min', 'low', 14) + ')', 'm': roll('avg', 'close', 50)})}"
      " SELECT pair, ts, 'range_atr' AS method, round(close - g * 1.5, 8) AS sl, round(close + g * 2.5, 8) AS tp FROM q UNION ALL SELECT pair, ts, 'moving_average', round(m * 0.99::DOUBLE, 8), round(close + (close - m * 0.99::DOUBLE) * 2, 8) FROM q")(
    lambda spark, sf: rounded(RK.raw_plans(bars(spark, sf)).where("method in ('range_atr', 'moving_average')").select("pair", "ts", "method", "sl", "tp"), 8))
query("rk6_7_plans_validated")(lambda spark, sf: RK.plan_entries(bars(spark, sf)))
query("rk7_best_plan")(lambda spark, sf: RK.best_plan(RK.plan_entries(bars(spark, sf)), ["pair", "timeframe", "ts", "entry"]))
query("rk8_trailing_settings", f"WITH {', '.join([B, *ATRJ])} SELECT pair, ts, CASE WHEN atr > 0 THEN 'atr' ELSE 'percent' END AS mode, round(CASE WHEN atr > 0 THEN atr * 2 ELSE close * 0.01::DOUBLE END, 6) AS distance, CASE WHEN close >= 1000 THEN 2 WHEN close >= 1 THEN 4 ELSE 6 END AS decimals FROM atj")(
    lambda spark, sf: rounded(compute(bars(spark, sf), ["atr"]).select("pair", "ts", *[c.alias(n) for n, c in RK.trailing_settings(F.col("close"), F.col("atr")).items()])))
query("rk9_chandelier", f"WITH {', '.join([B, *ATRJ])} SELECT pair, timeframe, ts, round(max(close) OVER (PARTITION BY pair, timeframe ORDER BY ts) - 3 * atr, 6) AS stop FROM atj")(
    lambda spark, sf: rounded(RK.chandelier("close", "atr", ["pair", "timeframe"])(compute(bars(spark, sf), ["atr"])).select(*KEYS, "stop")))
query("rk9_trailing_percent", f"WITH {B} SELECT pair, timeframe, ts, round(max(close - close * 0.01::DOUBLE) OVER (PARTITION BY pair, timeframe ORDER BY ts), 6) AS stop FROM bars")(
    lambda spark, sf: rounded(RK.trailing_stop(compute(bars(spark, sf), ["atr"])).select(*KEYS, "stop")))
SWL = f"WITH {', '.join([*SWALL, *ATRJ])}, y AS (SELECT s2.pair, s2.timeframe, s2.ts, s2.close, s2.ll, atj.atr, first_value(s2.close) OVER (PARTITION BY s2.pair, s2.timeframe ORDER BY s2.ts) AS entry FROM s2 JOIN atj USING (pair, timeframe, ts))"
query("rk9_trailing_swing", SWL + " SELECT pair, timeframe, ts, max(round(ll, 4)) OVER (PARTITION BY pair, timeframe ORDER BY ts) AS stop FROM y")(
    lambda spark, sf: rounded(RK.trailing_stop(compute(bars(spark, sf), ["atr", "last_swing_low"]).withColumnRenamed("last_swing_low", "swing_level"), mode="swing", places=4).select(*KEYS, "stop")))
query("rk9_breakeven", SWL + " SELECT pair, timeframe, ts, coalesce(close - entry >= 1.0 * atr, false) AS ready FROM y")(
    lambda spark, sf: _breakeven(spark, sf))


def _breakeven(spark, sf):
    """Every series as a position entered at its first close."""
    x = compute(bars(spark, sf), ["atr"])
    entry = x.groupBy("pair", "timeframe").agg(F.min_by("close", "ts").alias("entry"))
    return x.join(entry, ["pair", "timeframe"]).select(*KEYS, RK.breakeven_ready(F.col("close"), F.col("entry"), F.col("atr")).alias("ready"))


query("rk10_position_size", f"WITH {B} SELECT pair, timeframe, ts, round(CASE WHEN volume * 0.1::DOUBLE >= 10 THEN volume * 0.1::DOUBLE / nullif(close, 0) ELSE 0 END, 6) AS quantity FROM bars")(
    lambda spark, sf: rounded(bars(spark, sf).select(*KEYS, RK.position_size(F.col("volume"), F.col("close")).alias("quantity"))))

# ---- reports over a pool of hourly slots as strategies ----
POOL = f"WITH {B}, {', '.join(ROWS)}, g AS (SELECT pair, 'h' || hour(ts) AS setup, count(f5) AS n, sum(CASE WHEN f5 > 0 THEN 1 ELSE 0 END) AS w, avg(CASE WHEN f5 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS wr FROM r1 WHERE f5 IS NOT NULL GROUP BY 1, 2)"


def pool(spark, sf):
    r = F.col("future_return_5")
    return known_returns(compute(bars(spark, sf), ["future_return_5"])).where(r.isNotNull()).groupBy("pair", F.concat(F.lit("h"), F.hour("ts")).alias("setup")).agg(
        F.count(r).alias("n"), F.sum((r > 0).cast("int")).alias("w"), F.avg((r > 0).cast("int")).alias("wr"))


query("rep3_top_per_type", POOL + ", k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY wr DESC, setup) AS rank FROM g) SELECT pair, setup, n, round(wr, 6) AS wr, rank::INTEGER AS rank FROM k WHERE rank <= 5")(
    lambda spark, sf: rounded(R.top_per_type(pool(spark, sf), "pair", "wr", 5, ["setup"]).select("pair", "setup", "n", "wr", "rank")))
query("rep7_by_type", POOL + " SELECT pair, count(*) AS strategies, round(avg(wr), 6) AS avg_accuracy, sum(n)::BIGINT AS total_samples FROM g GROUP BY 1")(
    lambda spark, sf: rounded(R.by_type(pool(spark, sf), "pair", "wr", "n")))
query("rep2_summary", POOL + " SELECT setup AS name, pair, round(wr, 6) AS wr, n FROM g WHERE wr >= 0.01")(
    lambda spark, sf: rounded(pool(spark, sf).where("wr >= 0.01").select(F.coalesce("setup", "pair").alias("name"), "pair", "wr", "n")))
query("rep4_live_monitor")(lambda spark, sf: rounded(R.live_monitor(pool(spark, sf), "wr", "n", ["pair", "setup"])))
query("rep6_robust_rank")(lambda spark, sf: rounded(R.robust_rank(pool(spark, sf).withColumn("robust", 1 - F.abs(F.col("wr") - 0.5)), "wr", "robust")))
query("tk6_plan_candidates", POOL + " SELECT pair, setup, n, round(wr, 6) AS wr FROM g WHERE wr >= 0.55 ORDER BY g.wr DESC, pair, setup LIMIT 30")(
    lambda spark, sf: rounded(R.plan_candidates(pool(spark, sf), "wr", ["pair", "setup"]).select("pair", "setup", "n", "wr")))
TFS = ("15m", "1h", "4h")
LAST = ", ".join(bars_cte(t, f"b{i}") for i, t in enumerate(TFS)) + ", b AS (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(len(TFS))) + ")"
query("tk7_timeframe_priority", f"WITH {LAST}, l AS (SELECT pair, timeframe, arg_max(close, ts) AS close, arg_max(open, ts) AS open FROM b GROUP BY 1, 2)"
      " SELECT pair, timeframe, CASE timeframe WHEN '4h' THEN 1 WHEN '1h' THEN 2 WHEN '15m' THEN 3 ELSE 999 END AS priority, CASE WHEN close > open THEN 'buy' ELSE 'sell' END AS side FROM l")(
    lambda spark, sf: _priority(spark, sf))


def _priority(spark, sf):
    """The newest bar of every series, slow timeframes first, with the side an order in its direction takes."""
    last = bars(spark, sf, *TFS).groupBy("pair", "timeframe").agg(F.max_by("close", "ts").alias("c"), F.max_by("open", "ts").alias("o"))
    side = R.order_side(F.when(F.col("c") > F.col("o"), "bullish").otherwise("bearish"))
    return R.by_timeframe_priority(last.withColumn("side", side), then=["pair"]).select("pair", "timeframe", "priority", "side")


query("hl13_active_orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")(lambda spark, sf: R.active_orders(load(spark, sf, "orders").withColumn(
    "status", F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "filled").otherwise("partial"))).select("o_orderkey", "o_custkey"))
query("sa17_wilson_interval", POOL + ", z AS (SELECT *, 1.959963984540054::DOUBLE AS z FROM g) SELECT pair, setup, round(((wr + z * z / (2 * n)) - z * sqrt(wr * (1 - wr) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low,"
      " round(((wr + z * z / (2 * n)) + z * sqrt(wr * (1 - wr) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM z")(
    lambda spark, sf: rounded(pool(spark, sf).select("pair", "setup", *[c.alias(n) for n, c in zip(("low", "high"), R.wilson(F.col("w").cast("double"), F.col("n").cast("double")))])))


# ---- portfolio ----
_TRIO = (f"WITH {B}, {step('q', {'m': roll('avg', 'close', 20), 'c10': 'lag(close, 10) OVER (PARTITION BY pair, timeframe ORDER BY ts)', 'f': RET.replace('{0}', '5')})},"
         " s AS (SELECT CASE WHEN close > m THEN f WHEN close < m THEN -f END AS sma, CASE WHEN close > c10 THEN f WHEN close < c10 THEN -f END AS roc,"
         " CASE WHEN close > open THEN f WHEN close < open THEN -f END AS bop FROM q)")


def trio(spark, sf):
    x = known_returns(state_table(bars(spark, sf), ["sma_20", "roc", "bop"], extra=["future_return_5"]))
    r = F.col("future_return_5")
    return x.select(*[F.when(F.col(f"state_{s}") != 0, F.col(f"state_{s}") * r).alias(n) for n, s in (("sma", "sma_20"), ("roc", "roc"), ("bop", "bop"))])


query("ag12_strategy_correlation", _TRIO + " SELECT 'sma' AS a, 'roc' AS b, round(corr(sma, roc), 6) AS correlation, count(*) FILTER (sma IS NOT NULL AND roc IS NOT NULL) AS n FROM s"
      " UNION ALL SELECT 'sma', 'bop', round(corr(sma, bop), 6), count(*) FILTER (sma IS NOT NULL AND bop IS NOT NULL) FROM s"
      " UNION ALL SELECT 'roc', 'bop', round(corr(roc, bop), 6), count(*) FILTER (roc IS NOT NULL AND bop IS NOT NULL) FROM s")(
    lambda spark, sf: rounded(PF.correlations(trio(spark, sf), ["sma", "roc", "bop"])))


@query("ag12_diversified")
def _diversified(spark, sf):
    r = trio(spark, sf)
    scores = r.unpivot([], ["sma", "roc", "bop"], "strategy", "ret").where("ret is not null").groupBy("strategy").agg(F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"))
    return rounded(PF.diversified(scores, PF.correlations(r, ["sma", "roc", "bop"]), "strategy", "win_rate"))


@query("rep8_9_exports")
def _exports(spark, sf):
    """The pool as CSV and JSON, counted when read back."""
    root = scratch(spark, "barloom-pool")
    p = pool(spark, sf)
    p.write.option("header", True).csv(f"{root}/csv")
    p.write.json(f"{root}/json")
    csv = spark.read.schema(p.schema).option("header", True).csv(f"{root}/csv").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("samples"))
    js = spark.read.schema(p.schema).json(f"{root}/json").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("samples"))
    return csv.withColumn("format", F.lit("csv")).unionByName(js.withColumn("format", F.lit("json")))
