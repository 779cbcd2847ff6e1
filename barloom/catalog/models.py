"""Swing, hidden Markov, clustering and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import KEYS, bars, query, rounded
from barloom.catalog.indicators import ADX, B, SW
from barloom.functions.labels import known_returns
from barloom.functions.registry import compute
from barloom.plans import discovery as D
from barloom.plans import exports as X
from barloom.plans import models as M
from barloom.plans.mtf import mtf_table
from barloom.session import cut_lineage, scratch

TF = ("4h", "1h", "15m")
SWU = (f"WITH {B}, {SW}, u AS (SELECT pair, timeframe, ts, 0 AS k, 'high' AS kind, high AS price FROM s0 WHERE swing_high = 1 UNION ALL SELECT pair, timeframe, ts, 1, 'low', low FROM s0 WHERE swing_low = 1),"
       " v AS (SELECT *, row_number() OVER w AS swing_no, lag(price) OVER w AS p FROM u WINDOW w AS (PARTITION BY pair, timeframe ORDER BY ts, k))")
query("rm19_20_swing_registry", SWU + " SELECT pair, timeframe, ts, kind, round(price, 6) AS price, round(coalesce(abs(price - p) / p * 100, 0), 6) AS magnitude_pct,"
      " CASE WHEN swing_no <= 2 THEN 'unknown' WHEN kind = 'high' THEN CASE WHEN price > p THEN 'HH' ELSE 'LH' END ELSE CASE WHEN price > p THEN 'HL' ELSE 'LL' END END AS structure FROM v")(
    lambda spark, sf: rounded(M.swing_registry(bars(spark, sf)).select(*KEYS, "kind", "price", "magnitude_pct", "structure")))


query("snk9_swing_registry", SWU + " SELECT pair, timeframe, ts, kind, round(price, 6) AS price, swing_no FROM v")(lambda spark, sf: _registry(spark, sf))


def _registry(spark, sf):
    """The swing registry written as CSV, partitioned by series, and read back."""
    path = scratch(spark, "swing-registry")
    M.swing_registry(bars(spark, sf)).select(*KEYS, "kind", "price", "swing_no").write.partitionBy("pair", "timeframe").option("header", True).csv(path)
    return rounded(spark.read.option("header", True).schema("ts timestamp, kind string, price double, swing_no long, pair string, timeframe string").csv(path).select(*KEYS, "kind", "price", "swing_no"))


_FITTED: dict[tuple[str, str], tuple] = {}


def fitted(spark, sf):
    """Bars, swings, regimes and model of a data set, fitted once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        b = bars(spark, sf)
        s = cut_lineage(M.swing_registry(b))
        r, m = M.hmm_regimes(s)
        _FITTED[key] = (b, s, cut_lineage(r), m)
    return _FITTED[key]


query("rm21_hmm_regimes")(lambda spark, sf: fitted(spark, sf)[2].groupBy("pair", "regime").agg(F.count(F.lit(1)).alias("swings")))
query("rm22_transitions")(lambda spark, sf: rounded(M.transition_table(spark, fitted(spark, sf)[3]), 3))
query("rm23_centroids")(lambda spark, sf: rounded((lambda t: M.centroids(t[1], t[2]))(fitted(spark, sf)), 3))
query("exp6_hmm_states")(lambda spark, sf: rounded((lambda t: M.hmm_states(t[0], t[2]))(fitted(spark, sf)), 4))
query("rm24_regime_runs")(lambda spark, sf: M.regime_runs(fitted(spark, sf)[2]))
query("rm26_next_regime")(lambda spark, sf: rounded((lambda t: (lambda r: r[0].withColumn("test_accuracy", F.lit(r[1])))(M.next_regime(t[1], t[2])))(fitted(spark, sf)), 4))
query("exp7_predictions")(lambda spark, sf: rounded((lambda t: M.predicted_regimes(t[1], t[2])[0])(fitted(spark, sf)).groupBy("pair", "held_out").agg(
    F.count(F.lit(1)).alias("swings"), F.sum(F.col("matches").cast("int")).alias("matches"), F.avg(F.col("matches").cast("int")).alias("match_accuracy")), 4))
query("rm27_bar_regimes")(lambda spark, sf: (lambda t: M.to_bars(t[0], t[2]))(fitted(spark, sf)).groupBy("pair", "hmm_regime").agg(F.count(F.lit(1)).alias("bars")))
RN = "r AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn FROM bars)"
F33 = "OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS 32 PRECEDING)"
query("rm28_window_features", f"WITH {B}, {RN} SELECT pair, timeframe, ts, round(CASE WHEN rn >= 33 THEN sqrt(avg(ln(high / low) ** 2) {F33} / (4 * ln(2))) * 100 END, 6) AS parkinson_vol,"
      f" round(CASE WHEN rn >= 33 THEN regr_slope(close, rn) {F33} / nullif(quantile_cont(close, 0.75) {F33} - quantile_cont(close, 0.25) {F33}, 0) * 100 END, 6) AS robust_slope,"
      f" round(CASE WHEN rn >= 33 THEN regr_slope(ln(close), rn) {F33} * 100 END, 6) AS log_slope FROM r")(
    lambda spark, sf: rounded(compute(bars(spark, sf), list(M.WINDOW_FEATURES)).select(*KEYS, *M.WINDOW_FEATURES)))


def windows(spark, sf):
    return cut_lineage(compute(bars(spark, sf), [*M.WINDOW_FEATURES, "log_forward_return"]))


def clustered(spark, sf):
    w = windows(spark, sf)
    return M.predict_windows(M.fit_window_model(w, restarts=3), w)


query("rm29_30_window_regimes")(lambda spark, sf: clustered(spark, sf).groupBy("regime").agg(F.count(F.lit(1)).alias("bars"), F.round(F.avg("parkinson_vol"), 2).alias("vol")))
query("rm31_walk_forward")(lambda spark, sf: rounded(M.walk_forward_windows(windows(spark, sf)).groupBy("fold", "regime").agg(
    F.count(F.lit(1)).alias("bars"), F.avg(F.abs("log_forward_return")).alias("abs_forward")), 4))


@query("rm32_save_load_dwell")
def _saved(spark, sf):
    from pyspark.ml import PipelineModel

    w = windows(spark, sf)
    path = scratch(spark, "barloom-model") + "/m"
    M.fit_window_model(w, restarts=3).write().overwrite().save(path)
    return rounded(M.dwell(M.predict_windows(PipelineModel.load(path), w)), 4)


query("rm33_actions")(lambda spark, sf: rounded(clustered(spark, sf).withColumn("a", M.action(F.col("regime"), F.col("confidence"))).groupBy("a.mode").agg(
    F.count(F.lit(1)).alias("bars"), F.avg("a.risk").alias("risk")), 4))
query("ag7_regime_report")(lambda spark, sf: rounded(clustered(spark, sf).groupBy("regime").agg(
    F.count(F.lit(1)).alias("bars"), F.avg(F.abs("log_forward_return")).alias("abs_forward"), F.avg("log_forward_return").alias("drift"), F.avg("confidence").alias("confidence")), 4))


def regime_aligned(spark, sf, mode):
    s, r = D.signals_of(mode)
    return mtf_table(bars(spark, sf, *TF), TF, s, [*r, "bar_regime"])


query("dsc13_mode_j")(lambda spark, sf: rounded(D.regime_optimised(regime_aligned(spark, sf, "j"), "l_bar_regime")))
query("dsc19_confluence")(lambda spark, sf: rounded(D.confluence(regime_aligned(spark, sf, "confluence"), "l_bar_regime")))
AROUND = "OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
query("lb2_swing_labels", f"WITH {B}, x AS (SELECT *, CASE WHEN high = max(high) {AROUND} THEN high WHEN low = min(low) {AROUND} THEN low END AS p FROM bars),"
      " v AS (SELECT pair, timeframe, ts, p, lead(p) OVER (PARTITION BY pair, timeframe ORDER BY ts) AS n FROM x WHERE p IS NOT NULL),"
      " l AS (SELECT pair, timeframe, ts, CASE WHEN (n - p) / nullif(p, 0) >= 0.02::DOUBLE THEN 2 WHEN (n - p) / nullif(p, 0) <= -0.02::DOUBLE THEN 1 ELSE 0 END AS r FROM v)"
      " SELECT b.pair, b.timeframe, b.ts, coalesce(l.r, 0) AS regime FROM bars b ASOF LEFT JOIN l ON b.pair = l.pair AND b.ts >= l.ts")(lambda spark, sf: _labels(spark, sf))


def _labels(spark, sf):
    from barloom.plans.labels import swing_labels

    return swing_labels(bars(spark, sf)).select(*KEYS, "regime")


query("exp1_9_bundle")(lambda spark, sf: X.write_bundle(bars(spark, sf), scratch(spark, "barloom-export")))
query("exp8_instance_summary")(lambda spark, sf: rounded(X.instance_summary(compute(bars(spark, sf), ["bar_regime", "_pct1"]))))


MS = f"WITH {B}, {', '.join(ADX)}, t AS (SELECT bars.*, CASE WHEN adx > 30 THEN 'strong_trend' WHEN adx >= 20 THEN 'trending' ELSE 'ranging' END AS r FROM bars LEFT JOIN z USING (pair, timeframe, ts))"
query("ag4_regime_type_stats", MS + ", c AS (SELECT *, CASE WHEN r IS DISTINCT FROM lag(r) OVER (PARTITION BY pair, timeframe ORDER BY ts) THEN 1 ELSE 0 END AS n FROM t)"
      " SELECT r AS regime_type, count(*) AS bars, round(avg(close), 6) AS close_mean, round(stddev_samp(close), 6) AS close_std, round(avg(volume), 6) AS volume_mean, round(stddev_samp(volume), 6) AS volume_std,"
      " sum(n)::BIGINT AS instances FROM c GROUP BY r")(lambda spark, sf: _types(spark, sf))


def _types(spark, sf):
    """Market structure of the hourly bars as regime type, its unbroken runs as instances."""
    df = compute(bars(spark, sf), ["market_structure", "market_structure_run"])
    return rounded(X.regime_type_stats(df, "market_structure", "market_structure_run"))


_ahead = lambda h: f"(lead(close, {h}) OVER (PARTITION BY pair, timeframe ORDER BY ts) / nullif(close, 0) - 1) * 100"
query("exp10_regime_returns", MS + f", f AS (SELECT r, {', '.join(f'{_ahead(h)} AS f{h}' for h in (24, 72, 168))} FROM t) SELECT r AS regime_type, count(*) AS bars, "
      + ", ".join(f"round(avg(f{h}), 6) AS return_{h}, round(avg(CASE WHEN f{h} IS NOT NULL THEN CASE WHEN f{h} > 0 THEN 1.0 ELSE 0.0 END END), 6) AS win_rate_{h}" for h in (24, 72, 168)) + " FROM f GROUP BY r")(
    lambda spark, sf: rounded(X.regime_returns(known_returns(compute(bars(spark, sf), ["market_structure", *[f"future_return_{h}" for h in (24, 72, 168)]])), "market_structure")))
