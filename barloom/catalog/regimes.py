"""Regime instance and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import bars, prev, query, roll, rounded
from barloom.catalog.indicators import ADX, ATR, B, BB, CUM, MACD, RSI, SW, roc, step
from barloom.functions.registry import compute
from barloom.plans import instances as I
from barloom.plans import stats as S
from barloom.session import cut_lineage

_KEYS = "pair, timeframe, seg_start"


def rename(cte: str, old: str, new: str) -> str:
    return cte.replace(f"{old} AS (", f"{new} AS (", 1)


SEG = [
    B, *RSI, *MACD, "pp AS (SELECT pair, timeframe, ts, (e12 - e26) / nullif(e26, 0) * 100 AS ppo FROM e)",
    "f0 AS (SELECT rs.*, macd - sig AS mh, ppo FROM rs LEFT JOIN m USING (pair, timeframe, ts) LEFT JOIN s USING (pair, timeframe, ts) LEFT JOIN pp USING (pair, timeframe, ts))",
    step("f00", {"pc": roc("close", 1), "rn": "row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts)",
                 "hp": f"max(high) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 2 PRECEDING)",
                 "hm": f"min(high) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 2 PRECEDING)"}, "f0"),
    step("f1", {"vol": f"coalesce({roll('stddev_samp', 'pc', 20)}, 0)",
                "st": f"CASE WHEN rn <= 20 THEN 0 WHEN {prev('high')} > hp THEN 1 WHEN {prev('high')} < hm THEN -1 ELSE 0 END",
                "mom": "(rsi - 50) / 50 + sign(mh) + sign(ppo)"}, "f00"),
    step("f2", {"trig": f"coalesce({prev('vol')} > 0 AND abs(vol - {prev('vol')}) / {prev('vol')} > 0.25, false)"
                        f" OR coalesce({prev('st', 10)} <> 0 AND st <> 0 AND {prev('st', 10)} <> st, false) OR coalesce({prev('mom', 10)} * mom < -0.5, false)"}, "f1"),
    """sg AS (SELECT pair, timeframe, ts, rn, rn AS seg_start FROM f2 WHERE rn = 1 UNION ALL
      SELECT n.pair, n.timeframe, n.ts, n.rn, CASE WHEN n.rn - g.seg_start >= 24 AND (n.trig OR n.rn - g.seg_start >= 168) THEN n.rn ELSE g.seg_start END
      FROM sg g JOIN f2 n ON n.pair = g.pair AND n.timeframe = g.timeframe AND n.rn = g.rn + 1)""",
    "cnt AS (SELECT pair, timeframe, seg_start FROM sg GROUP BY ALL HAVING count(*) >= 24)",
    "seg AS (SELECT f2.*, seg_start, f2.rn - seg_start AS pos FROM f2 JOIN sg USING (pair, timeframe, ts) JOIN cnt USING (pair, timeframe, seg_start))",
]
WITH = "WITH RECURSIVE " + ", ".join(SEG)


def trend(x: str) -> str:
    s = f"regr_slope({x}, pos) / nullif(max({x}) - min({x}), 0)"
    return f"CASE WHEN count({x}) < 3 THEN 'stable' WHEN {s} > 0.1 THEN 'increasing' WHEN {s} < -0.1 THEN 'decreasing' ELSE 'stable' END"


def found(spark, sf):
    """Instances, written once for the queries that read them more than once."""
    return I.discover_instances(bars(spark, sf))


def pick(name: str, cols: list[str], sql: str):
    query(name, sql)(lambda spark, sf: rounded(found(spark, sf).select("pair", "timeframe", "seg_start", *cols)))


query("rm1_segment_signals", WITH + " SELECT pair, timeframe, ts, round(vol, 6) AS seg_volatility, st AS seg_structure, round(mom, 6) AS seg_momentum, trig AS seg_trigger FROM f2")(
    lambda spark, sf: rounded(compute(bars(spark, sf), ["seg_volatility", "seg_structure", "seg_momentum", "seg_trigger"]).select(
        "pair", "timeframe", "ts", "seg_volatility", "seg_structure", "seg_momentum", "seg_trigger")))
query("rm2_segments", WITH + " SELECT pair, timeframe, ts, seg_start, pos FROM seg")(
    lambda spark, sf: I.segments(compute(bars(spark, sf), ["seg_trigger"])).select("pair", "timeframe", "ts", "seg_start", "pos"))
pick("rm3_4_identity_and_price", ["instance_id", "start_time", "end_time", "bar_count", "duration_hours", "price_change_pct", "max_drawdown_pct", "max_runup_pct"],
     WITH + f" SELECT {_KEYS}, pair || '_' || timeframe || '_' || strftime(min(ts), '%Y%m%d_%H%M') AS instance_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS bar_count,"
     " round((epoch(max(ts)) - epoch(min(ts))) / 3600.0, 6) AS duration_hours, round((arg_max(close, pos) / arg_min(close, pos) - 1) * 100, 6) AS price_change_pct,"
     " round((min(low) / arg_min(close, pos) - 1) * 100, 6) AS max_drawdown_pct, round((max(high) / arg_min(close, pos) - 1) * 100, 6) AS max_runup_pct FROM seg GROUP BY pair, timeframe, seg_start")
SWG = SW.replace("FROM bars", "FROM bars").replace("s0 AS", "sw0 AS")
pick("rm5_14_swings", ["swing_count", "avg_swing_magnitude_pct", "swing_indices"],
     WITH + f", {SWG}, z AS (SELECT seg.*, swing_high, swing_low FROM seg JOIN sw0 USING (pair, timeframe, ts)),"
     f" y AS (SELECT {_KEYS}, sum(swing_high + swing_low) AS n, list_concat(coalesce(list(high ORDER BY pos) FILTER (swing_high = 1), []), coalesce(list(low ORDER BY pos) FILTER (swing_low = 1), [])) AS v,"
     " list_sort(list_concat(coalesce(list(rn) FILTER (swing_high = 1), []), coalesce(list(rn) FILTER (swing_low = 1), []))) AS idx FROM z GROUP BY ALL)"
     f" SELECT {_KEYS}, n::BIGINT AS swing_count, round(CASE WHEN len(v) > 1 THEN list_avg(list_transform(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]) / v[i - 1] * 100)) ELSE 0 END, 6) AS avg_swing_magnitude_pct, idx AS swing_indices FROM y")
AT = [rename(ATR[0], "d", "dt"), ATR[1].replace("FROM d WHERE", "FROM dt WHERE")]
ADXR = [rename(ADX[0], "d", "da"), *[c.replace("FROM d WHERE", "FROM da WHERE") for c in ADX[1:4]], *ADX[4:]]
ADXR = [rename(c, "ra", "qa").replace("FROM ra ", "FROM qa ") for c in ADXR]
ADXR = [c.replace("m AS (SELECT pair, timeframe, ts, 100", "m AS (SELECT pair, timeframe, ts, 100") for c in ADXR]
SA = WITH + ", " + ", ".join([*AT, *ADXR]) + ", sx AS (SELECT seg.*, atr, adx FROM seg LEFT JOIN ra USING (pair, timeframe, ts) LEFT JOIN z USING (pair, timeframe, ts))"
pick("rm6_dominant_structure", ["dominant_structure"], SA + f", gg AS (SELECT {_KEYS}, count(*) AS n, regr_slope(close, pos) AS sl, coalesce(avg(adx), 0) AS ax, coalesce(avg(atr) / nullif(max(high) - min(low), 0), 0) AS vr FROM sx GROUP BY ALL)"
     f" SELECT {_KEYS}, CASE WHEN n < 20 THEN 'insufficient_data' WHEN ax > 25 THEN CASE WHEN sl > 0 THEN 'trending_up_strong' ELSE 'trending_down_strong' END"
     " WHEN ax > 15 THEN CASE WHEN sl > 0 THEN 'trending_up_moderate' ELSE 'trending_down_moderate' END WHEN vr > 0.4 THEN 'volatile_choppy' ELSE 'ranging_tight' END AS dominant_structure FROM gg")
pick("rm7_trends_and_levels", ["volatility_mean", "volatility_std", "volatility_trend", "rsi_mean", "rsi_std", "rsi_trend", "adx_mean", "adx_trend", "volume_mean", "volume_trend", "macd_hist_mean"],
     SA + f" SELECT {_KEYS}, round(avg(atr), 6) AS volatility_mean, round(stddev_samp(atr), 6) AS volatility_std, {trend('atr')} AS volatility_trend, round(avg(rsi), 6) AS rsi_mean,"
     f" round(stddev_samp(rsi), 6) AS rsi_std, {trend('rsi')} AS rsi_trend, round(avg(adx), 6) AS adx_mean, {trend('adx')} AS adx_trend, round(avg(volume), 6) AS volume_mean,"
     f" {trend('volume')} AS volume_trend, round(avg(mh), 6) AS macd_hist_mean FROM sx GROUP BY ALL")
W = f"PARTITION BY {_KEYS} ORDER BY pos"
W5 = f"OVER ({W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
pick("rm8_10_counts", ["macd_crossovers", "volume_spikes", "higher_highs", "higher_lows", "lower_highs", "lower_lows"],
     WITH + f", c AS (SELECT *, sign(mh) <> lag(sign(mh)) OVER ({W}) AS cr, avg(volume) OVER (PARTITION BY {_KEYS}) AS vm, stddev_pop(volume) OVER (PARTITION BY {_KEYS}) AS vs,"
     f" pos >= 5 AND high > max(high) {W5} AS hh, pos >= 5 AND low > max(low) {W5} AS hl, pos >= 5 AND high < min(high) {W5} AS lh, pos >= 5 AND low < min(low) {W5} AS ll2 FROM seg)"
     f" SELECT {_KEYS}, count(*) FILTER (cr) AS macd_crossovers, count(*) FILTER (vs > 0 AND volume > vm + 2 * vs) AS volume_spikes, count(*) FILTER (hh) AS higher_highs,"
     " count(*) FILTER (hl) AS higher_lows, count(*) FILTER (lh) AS lower_highs, count(*) FILTER (ll2) AS lower_lows FROM c GROUP BY ALL")
query("rm11_16_scores")(lambda spark, sf: rounded(found(spark, sf).select(
    "instance_id", "pullback_count", "avg_pullback_depth_pct", "failed_pullbacks", "consistency_score", "predictability_score", "next_1d_return_pct", "next_3d_return_pct",
    "next_7d_return_pct", "max_favorable_excursion_1d", "max_adverse_excursion_1d")))
query("rm12_13_collections")(lambda spark, sf: found(spark, sf).select(
    "instance_id", F.concat_ws(",", "confirming_indicators").alias("confirming_indicators"), F.concat_ws(",", "price_action_patterns").alias("price_action_patterns"),
    F.to_json("bullish_patterns").alias("bullish_patterns"), F.to_json("bearish_patterns").alias("bearish_patterns"), F.concat_ws(",", "chart_patterns").alias("chart_patterns")))
BBS = [rename(BB[0], "b0", "bb0"), rename(BB[1], "b1", "bb1").replace("FROM b0", "FROM bb0")]
IND = (SA + ", " + ", ".join(BBS) + f", ob AS (SELECT pair, timeframe, ts, sum(coalesce(sign(close - pcl), 0) * volume) {CUM} AS obv FROM (SELECT *, {prev('close')} AS pcl FROM bars)),"
       " sy AS (SELECT sx.*, 4 * bb1.s / nullif(bb1.m, 0) AS bw, obv, atr / nullif(sx.close, 0) * 100 AS ap FROM sx JOIN bb1 USING (pair, timeframe, ts) JOIN ob USING (pair, timeframe, ts)),"
       " lg AS (" + " UNION ALL ".join(f"SELECT {_KEYS}, pos, '{n}' AS indicator_name, {c}::DOUBLE AS v FROM sy" for n, c in (
           ("rsi", "rsi"), ("macd_hist", "mh"), ("ppo", "ppo"), ("adx", "adx"), ("atr_percent", "ap"), ("bb_width", "bw"), ("obv", "obv"))) + "),"
       f" st0 AS (SELECT {_KEYS}, indicator_name, avg(v) AS mean, stddev_samp(v) AS std, {trend('v')} AS trend, quantile_cont(v, 0.7) AS q7, quantile_cont(v, 0.3) AS q3 FROM lg GROUP BY ALL),"
       " st1 AS (SELECT *, CASE indicator_name WHEN 'rsi' THEN CASE WHEN mean > 55 THEN 'rsi_bullish' WHEN mean < 45 THEN 'rsi_bearish' END"
       " WHEN 'macd_hist' THEN CASE WHEN mean > 0 THEN 'macd_bullish' WHEN mean < 0 THEN 'macd_bearish' END WHEN 'ppo' THEN CASE WHEN mean > 0 THEN 'ppo_bullish' WHEN mean < 0 THEN 'ppo_bearish' END"
       " WHEN 'adx' THEN CASE WHEN mean > 25 THEN 'adx_strong_trend' WHEN mean < 20 THEN 'adx_ranging' END WHEN 'atr_percent' THEN CASE WHEN mean > 3 THEN 'high_volatility' WHEN mean < 1 THEN 'low_volatility' END"
       " WHEN 'bb_width' THEN CASE WHEN mean > q7 THEN 'bb_expanding' WHEN mean < q3 THEN 'bb_contracting' END WHEN 'obv' THEN CASE trend WHEN 'increasing' THEN 'obv_accumulation' WHEN 'decreasing' THEN 'obv_distribution' END END AS confirms,"
       " least(100, 50 + coalesce(CASE WHEN std / nullif(abs(mean), 0) < 0.1 THEN 20 WHEN std / nullif(abs(mean), 0) < 0.2 THEN 10 ELSE 0 END, 0)"
       " + CASE WHEN indicator_name = 'rsi' THEN CASE WHEN mean > 70 OR mean < 30 THEN 20 WHEN mean > 60 OR mean < 40 THEN 10 ELSE 0 END WHEN indicator_name = 'adx' THEN CASE WHEN mean > 40 THEN 20 WHEN mean > 25 THEN 10 ELSE 0 END ELSE 0 END"
       " + CASE WHEN trend IN ('increasing', 'decreasing') THEN 10 ELSE 0 END)::DOUBLE AS strength FROM st0),"
       f" ins AS (SELECT {_KEYS}, min(ts) AS start_time, pair || '_' || timeframe || '_' || strftime(min(ts), '%Y%m%d_%H%M') AS instance_id, regr_slope(close, pos) AS sl, coalesce(avg(adx), 0) AS ax,"
       " coalesce(avg(atr) / nullif(max(high) - min(low), 0), 0) AS vr, avg(rsi) AS rsi_mean, avg(volume) AS volume_mean, avg(atr) AS volatility_mean, max(rn) AS lastrn FROM sx GROUP BY pair, timeframe, seg_start),"
       " inst AS (SELECT ins.*, CASE WHEN ax > 25 THEN CASE WHEN sl > 0 THEN 'trending_up_strong' ELSE 'trending_down_strong' END WHEN ax > 15 THEN CASE WHEN sl > 0 THEN 'trending_up_moderate' ELSE 'trending_down_moderate' END"
       " WHEN vr > 0.4 THEN 'volatile_choppy' ELSE 'ranging_tight' END AS structure, (f24.close / l.close - 1) * 100 AS r1, (f72.close / l.close - 1) * 100 AS r3 FROM ins"
       " JOIN f2 l ON l.pair = ins.pair AND l.rn = lastrn LEFT JOIN f2 f24 ON f24.pair = ins.pair AND f24.rn = lastrn + 24 LEFT JOIN f2 f72 ON f72.pair = ins.pair AND f72.rn = lastrn + 72)")


def tables(spark, sf):
    inst = cut_lineage(found(spark, sf))
    return I.child_tables(inst) | {"instances": inst}


query("rm17_confirmation_strength", IND + " SELECT instance_id, indicator_name, confirms, round(strength, 6) AS confirmation_strength, trend FROM st1 JOIN ins USING (pair, timeframe, seg_start)")(
    lambda spark, sf: rounded(I.child_tables(found(spark, sf))["regime_confirming_indicators"].select("instance_id", "indicator_name", "confirms", "confirmation_strength", "trend")))
query("rm18_discover_instances")(lambda spark, sf: rounded(I.child_tables(found(spark, sf))["regime_instances"]))
query("snk4_child_tables")(lambda spark, sf: _counts(tables(spark, sf)))


def _counts(t):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in t.items()])


query("prj3_find_instances", IND + " SELECT instance_id, structure AS dominant_structure, start_time FROM inst WHERE pair = 'click' AND structure LIKE 'trending_up%'")(
    lambda spark, sf: I.find_instances(found(spark, sf), pair="click", limit=None).where("dominant_structure like 'trending_up%'").select("instance_id", "dominant_structure", "start_time"))
query("jn2_indicator_statistics", IND + " SELECT instance_id, round(strength, 6) AS confirmation_strength, structure AS dominant_structure, round(r1, 6) AS next_1d_return_pct, round(r3, 6) AS next_3d_return_pct"
      " FROM st1 JOIN inst USING (pair, timeframe, seg_start) WHERE indicator_name = 'rsi' AND strength >= 60")(
    lambda spark, sf: rounded(I.indicator_statistics(tables(spark, sf), "rsi", 60).select(
        "instance_id", "confirmation_strength", "dominant_structure", "next_1d_return_pct", "next_3d_return_pct")))
query("jn3_pattern_effectiveness")(lambda spark, sf: rounded(I.pattern_effectiveness(tables(spark, sf))))
FLG = IND + (", nm AS (SELECT DISTINCT indicator_name FROM st1), fl AS (SELECT inst.*, nm.indicator_name, CASE WHEN s1.confirms IS NOT NULL THEN 1 ELSE 0 END AS has FROM inst, nm"
             " LEFT JOIN st1 s1 ON s1.pair = inst.pair AND s1.seg_start = inst.seg_start AND s1.indicator_name = nm.indicator_name)")


def flagged(spark, sf, outcome="next_3d_return_pct"):
    t = tables(spark, sf)
    return cut_lineage(S.flags(S.usable(t["instances"]), t["regime_confirming_indicators"], outcome))


query("jn4_has_indicator", FLG + " SELECT instance_id, indicator_name, has, structure AS grp FROM fl")(
    lambda spark, sf: flagged(spark, sf).select("instance_id", "indicator_name", "has", "grp"))
RANK = (" o AS (SELECT structure AS grp, rsi_mean AS value FROM inst WHERE rsi_mean IS NOT NULL QUALIFY count(*) OVER (PARTITION BY structure) >= 5),"
        " rk AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM o),"
        " gs AS (SELECT grp, count(*)::DOUBLE AS n, sum(r) AS rs, avg(value) AS m, var_samp(value) AS v FROM rk GROUP BY 1),"
        " tt AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm FROM gs), ti AS (SELECT coalesce(sum(c * c * c - c), 0) AS t FROM (SELECT count(*)::DOUBLE AS c FROM o GROUP BY value))")
query("sa1_kruskal_anova", IND + "," + RANK + " SELECT 'rsi_mean' AS metric, k AS groups, nn::BIGINT AS observations, round((12 / (nn * (nn + 1)) * (SELECT sum(rs * rs / n) FROM gs) - 3 * (nn + 1)) / (1 - t / (nn * nn * nn - nn)), 6) AS h_statistic,"
      " round(((SELECT sum(n * (m - tt.gm) ** 2) FROM gs) / (k - 1)) / ((SELECT sum((n - 1) * v) FROM gs) / (nn - k)), 6) AS f_statistic FROM tt, ti")(
    lambda spark, sf: rounded(S.kruskal_anova(S.usable(found(spark, sf)), ["rsi_mean"], "dominant_structure", 5).select("metric", "groups", "observations", "h_statistic", "f_statistic")))
PAIRU = IND + "," + RANK + (", pr AS (SELECT a.grp AS ga, b.grp AS gb FROM gs a JOIN gs b ON a.grp < b.grp),"
                            " u AS (SELECT ga, gb, sum(CASE WHEN x.value > y.value THEN 1.0 WHEN x.value = y.value THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM pr JOIN o x ON x.grp = ga JOIN o y ON y.grp = gb GROUP BY ALL)")
query("sa2_pairwise_mannwhitney", PAIRU + " SELECT 'rsi_mean' AS metric, ga AS group_a, gb AS group_b, round(u, 6) AS statistic FROM u")(
    lambda spark, sf: rounded(S.pairwise(S.usable(found(spark, sf)), ["rsi_mean"], "dominant_structure", min_group=5).select("metric", "group_a", "group_b", "statistic")))
query("sa2_pairwise_ttest_holm")(lambda spark, sf: rounded(S.pairwise(S.usable(found(spark, sf)), ["rsi_mean", "adx_mean"], "dominant_structure", "t", 5)))
query("sa3_chi_square", FLG + ", ce AS (SELECT indicator_name, structure AS grp, has, count(*) AS o FROM fl GROUP BY ALL), ro AS (SELECT indicator_name, grp, sum(o) AS r FROM ce GROUP BY ALL),"
      " co AS (SELECT indicator_name, has, sum(o) AS c FROM ce GROUP BY ALL), nn AS (SELECT indicator_name, sum(o) AS n, count(DISTINCT grp) AS kr, count(DISTINCT has) AS kc FROM ce GROUP BY ALL),"
      " ex AS (SELECT indicator_name, kr, kc, n, r * c / n::DOUBLE AS e, abs(coalesce(o, 0) - r * c / n::DOUBLE) AS g FROM ro JOIN co USING (indicator_name) JOIN nn USING (indicator_name) LEFT JOIN ce USING (indicator_name, grp, has)),"
      " x2 AS (SELECT indicator_name, sum(CASE WHEN kr = 2 AND kc = 2 THEN (g - least(0.5, g)) ** 2 ELSE g * g END / e) AS chi2, max(kr) AS kr, max(kc) AS kc, max(n) AS n FROM ex GROUP BY 1 HAVING max(kr) >= 2 AND max(kc) >= 2)"
      " SELECT indicator_name, round(chi2, 6) AS chi2, (kr - 1) * (kc - 1) AS dof, round(sqrt(chi2 / (n * least(kr - 1, kc - 1))), 6) AS cramers_v FROM x2")(
    lambda spark, sf: rounded(S.chi_square(flagged(spark, sf)).select("indicator_name", "chi2", "dof", "cramers_v")))
def psi(x: str) -> str:
    return f"(ln({x} + 6) - 1 / (2.0 * ({x} + 6)) - 1 / (12.0 * ({x} + 6) ** 2) + 1 / (120.0 * ({x} + 6) ** 4) - 1 / (252.0 * ({x} + 6) ** 6)" + "".join(f" - 1.0 / ({x} + {i})" for i in range(6)) + ")"


query("sa4_mutual_information", FLG + ", kn AS (SELECT indicator_name, has, floor(r3 * 1e9)::BIGINT AS y, row_number() OVER () AS id FROM fl WHERE r3 IS NOT NULL AND NOT isnan(r3)),"
      " ke AS (SELECT *, count(*) OVER (PARTITION BY indicator_name, has) AS size FROM kn QUALIFY size > 1),"
      " ds AS (SELECT a.indicator_name, a.has, a.id, a.y, a.size, list_sort(list(abs(b.y - a.y))) AS d FROM ke a JOIN ke b ON b.indicator_name = a.indicator_name"
      " AND b.has = a.has AND b.id <> a.id GROUP BY ALL), nb AS (SELECT indicator_name, has, id, y, size, least(3, size - 1) AS k, d[least(3, size - 1)] AS r FROM ds),"
      " mm AS (SELECT nb.indicator_name, nb.id, nb.size, CASE WHEN nb.r = 0 THEN count(*) FILTER (b.has = nb.has) ELSE nb.k END AS k, count(*) AS m FROM nb JOIN ke b ON b.indicator_name = nb.indicator_name"
      " AND (abs(b.y - nb.y) < nb.r OR b.y = nb.y) GROUP BY nb.indicator_name, nb.id, nb.size, nb.r, nb.k), su AS (SELECT indicator_name, count(*) AS n, avg(" + psi("k") + " - " + psi("size") + " - " + psi("m") + ") AS s FROM mm GROUP BY 1)"
      " SELECT indicator_name, round(greatest(0.0, " + psi("n") + " + s), 6) AS mutual_info, n::BIGINT AS observations FROM su")(
    lambda spark, sf: rounded(S.mutual_information(flagged(spark, sf))))
query("sa5_distance_correlation", FLG + ", kn AS (SELECT indicator_name, instance_id, has, r3 AS y FROM fl WHERE r3 IS NOT NULL),"
      " pw AS (SELECT a.indicator_name, a.instance_id AS i, abs(a.has - b.has)::DOUBLE AS dx, abs(a.y - b.y) AS dy FROM kn a JOIN kn b USING (indicator_name)),"
      " rw AS (SELECT indicator_name, i, avg(dx) AS mx, avg(dy) AS my FROM pw GROUP BY ALL),"
      " tot AS (SELECT indicator_name, avg(dx * dy) AS s1, avg(dx) * avg(dy) AS s2, avg(dx * dx) AS x1, avg(dx) ** 2 AS x2, avg(dy * dy) AS y1, avg(dy) ** 2 AS y2, sqrt(count(*))::BIGINT AS n FROM pw GROUP BY 1),"
      " s3 AS (SELECT indicator_name, avg(mx * my) AS s3, avg(mx * mx) AS x3, avg(my * my) AS y3 FROM rw GROUP BY 1)"
      " SELECT indicator_name, n AS observations, round(coalesce(sqrt(greatest(0, (s1 + s2 - 2 * s3) / nullif(sqrt(greatest(x1 + x2 - 2 * x3, 0) * greatest(y1 + y2 - 2 * y3, 0)), 0))), 0), 6) AS distance_corr FROM tot JOIN s3 USING (indicator_name)")(
    lambda spark, sf: rounded(S.distance_correlation(flagged(spark, sf))))
query("sa6_granger")(lambda spark, sf: rounded(S.granger(flagged(spark, sf))))
FEATS = ["volatility_mean", "rsi_mean", "adx_mean", "volume_mean", "price_change_pct"]


def model(name, fn):
    query(name)(lambda spark, sf: rounded(fn(cut_lineage(S.usable(found(spark, sf)))), 4))


model("sa7_logistic_regime", lambda d: S.logistic_regime(d, FEATS, "dominant_structure"))
model("sa8_permutation_importance", lambda d: S.permutation_importance(d, FEATS, "dominant_structure"))
query("sa9_markov_transitions", IND + ", t AS (SELECT structure AS from_structure, lead(structure) OVER (PARTITION BY pair, timeframe ORDER BY start_time) AS to_structure FROM inst),"
      " c AS (SELECT from_structure, to_structure, count(*) AS n FROM t WHERE to_structure IS NOT NULL GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY from_structure)::DOUBLE, 6) AS probability FROM c")(
    lambda spark, sf: rounded(S.transitions(found(spark, sf))))
query("sa9_transition_indicators")(lambda spark, sf: (lambda t: S.transition_indicators(t["instances"], t["regime_confirming_indicators"]))(tables(spark, sf)))
model("sa10_pca", lambda d: S.pca_contribution(d, FEATS).withColumn("loading", F.abs("loading")))
model("sa11_silhouette", lambda d: S.silhouette(d, FEATS, "dominant_structure"))
model("sa12_cluster_stability", lambda d: S.cluster_stability(d, FEATS))
query("sa13_causal_suite")(lambda spark, sf: rounded(S.causal_suite(flagged(spark, sf))))
query("sa14_indicator_combinations", IND + ", ci AS (SELECT pair, timeframe, seg_start, confirms FROM st1 WHERE confirms IS NOT NULL), k1 AS (SELECT pair, timeframe, seg_start, confirms AS combo FROM ci),"
      " k2 AS (SELECT a.pair, a.timeframe, a.seg_start, a.confirms || '+' || b.confirms FROM ci a JOIN ci b USING (pair, timeframe, seg_start) WHERE a.confirms < b.confirms),"
      " k3 AS (SELECT a.pair, a.timeframe, a.seg_start, a.confirms || '+' || b.confirms || '+' || c.confirms FROM ci a JOIN ci b USING (pair, timeframe, seg_start) JOIN ci c USING (pair, timeframe, seg_start) WHERE a.confirms < b.confirms AND b.confirms < c.confirms),"
      " kk AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM k3), gg AS (SELECT combo, count(*) AS n, avg(r1) AS a1, avg(r3) AS a3, avg(CASE WHEN r1 > 0 THEN 1.0 ELSE 0.0 END) AS wr FROM kk JOIN inst USING (pair, timeframe, seg_start) GROUP BY 1)"
      " SELECT combo, n, round(a1, 6) AS avg_1d, round(a3, 6) AS avg_3d, round(wr, 6) AS win_rate FROM gg WHERE n >= 20 ORDER BY a3 DESC, combo LIMIT 20")(
    lambda spark, sf: rounded(S.indicator_combinations(found(spark, sf))))
query("sa15_correlation_direction", IND + ", xx AS (SELECT indicator_name, mean, structure FROM st1 JOIN inst USING (pair, timeframe, seg_start) WHERE mean IS NOT NULL), rr AS (SELECT DISTINCT indicator_name, structure FROM xx),"
      " cc AS (SELECT rr.indicator_name, rr.structure, corr(xx.mean, CASE WHEN xx.structure = rr.structure THEN 1.0 ELSE 0.0 END) AS c FROM rr JOIN xx USING (indicator_name) GROUP BY rr.indicator_name, rr.structure)"
      " SELECT indicator_name, structure AS dominant_structure, round(c, 5) AS correlation, CASE WHEN c > 0 THEN 'HIGH' ELSE 'LOW' END AS direction FROM cc")(
    lambda spark, sf: rounded((lambda t: S.correlation_direction(t["instances"], t["regime_confirming_indicators"]))(tables(spark, sf)), 5))


@query("sa16_drivers")
def _drivers(spark, sf):
    t = tables(spark, sf)
    fl = cut_lineage(S.flags(S.usable(t["instances"]), t["regime_confirming_indicators"], "next_3d_return_pct"))
    return S.drivers(S.causal_suite(fl), S.correlation_direction(t["instances"], t["regime_confirming_indicators"]))


