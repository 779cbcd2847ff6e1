"""Source, sink and aggregate queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from barloom.session import scratch

from barloom.catalog.base import KEYS, bars, bars_cte, load, prev, query, roll, rounded
from barloom.catalog.indicators import B, RSI, roc, step
from barloom.functions.labels import known_returns
from barloom.functions.registry import BASE, REGISTRY, compute
from barloom.operators.quantiles import grouped_quantiles
from barloom.sources import store
from barloom.sources.bars import bars_from_ticks, normalise_klines, resample, split_pair_timeframe, ticks_from_events

OHLCV = ["open", "high", "low", "close", "volume"]
SEL = ", ".join(f"round({c}, 6) AS {c}" for c in OHLCV)
HALF = "TIMESTAMP '2024-01-16 00:00:00'"


def half(df, later: bool):
    c = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp")
    return df.where(c if later else ~c)


query("bars_15m", f"WITH {bars_cte('15m')} SELECT pair, timeframe, ts, {SEL} FROM bars")(
    lambda spark, sf: rounded(bars_from_ticks(ticks_from_events(load(spark, sf, "events")), "15m")))
query("bars_resampled_4h", f"WITH {bars_cte('4h')} SELECT pair, timeframe, ts, {SEL} FROM bars")(
    lambda spark, sf: rounded(resample(bars(spark, sf, "15m"), "4h")))


@query("src1_normalise_klines", f"WITH {B} SELECT pair, timeframe, ts, {SEL} FROM bars")
def _klines(spark, sf):
    """Pages landed with repeats and a bad row come back as the clean bars."""
    b = bars(spark, sf)
    row = F.array(F.unix_seconds("ts").cast("double"), *[F.col(c) for c in OHLCV])
    day = F.date_format("ts", "yyyyMMddHH").cast("int")
    pages = b.select("pair", "timeframe", F.struct(day.alias("page_no"), F.array(row, row, F.array(*[F.lit(0.0)] * 6)).alias("rows")).alias("p")).select(
        "pair", "timeframe", "p.*")
    stale = b.select("pair", "timeframe", F.lit(0).alias("page_no"), F.array(F.array(F.unix_seconds("ts").cast("double"), *[F.lit(-1.0)] * 5)).alias("rows"))
    return rounded(normalise_klines(pages.unionByName(stale)))


query("src2_newer_than_stored", f"WITH {B} SELECT pair, timeframe, ts, {SEL} FROM bars WHERE ts >= {HALF}")(
    lambda spark, sf: rounded((lambda b: store.newer_than_stored(b, half(b, False)))(bars(spark, sf))))
query("src3_backfill_plan", f"WITH {B}, m AS (SELECT pair, max(ts) AS m FROM bars GROUP BY 1) SELECT pair, tf AS timeframe, CASE WHEN tf = '1h' THEN m + INTERVAL 1 SECOND ELSE TIMESTAMP '2024-02-01' - INTERVAL 365 DAY END AS start_ts"
      " FROM m, (VALUES ('15m'), ('1h')) v(tf)")(
    lambda spark, sf: (lambda b: store.backfill_plan(b, ["15m", "1h"], b, __import__("datetime").datetime(2024, 2, 1)))(bars(spark, sf)))
query("src4_last_n", f"WITH {B}, r AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts DESC) AS k FROM bars) SELECT pair, timeframe, ts, {SEL} FROM r WHERE k <= 50")(
    lambda spark, sf: rounded(store.scan(bars(spark, sf), last=50)))
query("src5_scan_series", f"WITH {B} SELECT pair, timeframe, ts, {SEL} FROM bars WHERE pair = 'click'")(
    lambda spark, sf: rounded(store.scan(bars(spark, sf), "click", "1h")))
query("src6_series_lists", f"WITH {bars_cte('1h', 'a')}, {bars_cte('4h', 'b')} SELECT DISTINCT pair, timeframe FROM a UNION SELECT DISTINCT pair, timeframe FROM b")(
    lambda spark, sf: store.series_list(bars(spark, sf, "1h", "4h")))


@query("src7_csv_roundtrip", f"WITH {B} SELECT pair, timeframe, ts, {SEL} FROM bars")
def _csv(spark, sf):
    from barloom.sources.bars import BAR_SCHEMA

    path = scratch(spark, "barloom-csv") + "/bars"
    bars(spark, sf).select(*BASE).write.option("header", True).csv(path)
    return rounded(spark.read.schema(BAR_SCHEMA).option("header", True).csv(path))


query("snk1_insert_absent", f"WITH {B} SELECT pair, timeframe, ts, {SEL} FROM bars WHERE ts >= {HALF}")(
    lambda spark, sf: rounded((lambda b: store.insert_absent(b, half(b, False)))(bars(spark, sf))))


@query("snk2_upsert_features", f"WITH {B}, {step('q', {'m': roll('avg', 'close', 7)})} SELECT pair, timeframe, ts, round(close, 6) AS close, CASE WHEN ts >= {HALF} THEN round(m, 6) END AS sma_7 FROM q")
def _upsert(spark, sf):
    """A later write brings a new column and replaces the rows it has."""
    path = scratch(spark, "barloom-upsert") + "/features"
    b = compute(bars(spark, sf), ["sma_7"])
    store.upsert(spark, path, b.select("pair", "timeframe", "ts", "close"))
    store.upsert(spark, path, half(b, True).select("pair", "timeframe", "ts", "close", "sma_7"))
    return rounded(store.read_table(spark, path).select("pair", "timeframe", "ts", "close", "sma_7"))


query("snk10_progress", f"WITH {B}, {', '.join(RSI)} SELECT pair, timeframe, count(*) AS raw_rows, count(rsi) AS featured_rows, count(*) - count(rsi) AS missing FROM rs GROUP BY 1, 2")(
    lambda spark, sf: store.progress(compute(bars(spark, sf), ["rsi"])))
query("inc1_newest_rows", f"WITH {B}, {', '.join(RSI)}, r AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts DESC) AS k FROM rs) SELECT pair, timeframe, ts, round(rsi, 6) AS rsi FROM r WHERE k <= 5")(
    lambda spark, sf: rounded(store.scan(compute(store.newest_context(bars(spark, sf), 5), ["rsi"]), last=5).select(*KEYS, "rsi")))
query("inc2_catch_up", f"WITH {B}, {', '.join(RSI)} SELECT pair, timeframe, ts, round(rsi, 6) AS rsi FROM rs WHERE ts >= {HALF}")(
    lambda spark, sf: rounded((lambda b: store.catch_up(b, half(b, False), ["rsi"]))(bars(spark, sf)).select(*KEYS, "rsi")))
query("prj1_sanitise", f"WITH {B} SELECT pair, ts, round(high, 6) AS my_close FROM bars")(
    lambda spark, sf: rounded(store.sanitise(bars(spark, sf).select("pair", "ts", F.col("close").alias("my.close"), F.col("high").alias("My_close")))))
query("prj2_categories")(lambda spark, sf: bars(spark, sf).groupBy("pair").agg(F.count(F.lit(1)).alias("bars")).withColumn(
    "k", F.explode(F.array(*[F.struct(F.lit(g).alias("category"), F.lit(sum(f.group == g for f in REGISTRY.values())).alias("columns"))
                             for g in ("indicator", "candle", "chart", "swing", "action", "helper")]))).select("pair", "bars", "k.*"))
query("split_pair_timeframe", f"WITH {B} SELECT DISTINCT pair || '_usdt' AS pair, timeframe FROM bars")(
    lambda spark, sf: split_pair_timeframe(bars(spark, sf).select(F.concat_ws("_", "pair", F.lit("usdt"), "timeframe").alias("pair_tf")).distinct()).select("pair", "timeframe"))
CR = [*RSI, step("c", {"p": prev("rsi"), "up": f"rsi > 50 AND {prev('rsi')} <= 50", "dn": f"rsi < 50 AND {prev('rsi')} >= 50"}, "rs")]
query("prj5_conditions", f"WITH {B}, {', '.join(CR)} SELECT pair, timeframe, ts, CASE WHEN up THEN 1 ELSE 0 END AS crosses_above, CASE WHEN dn THEN 1 ELSE 0 END AS crosses_below,"
      f" CASE WHEN count(rsi) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS 2 PRECEDING) = 3 AND min(CASE WHEN rsi > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY pair, timeframe ORDER BY ts ROWS 2 PRECEDING) = 1 THEN 1 ELSE 0 END AS above_for_3 FROM c")(
    lambda spark, sf: _conditions(spark, sf))


def _conditions(spark, sf):
    from barloom.plans.rules import Condition, apply_conditions

    conds = {"crosses_above": Condition("rsi", "crosses_above", 50), "crosses_below": Condition("rsi", "crosses_below", 50),
             "above_for_3": Condition("rsi", ">", 50, 3)}
    return apply_conditions(bars(spark, sf), conds).select(*KEYS, *conds)


query("prj6_formula", f"WITH {B}, {', '.join(RSI)}, {step('q', {'m': roll('avg', 'close', 20), 'v': roll('avg', 'volume', 5)}, 'rs')} SELECT pair, timeframe, ts, CASE WHEN rsi > 50 AND (CASE WHEN close > m THEN 1 ELSE 0 END + CASE WHEN volume > 100 THEN 1 ELSE 0 END) >= 1 THEN 1 ELSE 0 END AS hit FROM q")(
    lambda spark, sf: _formula(spark, sf))


def _formula(spark, sf):
    from barloom.plans.rules import Condition, Formula, apply_formula

    f = Formula([Condition("rsi", ">", 50)], [Condition("close", ">", "sma_20"), Condition("volume", ">", 100)], 1)
    return apply_formula(bars(spark, sf), {"hit": f}).select(*KEYS, "hit")


query("prj9_chronological_split", f"WITH {B}, r AS (SELECT *, row_number() OVER (PARTITION BY pair, timeframe ORDER BY ts) AS rn, count(*) OVER (PARTITION BY pair, timeframe) AS n FROM bars)"
      " SELECT pair, timeframe, ts, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM r")(
    lambda spark, sf: _split(spark, sf))


def _split(spark, sf):
    from barloom.operators.blocks import number_rows

    b = number_rows(bars(spark, sf))
    n = b.groupBy("pair", "timeframe").agg(F.count(F.lit(1)).alias("n"))
    return b.join(n, ["pair", "timeframe"]).select(*KEYS, F.when(F.col("_rn") <= F.floor(F.col("n") * 0.8), "train").otherwise("test").alias("part"))


# ---- aggregates ----
LBL = step("q", {"r": "CASE WHEN lead(close, 5) OVER (PARTITION BY pair, timeframe ORDER BY ts) IS NULL THEN NULL ELSE (lead(close, 5) OVER (PARTITION BY pair, timeframe ORDER BY ts) / nullif(close, 0) - 1) * 100 END", "p": roc("close", 1)})
query("ag5_returns_with_median", f"WITH {B}, {LBL} SELECT pair, timeframe, count(r) AS n, round(avg(r), 4) AS mean_return, round(median(r), 6) AS median_return, round(stddev_samp(r), 4) AS std_return, round(avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0.0 END), 6) AS win_rate FROM q GROUP BY 1, 2")(
    lambda spark, sf: _ag5(spark, sf))


def _ag5(spark, sf):
    df = known_returns(compute(bars(spark, sf), ["future_return_5"]))
    r = F.col("future_return_5")
    g = df.groupBy("pair", "timeframe").agg(F.count(r).alias("n"), F.round(F.avg(r), 4).alias("mean_return"), F.round(F.stddev_samp(r), 4).alias("std_return"),
                                            F.round(F.avg((r > 0).cast("int")), 6).alias("win_rate"))
    med = grouped_quantiles(df, ["pair", "timeframe"], ["future_return_5"], [0.5]).select("pair", "timeframe", F.round("value", 6).alias("median_return"))
    return g.join(med, ["pair", "timeframe"])


query("ag6_regime_identity", f"WITH {B}, {step('q', {'f': 'lead(close) OVER (PARTITION BY pair, timeframe ORDER BY ts) / close - 1', 'g': 'CASE WHEN volume > 250 THEN 2 WHEN volume > 100 THEN 1 ELSE 0 END'})}"
      " SELECT g AS regime, count(*) AS n, round(avg(f), 5) AS mean_return, round(stddev_samp(f), 4) AS std_return, round(avg(CASE WHEN f > 0 THEN 1.0 WHEN f <= 0 THEN 0.0 END), 6) AS bull_prob, round(avg(high - low), 6) AS mean_range,"
      " round(count(*) / sum(count(*)) OVER ()::DOUBLE * 100, 6) AS share_pct FROM q GROUP BY 1")(
    lambda spark, sf: _ag6(spark, sf))


def _ag6(spark, sf):
    from barloom.functions.frames import lead
    from barloom.functions.registry import native

    if "_fwd1" not in REGISTRY:
        native("_fwd1", ["close"], lambda: F.try_divide(lead("close"), F.col("close")) - 1, ahead=1)
    df = compute(bars(spark, sf), ["_fwd1"]).withColumn("regime", F.when(F.col("volume") > 250, 2).when(F.col("volume") > 100, 1).otherwise(0))
    f = F.col("_fwd1")
    g = df.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f), 5).alias("mean_return"), F.round(F.stddev_samp(f), 4).alias("std_return"),
                                 F.round(F.avg((f > 0).cast("int")), 6).alias("bull_prob"), F.round(F.avg(F.col("high") - F.col("low")), 6).alias("mean_range"))
    total = g.agg(F.sum("n").alias("_all"))
    return g.join(total, F.lit(True)).withColumn("share_pct", F.round(F.col("n") / F.col("_all") * 100, 6)).drop("_all")


query("ag10_crosstab", f"WITH {B}, {', '.join(RSI)} SELECT pair, count(*) FILTER (rsi < 30) AS low, count(*) FILTER (rsi >= 30 AND rsi <= 70) AS mid, count(*) FILTER (rsi > 70) AS high FROM rs GROUP BY 1")(
    lambda spark, sf: compute(bars(spark, sf), ["rsi"]).groupBy("pair").agg(*[
        F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(n) for n, c in (("low", F.col("rsi") < 30), ("mid", F.col("rsi").between(30, 70)), ("high", F.col("rsi") > 70))]))
query("ag13_column_profile", f"WITH {B} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) - count({c}) AS nulls, round(avg({c}), 5) AS mean, round(stddev_samp({c}), 5) AS std FROM bars" for c in OHLCV))(
    lambda spark, sf: profile(bars(spark, sf), OHLCV))


def profile(df, cols):
    """Counts, nulls, mean and deviation of each column from one pass over the unpivoted values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "v")
    return long.groupBy("column_name").agg(F.count("v").alias("non_null"), F.sum(F.col("v").isNull().cast("int")).alias("nulls"),
                                           F.round(F.avg("v"), 5).alias("mean"), F.round(F.stddev_samp("v"), 5).alias("std"))


query("ag14_pattern_effectiveness")(lambda spark, sf: _ag14(spark, sf))


def _ag14(spark, sf):
    from barloom.functions.candles import CANDLES
    from barloom.functions.states import state_long, state_table
    from barloom.plans.discovery import hits

    sig = [f"pattern_{c}" for c in CANDLES]
    long = state_long(state_table(bars(spark, sf), sig, extra=["future_return_5"]), sig, ["future_return_5"]).where("code <> 0")
    long = long.withColumn("direction", F.when(F.col("code") == 1, "bullish").otherwise("bearish"))
    g = long.groupBy("signal", "direction").agg(F.count(F.lit(1)).alias("occurrences"), F.sum(hits(F.col("direction"), "future_return_5").cast("int")).alias("successes"))
    return rounded(g.where("occurrences >= 10").withColumn("accuracy", F.col("successes") / F.col("occurrences")))


query("ag16_common_elements", f"WITH {B}, t AS (SELECT pair, ts, CASE WHEN close > open THEN 'up' ELSE 'down' END || ',' || CASE WHEN volume > 100 THEN 'busy' ELSE 'quiet' END AS tags FROM bars),"
      " e AS (SELECT pair, trim(unnest(string_split(tags, ','))) AS element FROM t), n AS (SELECT pair, count(*) AS n FROM t GROUP BY 1)"
      " SELECT pair, element, count(*) AS occurrences, round(count(*) / max(n)::DOUBLE, 6) AS frequency FROM e JOIN n USING (pair) GROUP BY 1, 2 HAVING count(*) / max(n)::DOUBLE >= 0.5")(
    lambda spark, sf: _ag16(spark, sf))


def _ag16(spark, sf):
    t = bars(spark, sf).select("pair", F.concat_ws(",", F.when(F.col("close") > F.col("open"), "up").otherwise("down"),
                                                   F.when(F.col("volume") > 100, "busy").otherwise("quiet")).alias("tags"))
    return rounded(common_elements(t, "pair", "tags"))


def common_elements(df, by, col, min_frequency=0.5):
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    e = df.select(by, F.explode(F.transform(F.split(col, ","), lambda x: F.trim(x))).alias("element"))
    g = e.groupBy(by, "element").agg(F.count(F.lit(1)).alias("occurrences")).join(n, by)
    return g.withColumn("frequency", F.col("occurrences") / F.col("_n")).where(F.col("frequency") >= min_frequency).drop("_n")


query("ag18_summary", f"WITH {B} SELECT count(*) AS rows, count(DISTINCT pair) AS pairs, min(ts) AS first_ts, max(ts) AS last_ts FROM bars")(
    lambda spark, sf: bars(spark, sf).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pair").alias("pairs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
query("wn7_islands", f"WITH {B}, {step('q', {'d': 'CASE WHEN close > open THEN 1 ELSE 0 END'})}, {step('q1', {'c': f'''CASE WHEN d = {prev('d')} THEN 0 ELSE 1 END'''}, 'q')},"
      " q2 AS (SELECT *, sum(c) OVER (PARTITION BY pair, timeframe ORDER BY ts) AS island FROM q1) SELECT pair, timeframe, ts, island::BIGINT AS island, row_number() OVER (PARTITION BY pair, timeframe, island ORDER BY ts) AS bars_in_island FROM q2")(
    lambda spark, sf: _islands(spark, sf))


def _islands(spark, sf):
    from barloom.functions.frames import lag
    from barloom.functions.registry import fill, native, total

    if "island" not in REGISTRY:
        native("_bar_up", ["open", "close"], lambda: F.when(F.col("close") > F.col("open"), 1).otherwise(0))
        total("island", ["_bar_up"], lambda: F.when(F.col("_bar_up") == lag("_bar_up"), 0).otherwise(1))
        fill("_island_from", ["_bar_up", "_rn"], lambda: F.when(F.coalesce(F.col("_bar_up") != lag("_bar_up"), F.lit(True)), F.col("_rn")))
        native("bars_in_island", ["_island_from", "_rn"], lambda: F.col("_rn") - F.col("_island_from") + 1)
    return compute(bars(spark, sf), ["island", "bars_in_island"]).select(*KEYS, "island", "bars_in_island")


query("tk3_deduplicated_top", f"WITH {B}, {LBL}, g AS (SELECT pair, hour(ts) AS h, count(r) AS n, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS wr FROM q WHERE r IS NOT NULL GROUP BY 1, 2),"
      " k AS (SELECT *, row_number() OVER (PARTITION BY round(wr, 4), n ORDER BY pair, h) AS d FROM g) SELECT pair, h, n, round(wr, 6) AS win_rate FROM k WHERE d = 1 ORDER BY wr DESC, n DESC, pair, h LIMIT 20")(
    lambda spark, sf: _tk3(spark, sf))


def _tk3(spark, sf):
    from barloom.plans.reports import top_strategies

    df = known_returns(compute(bars(spark, sf), ["future_return_5"])).where("future_return_5 is not null")
    g = df.groupBy("pair", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("future_return_5") > 0).cast("int")).alias("win_rate"))
    return rounded(top_strategies(g, "win_rate", "n", ["pair", "h"], 20, 0))


query("so3_intersection_share", f"WITH {bars_cte('1h', 'a')}, {bars_cte('4h', 'b')} SELECT a.pair, count(*) AS shared, round(count(*) / (SELECT count(*) FROM b z WHERE z.pair = a.pair)::DOUBLE, 6) AS ratio FROM a JOIN b ON a.pair = b.pair AND a.ts = b.ts GROUP BY a.pair")(
    lambda spark, sf: _so3(spark, sf))


def _so3(spark, sf):
    b = bars(spark, sf, "1h", "4h")
    slow = b.where("timeframe = '4h'").select("pair", "ts")
    n = slow.groupBy("pair").agg(F.count(F.lit(1)).alias("_n"))
    g = b.where("timeframe = '1h'").select("pair", "ts").join(slow, ["pair", "ts"]).groupBy("pair").agg(F.count(F.lit(1)).alias("shared"))
    return rounded(g.join(n, "pair").select("pair", "shared", (F.col("shared") / F.col("_n")).alias("ratio")))


