"""Streaming queries, run over the events file until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.session import scratch

from barloom.catalog.base import bars, bars_cte, query, roll, rounded
from barloom.catalog.indicators import B, step
from barloom.sources.bars import BAR_SCHEMA
from barloom.streaming import ticks as T

SEL = ", ".join(f"round({c}, 6) AS {c}" for c in ("open", "high", "low", "close", "volume"))


def drained(spark, stream):
    root = scratch(spark, "barloom-stream")
    T.to_files(stream, f"{root}/out", f"{root}/ckpt")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


query("str1_unique_ticks", "SELECT event_type AS pair, ts, event_id AS tick_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty FROM events")(
    lambda spark, sf: drained(spark, T.unique_ticks(T.tick_stream(spark, sf))))
query("str2_tumbling_bars", f"WITH {bars_cte('1h')} SELECT pair, timeframe, ts, {SEL} FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")(
    lambda spark, sf: rounded(drained(spark, T.stream_bars(T.tick_stream(spark, sf), "1h"))))
query("str2_sliding_bars")(lambda spark, sf: rounded(drained(spark, T.stream_bars(T.tick_stream(spark, sf), "1h", slide="30 minutes"))))
query("str6_sessions")(lambda spark, sf: drained(spark, T.sessions(T.tick_stream(spark, sf))))


def bar_files(spark, sf):
    """Bars landed as ordered files, one per fifth of the month, read back as a stream."""
    root = scratch(spark, "barloom-bars")
    b = bars(spark, sf).select([f.name for f in BAR_SCHEMA])
    b.repartition(8, F.floor(F.dayofmonth("ts") / 6)).sortWithinPartitions("ts").write.parquet(f"{root}/bars")
    return spark.readStream.schema(BAR_SCHEMA).parquet(f"{root}/bars")


query("str4_rule_signals", f"WITH {B}, {step('q', {'m': roll('avg', 'close', 50, True)})} SELECT pair, timeframe, ts, round(close, 6) AS close, round(m + 1e-9, 6) AS mean, CASE WHEN close > m THEN 'BULLISH' WHEN close < m THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal FROM q")(
    lambda spark, sf: rounded(drained(spark, T.stream_signals(bar_files(spark, sf))).withColumn("mean", F.col("mean") + 1e-9)))
query("str5_stop_monitor")(lambda spark, sf: rounded(drained(spark, T.stream_stops(bar_files(spark, sf)))))
query("str6_segments")(lambda spark, sf: drained(spark, T.stream_segments(bar_files(spark, sf))))


@query("str3_feature_updates", f"WITH {B}, {step('q', {'m': roll('avg', 'close', 20)})} SELECT pair, timeframe, ts, round(close, 6) AS close, round(m, 6) AS sma_20 FROM q")
def _features(spark, sf):
    root = scratch(spark, "barloom-feat")
    T.update_features(bar_files(spark, sf), f"{root}/bars", f"{root}/features", ["sma_20"], f"{root}/ckpt")
    return rounded(spark.read.parquet(f"{root}/features").select("pair", "timeframe", "ts", "close", "sma_20"))
