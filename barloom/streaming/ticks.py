"""Tick streams to bars, features, rule signals, stops and gaps with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.bars import TIMEFRAME_INTERVAL, bar_aggregates, ticks_from_events
from barloom.sources.store import upsert


def tick_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", per_trigger: int | None = None) -> DataFrame:
    """Ticks from files landing in a folder; repeated tick ids within the watermark are dropped once."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return ticks_from_events(reader.parquet(folder))


def unique_ticks(ticks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tick_id"])


def stream_bars(ticks: DataFrame, timeframe: str, delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) bars, emitted once the watermark has passed their end; later ticks are dropped."""
    w = F.window("ts", TIMEFRAME_INTERVAL[timeframe], slide) if slide else F.window("ts", TIMEFRAME_INTERVAL[timeframe])
    return (
        ticks.withWatermark("ts", delay).groupBy("pair", w.alias("w")).agg(*bar_aggregates())
        .select("pair", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sessions(ticks: DataFrame, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Spans without a pause longer than ``gap``; what lies between two spans is a data gap."""
    return (
        ticks.withWatermark("ts", delay).groupBy("pair", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("ticks"))
        .select("pair", F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), "ticks")
    )


def to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def update_features(bars: DataFrame, bar_table: str, feature_table: str, names: Sequence[str], checkpoint: str):
    """Each micro-batch merges its bars, then computes features of the new rows from as much of the touched series as they need:
    the halo of the features, or the whole series where a value depends on all of the past."""
    from barloom.functions.registry import closure, compute, halo

    need = closure(names)
    context = None if any(f.kind in ("total", "fill", "ring", "table") for f in need.values()) else halo(need)[0] + 1

    def batch(df: DataFrame, _epoch: int) -> None:
        spark = df.sparkSession
        upsert(spark, bar_table, df)
        touched = df.groupBy("pair", "timeframe").agg(F.min("ts").alias("_from"), F.count(F.lit(1)).alias("_new"))
        stored = spark.read.parquet(bar_table).join(touched, ["pair", "timeframe"])
        stored = stored.select(*df.columns, "_from", "_new")
        from pyspark.sql import Window

        near = stored
        if context is not None:
            newer = stored.withColumn("_late", (F.col("ts") < F.col("_from")).cast("int"))
            w = Window.partitionBy("pair", "timeframe", "_late").orderBy(F.desc("ts"))
            near = newer.withColumn("_k", F.row_number().over(w)).where((F.col("_late") == 0) | (F.col("_k") <= context)).drop("_k", "_late")
        feats = compute(near.drop("_new", "_from"), names).join(touched, ["pair", "timeframe"]).where(F.col("ts") >= F.col("_from"))
        upsert(spark, feature_table, feats.select("pair", "timeframe", "ts", "close", *names))

    q = bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# ---- stateful operators: a bounded state per (pair, timeframe) ----
RULE_SCHEMA = "pair string, timeframe string, ts timestamp, close double, mean double, signal string"


def rolling_signal(window: int = 50):
    """Bar-at-a-time HIGH/LOW rule: close against the mean of its last ``window`` values."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else []
        for pdf in [pd.concat(list(batches))]:
            pdf = pdf.sort_values("ts")
            mean, sig = [], []
            for v in pdf["close"]:
                seen = [*seen, float(v)][-window:]
                m = sum(seen) / len(seen)
                mean.append(m)
                sig.append("BULLISH" if v > m else "BEARISH" if v < m else "NEUTRAL")
            state.update((seen,))
            yield pd.DataFrame({"pair": key[0], "timeframe": key[1], "ts": pdf["ts"], "close": pdf["close"], "mean": mean, "signal": sig})

    return run


def stream_signals(bars: DataFrame, window: int = 50) -> DataFrame:
    return bars.groupBy("pair", "timeframe").applyInPandasWithState(
        rolling_signal(window), RULE_SCHEMA, "seen array<double>", "append", GroupStateTimeout.NoTimeout)


STOP_SCHEMA = "pair string, timeframe string, ts timestamp, close double, stop double, hit boolean"


def stop_monitor(pct: float = 0.05):
    """Percent trailing stop of one long position per key; re-armed at the price after it is hit."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stop = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("ts")
        stops, hits = [], []
        for v in pdf["close"]:
            hit = stop is not None and v <= stop
            stop = v * (1 - pct) if hit or stop is None else max(stop, v * (1 - pct))
            stops.append(float(stop))
            hits.append(bool(hit))
        state.update((float(stop),))
        yield pd.DataFrame({"pair": key[0], "timeframe": key[1], "ts": pdf["ts"], "close": pdf["close"], "stop": stops, "hit": hits})

    return run


def stream_stops(bars: DataFrame, pct: float = 0.05) -> DataFrame:
    return bars.groupBy("pair", "timeframe").applyInPandasWithState(stop_monitor(pct), STOP_SCHEMA, "stop double", "append", GroupStateTimeout.NoTimeout)


SEGMENT_SCHEMA = "pair string, timeframe string, ts timestamp, seg_start timestamp, age long"


def segmenter(min_bars: int = 24, max_bars: int = 168, jump: float = 0.25, window: int = 20):
    """Incremental segmentation on the volatility trigger: the state is the last closes, the volatility and the segment age."""
    import numpy as np

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closes, vol, age, start = (list(state.get[0]), state.get[1], state.get[2], state.get[3]) if state.exists else ([], 0.0, -1, None)
        pdf = pd.concat(list(batches)).sort_values("ts")
        starts, ages = [], []
        for ts, c in zip(pdf["ts"], pdf["close"], strict=True):
            closes = [*closes, float(c)][-(window + 1):]
            new = 0.0
            if len(closes) == window + 1:
                x = np.asarray(closes)
                new = float(np.std(x[1:] / x[:-1] - 1, ddof=1))
            age += 1
            if start is None or (age >= min_bars and ((vol > 0 and abs(new - vol) / vol > jump) or age >= max_bars)):
                start, age = ts, 0
            vol = new
            starts.append(start)
            ages.append(age)
        state.update((closes, float(vol), int(age), pd.Timestamp(start).to_pydatetime()))
        yield pd.DataFrame({"pair": key[0], "timeframe": key[1], "ts": pdf["ts"], "seg_start": starts, "age": ages})

    return run


def stream_segments(bars: DataFrame, **kw) -> DataFrame:
    return bars.groupBy("pair", "timeframe").applyInPandasWithState(
        segmenter(**kw), SEGMENT_SCHEMA, "closes array<double>, vol double, age long, start timestamp", "append", GroupStateTimeout.NoTimeout)
