"""Ticks and raw bar pages to typed, de-duplicated bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Window length of each timeframe label.
TIMEFRAME_INTERVAL = {
    "1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day",
}

BAR_SCHEMA = T.StructType(
    [T.StructField("pair", T.StringType()), T.StructField("timeframe", T.StringType()), T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Event rows as ticks: the event type is the pair, the value the price, ``props.k`` the quantity."""
    return events.select(
        F.col("event_type").alias("pair"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("tick_id"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
    )


def bar_aggregates(ts: str = "ts", tick_id: str = "tick_id", price: str = "price", qty: str = "qty") -> list[Column]:
    order = F.struct(F.col(ts), F.col(tick_id))
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(qty).alias("volume"),
    ]


def bars_from_ticks(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Tumbling OHLCV bars; partial aggregation happens before the shuffle, so a hot pair stays cheap."""
    return (
        ticks.groupBy("pair", F.window("ts", TIMEFRAME_INTERVAL[timeframe]).alias("w"))
        .agg(*bar_aggregates())
        .select("pair", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars from finer ones."""
    return (
        bars.groupBy("pair", F.window("ts", TIMEFRAME_INTERVAL[timeframe]).alias("w"))
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        )
        .select("pair", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("ts"),
                "open", "high", "low", "close", "volume")
    )


def event_bars(events: DataFrame, timeframes: Sequence[str] = ("1h",)) -> DataFrame:
    """Bars of several timeframes. The coarser ones are built from the finest, not from the ticks."""
    order = sorted(timeframes, key=lambda t: list(TIMEFRAME_INTERVAL).index(t))
    base = bars_from_ticks(ticks_from_events(events), order[0])
    out = base
    for tf in order[1:]:
        out = out.unionByName(resample(base, tf))
    return out


def split_pair_timeframe(df: DataFrame, col: str = "pair_tf") -> DataFrame:
    """``base_quote_tf`` to ``pair`` and ``timeframe``."""
    return df.withColumn("timeframe", F.substring_index(col, "_", -1)).withColumn(
        "pair", F.expr(f"substring({col}, 1, length({col}) - length(substring_index({col}, '_', -1)) - 1)")
    )


def normalise_klines(pages: DataFrame) -> DataFrame:
    """Landed kline pages ``(pair, timeframe, rows array<array<double>>)`` to bars.

    Position 0 is the epoch second, then open, high, low, close, volume. Rows without a positive
    timestamp are dropped; of repeated timestamps the one from the newest page (``page_no``) wins.
    """
    r = pages.select("pair", "timeframe", "page_no", F.posexplode("rows").alias("_i", "_r"))
    typed = r.select(
        "pair", "timeframe", "page_no", "_i",
        F.get("_r", F.lit(0)).cast("long").alias("epoch"),
        *[F.get("_r", F.lit(i + 1)).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))],
    ).where("epoch > 0")
    cols = ["open", "high", "low", "close", "volume"]
    newest = F.max_by(F.struct(*cols), F.struct("page_no", "_i")).alias("b")
    return typed.groupBy("pair", "timeframe", "epoch").agg(newest).select(
        "pair", "timeframe", F.timestamp_seconds("epoch").alias("ts"), "b.*"
    )
