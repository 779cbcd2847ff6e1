"""Three timeframes of a pair side by side, one row per bar of the fastest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.labels import known_returns
from barloom.functions.states import state_table
from barloom.operators.asof import asof_join
from barloom.operators.blocks import BLOCK_ROWS, TIMEFRAME_SECONDS
from barloom.session import cut_lineage

# The timeframe triples (high, trading, low).
GROUPS = {"Group_1": ("15m", "5m", "1m"), "Group_2": ("1h", "15m", "5m"), "Group_3": ("4h", "1h", "15m")}
MINUTES = {k: v // 60 for k, v in TIMEFRAME_SECONDS.items() if k != "1d"}


def valid_group(htf: str, ttf: str, ltf: str) -> bool:
    a, b, c = (MINUTES.get(t, 0) for t in (htf, ttf, ltf))
    return a > b > c > 0


def align(low: DataFrame, high: DataFrame, high_tf: str, low_tf: str, prefix: str, at: str = "close",
          slot_rows: int = 4096) -> DataFrame:
    """Attach to each low bar the newest bar of a slower timeframe.

    ``at="close"`` uses a slow bar only once it has closed by the close of the low bar; ``at="open"``
    compares opening times, so the still running slow bar is seen.
    """
    shift = TIMEFRAME_SECONDS[high_tf] - TIMEFRAME_SECONDS[low_tf] if at == "close" else 0
    right = high.drop("timeframe").withColumn("_usable", F.timestamp_seconds(F.unix_seconds("ts") + shift))
    return asof_join(low, right, ["pair"], "ts", "_usable", prefix, slot_rows * TIMEFRAME_SECONDS[low_tf]).drop(f"{prefix}_usable")


def mtf_table(
    bars: DataFrame,
    timeframes: tuple[str, str, str],
    signals: Sequence[str],
    extra: Sequence[str] = (),
    label: str | None = "future_return_5",
    at: str = "close",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Columns ``h_*``, ``t_*``, ``l_*`` hold states and extras of each timeframe; ``future_return`` the label,
    unknown at a close of 0."""
    htf, ttf, ltf = timeframes
    cols = [*[f"state_{s}" for s in signals], *extra]

    # The states of all three timeframes are one table, written once and read three times.
    wide = known_returns(state_table(bars.where(F.col("timeframe").isin(*timeframes)), signals, block_rows, [*extra, *([label] if label else [])]))
    states = cut_lineage(wide.select("pair", "timeframe", "ts", "close", *cols, *([label] if label else [])))

    low = states.where(F.col("timeframe") == ltf)
    keep = [F.col("pair"), F.col("timeframe"), F.col("ts"), F.col("close"), *[F.col(c).alias(f"l_{c}") for c in cols]]
    if label:
        keep.append(F.col(label).alias("future_return"))
    out = low.select(*keep)
    for tf, p in ((ttf, "t_"), (htf, "h_")):
        side = states.where(F.col("timeframe") == tf).select("pair", "timeframe", "ts", "close", *cols)
        out = align(out, side, tf, ltf, p, at)
    return out


def last_bar(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("pair",)) -> DataFrame:
    """The newest row per key, picked by a partial aggregate."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*cols), "ts").alias("_x")).select(*by, "_x.*")


def cascade(h: Column, t: Column, low: Column) -> Column:
    """Momentum flow over three timeframes: direction, strength and score."""
    def row(flow, strength, score):
        return F.struct(F.lit(flow).alias("flow"), F.lit(strength).alias("strength"), F.lit(score).alias("score"))

    moving = h != "neutral"
    return (
        F.when(moving & (h == t) & (t == low), row("htf_to_ltf", "strong", 90))
        .when(moving & (h == t), row("htf_to_ltf", "moderate", 70))
        .when((t == low) & (t != "neutral") & ~moving, row("accelerating", "increasing", 75))
        .when(moving & (t != "neutral") & (h != t), row("reversal", "reversing", 65))
        .otherwise(row("mixed", "weak", 40))
    )


def simple_alignment(h: Column, t: Column, low: Column) -> Column:
    """Agreement of three trend directions (1, 0, -1)."""
    def row(q, s):
        return F.struct(F.lit(q).alias("quality"), F.lit(s).alias("score"))

    return (
        F.when((h != 0) & (h == t) & (t == low), row("excellent", 1.0))
        .when((h != 0) & ((h == t) | (h == low)), row("good", 0.6))
        .when((t != 0) & (t == low), row("poor", 0.3))
        .otherwise(row("conflicting", 0.0))
    )


def contexts(bars: DataFrame, timeframes: tuple[str, str, str], at: str = "close", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every low bar: regime contexts, volatility class, momentum cascade and trend agreement."""
    extra = ["momentum_direction", "volatility_class", "volatility_ratio", "is_trending", "is_ranging", "is_transition", "trend_structure"]
    df = mtf_table(bars, timeframes, [], extra, None, at, block_rows)
    up, down = ("strong_uptrend", "uptrend"), ("strong_downtrend", "downtrend")

    def direction(p):
        c = F.col(f"{p}trend_structure")
        return F.when(c.isin(*up), 1).when(c.isin(*down), -1).otherwise(0)

    def some(flag):
        return F.coalesce(F.col(f"h_{flag}"), F.lit(False)) | F.coalesce(F.col(f"t_{flag}"), F.lit(False)) | F.coalesce(F.col(f"l_{flag}"), F.lit(False))

    found = F.array_compact(F.array(
        F.when(some("is_trending"), F.lit("trending")), F.when(some("is_ranging"), F.lit("ranging")),
        F.when(some("is_transition"), F.lit("transition"))))
    neutral = lambda c: F.coalesce(F.col(c), F.lit("neutral"))
    df = df.withColumns({
        "regimes": F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("trending"), F.lit("ranging"), F.lit("transition"))),
        "_c": cascade(neutral("h_momentum_direction"), neutral("t_momentum_direction"), neutral("l_momentum_direction")),
        "_a": simple_alignment(direction("h_"), direction("t_"), direction("l_")),
    })
    return df.select(
        "pair", "timeframe", "ts", "regimes", F.col("l_volatility_class").alias("volatility_class"),
        F.col("l_volatility_ratio").alias("volatility_ratio"),
        neutral("h_momentum_direction").alias("htf_momentum"), neutral("t_momentum_direction").alias("ttf_momentum"),
        neutral("l_momentum_direction").alias("ltf_momentum"), F.col("_c.flow").alias("flow"), F.col("_c.strength").alias("flow_strength"),
        F.col("_c.score").alias("cascade_score"), F.col("_a.quality").alias("alignment_quality"), F.col("_a.score").alias("alignment_score"),
    )
