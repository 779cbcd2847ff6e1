"""Strategy reports as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_strategies(pool: DataFrame, win: str = "win_rate", n: str = "sample_size", tie: Sequence[str] = (), top: int = 20, min_n: int = 50) -> DataFrame:
    """Best by win rate; of strategies with the same rounded win rate and sample size one stays."""
    w = Window.partitionBy(F.round(win, 4), n).orderBy(*tie)
    return pool.where(F.col(n) >= min_n).withColumn("_d", F.row_number().over(w)).where("_d = 1").drop("_d").orderBy(
        F.desc(win), F.desc(n), *tie).limit(top)


def top_per_type(pool: DataFrame, by: str, score: str, top: int, tie: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), *tie)
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def by_type(pool: DataFrame, by: str, win: str, n: str) -> DataFrame:
    return pool.groupBy(by).agg(F.count(F.lit(1)).alias("strategies"), F.avg(win).alias("avg_accuracy"), F.sum(n).alias("total_samples"))


def summary(pool: DataFrame, names: Sequence[str], win: str, n: str, min_win: float = 0.01) -> DataFrame:
    """One line per strategy; the first known name column labels it."""
    label = F.coalesce(*[F.col(c) for c in names])
    text = F.format_string("%s: %.2f%% over %d", label, F.col(win) * 100, F.col(n).cast("long"))
    return pool.where(F.col(win) >= min_win).select(label.alias("name"), F.col(win), F.col(n), text.alias("line")).orderBy(F.desc(win), "name")


def live_monitor(pool: DataFrame, win: str, n: str, tie: Sequence[str], min_win: float = 0.6, min_n: int = 20, rows: int = 30) -> DataFrame:
    best = pool.where((F.col(win) >= min_win) & (F.col(n) >= min_n)).orderBy(F.desc(win), *tie).limit(rows)
    return best.withColumn("config_json", F.to_json(F.struct(*[F.col(c) for c in pool.columns])))


# Timeframes from the one looked at first, and the states in which an order still stands.
TIMEFRAME_PRIORITY = {"4h": 1, "1h": 2, "15m": 3, "5m": 4, "1m": 5}
ACTIVE = ("PENDING", "SUBMITTED", "OPEN")


def plan_candidates(pool: DataFrame, win: str, tie: Sequence[str], min_win: float = 0.55, rows: int = 30) -> DataFrame:
    """The strategies worth a stop and target plan: the best ``rows`` of those that win often enough."""
    return pool.where(F.col(win) >= min_win).orderBy(F.desc(win), *tie).limit(rows)


def by_timeframe_priority(df: DataFrame, timeframe: str = "timeframe", then: Sequence[str] = ()) -> DataFrame:
    """Rows from slow to fast timeframes with their ``priority``; unknown timeframes come last (999)."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in TIMEFRAME_PRIORITY.items() for x in kv])[F.col(timeframe)], F.lit(999))
    return df.withColumn("priority", rank).orderBy("priority", *then)


def order_side(direction: Column) -> Column:
    """A long direction buys, anything else sells."""
    return F.when(direction.isin("long", "bullish"), "buy").otherwise("sell")


def active_orders(orders: DataFrame, status: str = "status") -> DataFrame:
    return orders.where(F.upper(status).isin(*ACTIVE))


def robust_rank(pool: DataFrame, score: str, robustness: str) -> DataFrame:
    return pool.withColumn("weighted", F.col(score) * F.col(robustness)).orderBy(F.desc("weighted"))


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a win rate."""
    p = F.try_divide(wins, n)
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half
