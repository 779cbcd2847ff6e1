"""Bar and feature tables as partitioned Parquet: scans, watermarks, keyed upserts, schema growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from barloom.operators.blocks import SERIES
from barloom.session import cut_lineage

KEYS = (*SERIES, "ts")


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:
        return None


def sanitise(df: DataFrame) -> DataFrame:
    """Dots become underscores and names lower case; of repeated names the last column stays."""
    names = [c.replace(".", "_").lower() for c in df.columns]
    keep = {n: i for i, n in enumerate(names)}
    tmp = df.toDF(*[f"_{i}" for i in range(len(names))])
    return tmp.select(*[F.col(f"_{i}").alias(n) for n, i in sorted(keep.items(), key=lambda kv: kv[1])])


def scan(bars: DataFrame, pair: str | None = None, timeframe: str | None = None, last: int | None = None) -> DataFrame:
    """Rows of a series, or of every series, optionally only the newest ``last`` of each.

    Partition columns prune the read; the newest rows are chosen with a per-partition limit before the shuffle.
    """
    out = bars
    if pair is not None:
        out = out.where(F.col("pair") == pair)
    if timeframe is not None:
        out = out.where(F.col("timeframe") == timeframe)
    if last is not None:
        w = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
        out = out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last).drop("_k")
    return out


def watermarks(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SERIES).agg(F.max("ts").alias("last_ts"))


def newer_than_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    marks = watermarks(stored)
    return new.join(marks, list(SERIES), "left").where(F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))).drop("last_ts")


def backfill_plan(pairs: DataFrame, timeframes: Sequence[str], stored: DataFrame, now, days: int = 365) -> DataFrame:
    """Start of the next pull per pair and timeframe: one second past the stored end, else ``days`` back."""
    tasks = pairs.select("pair").distinct().withColumn("timeframe", F.explode(F.array(*[F.lit(t) for t in timeframes])))
    start = F.coalesce(F.timestamp_seconds(F.unix_seconds("last_ts") + 1), F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))
    return tasks.join(watermarks(stored), list(SERIES), "left").select(*SERIES, start.alias("start_ts"))


def insert_absent(new: DataFrame, stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet."""
    return new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def latest_wins(stored: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Whole-row replacement by key; columns only one side has are null on the other."""
    both = stored.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    payload = [c for c in both.columns if c not in (*keys, "_gen")]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*payload), "_gen").alias("_r")).select(*keys, "_r.*")


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str] = KEYS, partition_by: Sequence[str] = SERIES) -> None:
    """Merge into a Parquet table, rewriting only the partitions the new rows touch."""
    stored = read_table(spark, path)
    if stored is None:
        new.dropDuplicates(list(keys)).write.partitionBy(*partition_by).parquet(path)
        return
    touched = new.select(*partition_by).distinct()
    merged = latest_wins(stored.join(touched, list(partition_by), "left_semi"), new, keys)
    # The result is read from the partitions it replaces, so it is materialised before they are overwritten.
    cut_lineage(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def series_list(bars: DataFrame, having: str | None = None) -> DataFrame:
    return (bars if having is None else bars.where(F.col(having).isNotNull())).select(*SERIES).distinct()


def progress(features: DataFrame, probe: str = "rsi") -> DataFrame:
    """Raw and featured row counts per series, and what is left to compute."""
    return features.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("raw_rows"), F.count(probe).alias("featured_rows")).withColumn(
        "missing", F.col("raw_rows") - F.col("featured_rows"))


def newest_context(bars: DataFrame, new_rows: int, context: int = 1000) -> DataFrame:
    """The rows an update of the newest ``new_rows`` bars needs."""
    return scan(bars, last=context + new_rows)


def catch_up(bars: DataFrame, done: DataFrame, names: Sequence[str], min_rows: int = 0) -> DataFrame:
    """Features of the bars not yet featured, all series in one job.

    Per series only the context before its own watermark is read: the block halo needed by the features. Features whose
    value depends on the whole past (running totals, carried fills, state machines) are computed from the start of the
    series. Series shorter than ``min_rows`` are left out; by default none is.
    """
    from barloom.functions.registry import closure, compute, halo

    back, _ = halo(closure(names))
    sizes = bars.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    marks = watermarks(done)
    src = bars.join(sizes, list(SERIES)).join(marks, list(SERIES), "left")
    fresh = F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))
    whole_past = any(f.kind in ("total", "fill", "ring", "table") for f in closure(names).values())
    if not whole_past:
        w = Window.partitionBy(*SERIES).orderBy(F.desc("ts"))
        old = src.where(~fresh).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= back + 1).drop("_k")
        src = src.where(fresh).unionByName(old)
    out = compute(src.drop("_n", "last_ts"), names)
    return out.join(marks, list(SERIES), "left").where(F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))).drop("last_ts")
