"""Blocked layout of ordered series.

A window partitioned by the series key alone puts a whole series into one task, which fails once a
single series holds a large share of the table. Everything here works on *blocks* instead: each series
is numbered, cut into runs of ``block_rows`` consecutive rows, and the rows near a cut are also handed
to the neighbouring block (a halo of ``back`` rows before and ``ahead`` rows after). Window expressions
run per ``(series, _blk)``; afterwards only core rows are kept. Frames that look back further than the
halo (running sums, forward fills) get their missing prefix from a table with one row per block.

Columns added: ``_rn`` row number in the series, ``_blk`` block, ``_i`` row index relative to the block
(1..block_rows for core rows, <= 0 in the back halo), ``_core`` true for rows the block owns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ("pair", "timeframe")
BLOCK_ROWS = 32768
INTERNAL = ("_rn", "_blk", "_core", "_i")

# Seconds per bar of the supported timeframes.
TIMEFRAME_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def timeframe_seconds(col: Column | str = "timeframe") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(60)
    for name, sec in TIMEFRAME_SECONDS.items():
        out = F.when(c == name, F.lit(sec)).otherwise(out)
    return out


def _bucket(df: DataFrame, keys: Sequence[str], order: str, bucket_rows: int) -> Column:
    """A coarse slot of the ordering column that holds at most ``bucket_rows`` regular-grid bars."""
    if dict(df.dtypes)[order].startswith("timestamp"):
        step = timeframe_seconds() if "timeframe" in keys else F.lit(60)
        return F.floor(F.unix_seconds(F.col(order)) / (step * F.lit(bucket_rows)))
    return F.floor(F.col(order) / F.lit(bucket_rows))


def number_rows(
    df: DataFrame, keys: Sequence[str] = SERIES, order: str = "ts", bucket_rows: int = 4096, ties: Sequence[str] = ()
) -> DataFrame:
    """Row number of each row in its series without sorting a whole series in one task.

    Rows are numbered inside coarse time slots; the slot counts (a table smaller by the slot size) are
    accumulated per series and added.
    """
    keys = list(keys)
    slotted = df.withColumn("_slot", _bucket(df, keys, order, bucket_rows))
    counts = slotted.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(order, *ties)
    return (
        slotted.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_slot"])
        .withColumn("_rn", F.col("_rn") + F.col("_off"))
        .drop("_slot", "_off")
    )


def to_blocks(
    df: DataFrame,
    back: int,
    ahead: int = 0,
    keys: Sequence[str] = SERIES,
    order: str = "ts",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the series and replicate halo rows; at most two copies of a row besides its own."""
    if max(back, ahead) > block_rows:
        raise ValueError(f"halo {back}/{ahead} does not fit blocks of {block_rows} rows")
    df = df if "_rn" in df.columns else number_rows(df, keys, order)
    pos = (F.col("_rn") - 1) % block_rows
    home = F.floor((F.col("_rn") - 1) / block_rows).cast("long")
    targets = F.array_compact(
        F.array(
            home,
            F.when(pos >= block_rows - back, home + 1),
            F.when((pos < ahead) & (home > 0), home - 1),
        )
    )
    return (
        df.withColumn("_blk", F.explode(targets))
        .withColumn("_i", F.col("_rn") - F.col("_blk") * block_rows)
        .withColumn("_core", F.col("_i").between(1, block_rows))
    )


def core_rows(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    return df.where("_core").drop(*[c for c in INTERNAL if c not in set(keep)])


def bw(keys: Sequence[str] = SERIES) -> WindowSpec:
    """Ordered window over one block."""
    return Window.partitionBy(*keys, "_blk").orderBy("_rn")


def trailing(n: int, keys: Sequence[str] = SERIES) -> WindowSpec:
    return bw(keys).rowsBetween(-(n - 1), 0)


def span(lo: int, hi: int, keys: Sequence[str] = SERIES) -> WindowSpec:
    return bw(keys).rowsBetween(lo, hi)


def running(keys: Sequence[str] = SERIES) -> WindowSpec:
    return bw(keys).rowsBetween(Window.unboundedPreceding, 0)


def carry(
    df: DataFrame,
    back: int,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    keys: Sequence[str] = SERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sums and forward fills since the start of the series, exact across blocks.

    ``sums``: output name -> increment. ``lasts``: output name -> value whose last non-null is wanted.
    The prefix of a block comes from one aggregated row per block. For sums it is the total of all
    earlier core rows less what the halo already added; for fills it is the last value among rows
    before the middle of the halo, from which point the block itself sees the events.
    """
    keys = list(keys)
    sums, lasts = dict(sums or {}), dict(lasts or {})
    in_back_halo = F.col("_i") <= 0
    seen = F.col("_core") & (F.col("_i") <= block_rows - back // 2)
    # Fills count an event in the nearer half of the halo here and in the prefix otherwise, so rows at the
    # very start of a frame, whose own look-back is cut short, decide nothing.
    src = df
    for name, expr in {**sums, **{n: F.when(F.col("_i") > -(back // 2), e) for n, e in lasts.items()}}.items():
        src = src.withColumn(f"_x_{name}", expr)

    aggs = []
    for name in sums:
        x = F.col(f"_x_{name}")
        aggs += [
            F.sum(F.when(F.col("_core"), x)).alias(f"_t_{name}"),
            F.sum(F.when(in_back_halo, x)).alias(f"_h_{name}"),
        ]
    for name in lasts:
        x = F.col(f"_x_{name}")
        pair = F.struct(F.col("_rn").alias("rn"), x.alias("v"))
        aggs += [
            F.max(F.when(F.col("_core") & x.isNotNull(), pair)).alias(f"_a_{name}"),
            F.max(F.when(seen & x.isNotNull(), pair)).alias(f"_g_{name}"),
        ]
    table = src.groupBy(*keys, "_blk").agg(*aggs)
    wb = Window.partitionBy(*keys).orderBy("_blk")
    cols = []
    for name in sums:
        before = F.sum(f"_t_{name}").over(wb.rowsBetween(Window.unboundedPreceding, -1))
        cols.append((F.coalesce(before, F.lit(0)) - F.coalesce(F.col(f"_h_{name}"), F.lit(0))).alias(f"_p_{name}"))
    for name in lasts:
        older = F.max(f"_a_{name}").over(wb.rowsBetween(Window.unboundedPreceding, -2))
        cols.append(F.coalesce(F.lag(f"_g_{name}").over(wb), older)["v"].alias(f"_p_{name}"))
    prefix = table.select(*keys, "_blk", *cols)

    out = src.join(prefix, [*keys, "_blk"], "left")
    w = running(keys)
    exprs = {n: F.sum(f"_x_{n}").over(w) for n in sums}
    exprs |= {n: F.last(f"_x_{n}", ignorenulls=True).over(w) for n in lasts}
    out = out.withColumns({f"_r_{n}": e for n, e in exprs.items()})
    final = {n: F.coalesce(F.col(f"_r_{n}"), F.lit(0)) + F.col(f"_p_{n}") for n in sums}
    final |= {n: F.coalesce(F.col(f"_r_{n}"), F.col(f"_p_{n}")) for n in lasts}
    return out.withColumns(final).drop(*[f"_{k}_{n}" for n in exprs for k in ("x", "r", "p")])
