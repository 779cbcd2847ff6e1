"""Backward as-of join as a union plus a carried forward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = ("pair",),
    left_on: str = "ts",
    right_on: str = "ts",
    prefix: str = "r_",
    slot_seconds: int = 4096 * 900,
) -> DataFrame:
    """Attach to each left row the newest right row with ``right_on <= left_on``.

    Both sides are cut into time slots, so a slot (not a whole key) is the unit of work. Inside a slot
    the newest right row is a running ``last``; a left row with none in its slot takes the newest row
    of an earlier slot from a table with one row per (key, slot).
    """
    by = list(by)
    rcols = [c for c in right.columns if c not in by]
    payload = F.struct(*[F.col(c) for c in rcols])
    rows = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_probe"), payload.alias("_r"))
    lpay = F.struct(*[F.col(c) for c in left.columns])
    probes = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_probe"), lpay.alias("_l"))
    slot = F.floor(F.unix_seconds("_t") / slot_seconds)

    both = rows.unionByName(probes, allowMissingColumns=True).withColumn("_slot", slot)
    w = (
        Window.partitionBy(*by, "_slot")
        .orderBy("_t", "_probe")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where("_probe = 1")

    newest = rows.withColumn("_slot", slot).groupBy(*by, "_slot").agg(F.max_by("_r", "_t").alias("_r"))
    slots = local.select(*by, "_slot").distinct()
    timeline = newest.unionByName(slots, allowMissingColumns=True).groupBy(*by, "_slot").agg(F.first("_r", True).alias("_r"))
    wb = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    earlier = timeline.select(*by, "_slot", F.last("_r", ignorenulls=True).over(wb).alias("_earlier"))

    hit = F.coalesce(F.col("_hit"), F.col("_earlier"))
    return (
        local.drop("_r").join(earlier, [*by, "_slot"], "left")
        .select("_l.*", hit.alias("_m"))
        .select(*left.columns, *[F.col("_m")[c].alias(prefix + c) for c in rcols])
    )
