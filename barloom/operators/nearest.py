"""Nearest-in-time join, earlier or later, as one union and two running picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = ("pair",),
    left_on: str = "ts",
    right_on: str = "ts",
    prefix: str = "r_",
    ties: Sequence[str] = (),
    slot_seconds: int = 4096 * 900,
) -> DataFrame:
    """Attach to each left row the right row with the smallest ``|right_on - left_on|``, and ``{prefix}distance`` in seconds.

    Equally far rows: the earlier one; of several at one time the last by ``ties``. Left rows without any right row of their key keep
    nulls. As in ``asof_join`` a time slot is the unit of work: inside it the newest earlier and the oldest later row are running
    picks over one sort; a row with none on a side takes the nearest slot's edge row from a table with one row per slot.
    """
    by = list(by)
    rcols = [c for c in right.columns if c not in by]
    payload = F.struct(F.col(right_on).alias("_at"), *[F.col(c).alias(c) for c in ties], F.struct(*rcols).alias("_v"))
    slot = F.floor(F.unix_seconds("_t") / slot_seconds)
    rows = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_probe"), payload.alias("_r"))
    probes = left.select(*by, F.col(left_on).alias("_t"), F.lit(1).alias("_probe"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    both = rows.unionByName(probes, allowMissingColumns=True).withColumn("_slot", slot)
    order = Window.partitionBy(*by, "_slot").orderBy("_t", "_probe", *[F.col("_r")[c] for c in ties])
    # backwards in time, a probe before the rows of its own time, so that the last row seen is the next one
    turned = Window.partitionBy(*by, "_slot").orderBy(F.desc("_t"), F.desc("_probe"), *[F.col("_r")[c] for c in ties])
    local = both.withColumns({f"_{n}": F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, w in (("before", order), ("after", turned))})
    local = local.where("_probe = 1").drop("_r")

    # the later of two equally near later rows is never wanted, but of several at its time the last by ties is
    edges = rows.withColumn("_slot", slot).groupBy(*by, "_slot").agg(F.max("_r").alias("_newest"), F.min("_t").alias("_first"))
    first = rows.withColumn("_slot", slot).join(edges.select(*by, "_slot", "_first"), [*by, "_slot"]).where(F.col("_t") == F.col("_first"))
    oldest = first.groupBy(*by, "_slot").agg(F.max("_r").alias("_oldest"))
    timeline = edges.drop("_first").join(oldest, [*by, "_slot"]).unionByName(local.select(*by, "_slot").distinct(), allowMissingColumns=True)
    timeline = timeline.groupBy(*by, "_slot").agg(F.first("_newest", True).alias("_newest"), F.first("_oldest", True).alias("_oldest"))
    slots = Window.partitionBy(*by).orderBy("_slot")
    around = timeline.select(
        *by, "_slot", F.last("_newest", ignorenulls=True).over(slots.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_oldest", ignorenulls=True).over(slots.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))

    out = local.join(around, [*by, "_slot"], "left").withColumns({"_b": F.coalesce("_before", "_earlier"), "_a": F.coalesce("_after", "_later")})
    far = lambda c: F.abs(F.unix_micros(F.col(c)["_at"]) - F.unix_micros("_t"))
    pick = F.when(F.col("_a").isNull() | (far("_b") <= far("_a")), F.col("_b")).otherwise(F.col("_a"))
    out = out.withColumn("_m", pick)
    return out.select("_l.*", *[F.col("_m")["_v"][c].alias(prefix + c) for c in rcols], (far("_m") / 1e6).alias(f"{prefix}distance"))
