"""Swing labels: which way price went between one pivot and the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.labels import SWING_PCT
from barloom.functions.registry import compute, native
from barloom.operators.asof import asof_join
from barloom.operators.blocks import BLOCK_ROWS, SERIES, core_rows, number_rows, span, to_blocks

K = 5
native("_ext_high", ["high"], lambda: F.col("high") == F.max("high").over(span(-K, K)), back=K, ahead=K)
native("_ext_low", ["low"], lambda: F.col("low") == F.min("low").over(span(-K, K)), back=K, ahead=K)


def swing_labels(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """2 where the next pivot is at least 2 % higher, 1 where 2 % lower, else 0; from a pivot up to the next."""
    f = compute(bars, ["_ext_high", "_ext_low"], block_rows)
    price = F.when(F.col("_ext_high"), F.col("high")).when(F.col("_ext_low"), F.col("low"))
    p = number_rows(f.where("_ext_high or _ext_low").select(*SERIES, "ts", price.alias("price")))
    b = to_blocks(p, 0, 1, block_rows=block_rows)
    move = F.try_divide(F.lead("price").over(Window.partitionBy(*SERIES, "_blk").orderBy("_rn")) - F.col("price"), F.col("price"))
    lab = F.when(move >= SWING_PCT, 2).when(move <= -SWING_PCT, 1).otherwise(0)
    pivots = core_rows(b.withColumn("label", lab)).select(*SERIES, "ts", "label")
    return asof_join(bars, pivots, list(SERIES), prefix="_p").withColumn("regime", F.coalesce("_plabel", F.lit(0))).drop("_plabel", "_pts")
