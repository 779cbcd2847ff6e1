"""First later bar at or beyond one of two prices, through an index of lows and highs.

Bars of a series are the lowest level of a tree in which a node holds the lowest low and the highest high of ``fanout`` nodes below it.
An entry looks behind itself among the nodes of its own parent; if none is reached, it goes on one level up, which passes over
``fanout`` times as many bars at a step. Where a node is reached it goes down again into that node's children. So an entry costs a few
looks at ``fanout`` nodes each however far the touch lies, and whole stretches of bars that stay between both prices are never read.
Each look is one grouped pass in which the nodes of one parent meet the entries that look there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.blocks import SERIES, number_rows
from barloom.session import cut_lineage

FANOUT = 1024
#: Entries that look at one node's children in one call; more are dealt over several calls.
SHARE = 65536


def _look(strict: bool):
    """For each entry the first of the nodes (behind its own one if ``strict``) whose range reaches a price."""

    def run(entries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        at, high, low = (nodes[c].to_numpy() for c in ("node", "node_high", "node_low"))
        out = entries.copy()
        found = np.full(len(entries), -1, np.int64)
        upper, lower = entries["upper"].to_numpy(float), entries["lower"].to_numpy(float)
        start = np.searchsorted(at, entries["at"].to_numpy(), side="right") if strict else np.zeros(len(entries), np.int64)
        for a in range(0, len(entries), 1024):
            part = slice(a, a + 1024)
            with np.errstate(invalid="ignore"):
                hit = (high[None, :] >= upper[part, None]) | (low[None, :] <= lower[part, None])
            hit &= np.arange(len(at))[None, :] >= start[part, None]
            any_ = hit.any(axis=1)
            found[part] = np.where(any_, at[hit.argmax(axis=1)] if len(at) else -1, -1)
        out["found"] = found
        return out

    return run


def first_touch(
    entries: DataFrame,
    bars: DataFrame,
    keys: Sequence[str] = SERIES,
    order: str = "ts",
    fanout: int = FANOUT,
) -> DataFrame:
    """``entries`` plus ``touch_ts``, ``touch_side`` and ``bars_held`` of the first later bar that reaches a price.

    ``entries`` has the keys, ``order`` (a bar's time), ``target`` and ``stop``; which of the two is above decides long or short, a null
    one is never reached. A bar that reaches both counts as ``stop``. Entries without a touch, and those whose time is no bar, keep nulls.
    """
    keys = list(keys)
    cols = entries.columns
    numbered = cut_lineage(number_rows(bars.select(*keys, order, "high", "low"), keys, order).withColumn("node", F.col("_rn") - 1).drop("_rn"))
    both = entries.withColumn("_id", F.monotonically_increasing_id()).join(numbered.select(*keys, order, F.col("node").alias("_own")), [*keys, order], "left")
    long = F.coalesce(F.col("target") >= F.col("stop"), F.col("stop").isNull())
    both = cut_lineage(both.withColumns({
        "upper": F.coalesce(F.when(long, F.col("target")).otherwise(F.col("stop")), F.lit(float("inf"))).cast("double"),
        "lower": F.coalesce(F.when(long, F.col("stop")).otherwise(F.col("target")), F.lit(float("-inf"))).cast("double"), "_long": long}))

    level = numbered.select(*keys, "node", F.col("high").cast("double").alias("node_high"), F.col("low").cast("double").alias("node_low"))
    levels, size = [level], numbered.agg(F.max("node")).first()[0] or 0
    while size >= fanout:
        up = levels[-1].groupBy(*keys, F.floor(F.col("node") / fanout).alias("parent")).agg(F.max("node_high").alias("node_high"), F.min("node_low").alias("node_low"))
        levels.append(cut_lineage(up.withColumnRenamed("parent", "node")))
        size //= fanout

    look = T.StructType([*(numbered.schema[k] for k in keys), T.StructField("_id", T.LongType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()),
                         T.StructField("at", T.LongType()), T.StructField("_parent", T.LongType()), T.StructField("_share", T.LongType()), T.StructField("found", T.LongType())])

    def looked(asking: DataFrame, nodes: DataFrame, strict: bool) -> DataFrame:
        group = [*keys, "_parent", "_share"]
        rows = asking.withColumn("_parent", F.floor(F.col("at") / fanout) if strict else F.col("at"))
        # a node that more entries than one call should hold ask is handed to several calls
        asked = rows.groupBy(*keys, "_parent").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("_calls"))
        rows = rows.join(asked, [*keys, "_parent"]).withColumn("_share", F.pmod(F.xxhash64("_id"), F.col("_calls"))).drop("_calls")
        below = nodes.withColumn("_parent", F.floor(F.col("node") / fanout)).join(asked, [*keys, "_parent"])
        below = below.withColumn("_share", F.explode(F.expr("sequence(0L, _calls - 1)"))).drop("_calls")
        below = below.select(*[F.col(c).alias(c) for c in below.columns])
        picked = rows.select(*keys, "_id", "upper", "lower", "at", "_parent", "_share")
        return cut_lineage(picked.groupBy(*group).cogroup(below.groupBy(*group)).applyInPandas(_look(strict), look)).drop("_parent", "_share")

    asking = both.where("_own is not null").select(*keys, "_id", "upper", "lower", F.col("_own").alias("at"))
    reached: list[DataFrame] = []
    for nodes in levels:
        seen = looked(asking, nodes, True)
        reached.append(seen.where("found >= 0"))
        asking = seen.where("found < 0").select(*keys, "_id", "upper", "lower", F.floor(F.col("at") / fanout).cast("long").alias("at"))
    for k in range(len(levels) - 1, 0, -1):
        down = looked(reached[k].select(*keys, "_id", "upper", "lower", F.col("found").alias("at")), levels[k - 1], False)
        reached[k - 1] = reached[k - 1].unionByName(down)
    hits = reached[0].select(*keys, "_id", F.col("found").alias("node")).join(numbered.withColumnRenamed(order, "touch_ts"), [*keys, "node"])
    out = both.join(hits.select("_id", "node", "touch_ts", "high", "low"), "_id", "left")
    stopped = F.when(F.col("_long"), F.col("low") <= F.col("lower")).otherwise(F.col("high") >= F.col("upper"))
    side = F.when(F.col("touch_ts").isNotNull(), F.when(stopped, "stop").otherwise("target"))
    return out.select(*cols, "touch_ts", side.alias("touch_side"), (F.col("node") - F.col("_own")).alias("bars_held"))
