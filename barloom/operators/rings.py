"""The last ``k`` events before each row, as an array that passes block edges.

A forward fill carries one value. A ring carries the last ``k``, newest first: the n-th newest at a row is what the (n-1)-th newest was
just before the newest event, so each place of the ring is one shift and one fill over the block's own order, with no frame that
grows with the distance between events. The ring a block begins with comes from a table with at most ``k`` events per block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.blocks import BLOCK_ROWS, SERIES, bw, running


def ring_carry(
    df: DataFrame,
    back: int,
    rings: Mapping[str, tuple[Column, Column]],
    k: int = 8,
    keys: Sequence[str] = SERIES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` plus, per name, the values of the last ``k`` rows where its event held, newest first.

    ``rings``: name -> (event, value). As in ``carry``, a block sees events in the nearer half of its halo itself and takes
    earlier ones from the prefix.
    """
    keys = list(keys)
    shift = back // 2
    src = df
    for name, (event, value) in rings.items():
        src = src.withColumn(f"_e_{name}", F.when(event, value))

    prefix = src.select(*keys, "_blk").distinct()
    for name in rings:
        e = f"_e_{name}"
        # the first block that no longer sees the event itself
        found = src.where(F.col("_core") & F.col(e).isNotNull()).select(*keys, "_rn", e).withColumn("_to", F.ceil((F.col("_rn") + shift) / block_rows))
        newest = found.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_to").orderBy(F.desc("_rn")))).where(F.col("_k") <= k)
        pairs = F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("o"), F.col(e).alias("v")))).alias("r")
        per = newest.groupBy(*keys, "_to").agg(pairs)
        older = F.flatten(F.collect_list("r").over(Window.partitionBy(*keys).orderBy("_to").rowsBetween(1 - k, 0)))
        rows = per.select(*keys, F.col("_to").alias("_blk"), F.slice(F.sort_array(older), 1, k).alias("r"), F.lit(0).alias("_ask"))
        asked = rows.unionByName(prefix.select(*keys, "_blk", F.lit(1).alias("_ask")), allowMissingColumns=True)
        seen = F.last("r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_blk", "_ask").rowsBetween(Window.unboundedPreceding, 0))
        ring = asked.withColumn("r", seen).where("_ask = 1").select(*keys, "_blk", F.transform("r", lambda x: x["v"]).alias(f"_p_{name}"))
        prefix = prefix.join(ring, [*keys, "_blk"], "left")

    out = src.join(prefix, [*keys, "_blk"], "left")
    out = out.withColumns({f"_e_{n}": F.when(F.col("_i") > -shift, F.col(f"_e_{n}")) for n in rings})
    w, held = running(keys), {}
    for j in range(k):
        if j:
            before = {f"_b_{n}": F.coalesce(F.lag(held[n][-1]).over(bw(keys)), F.get(f"_p_{n}", F.lit(j - 1))) for n in rings}
            out = out.withColumns(before)
        source = {n: F.col(f"_e_{n}") if j == 0 else F.when(F.col(f"_e_{n}").isNotNull(), F.col(f"_b_{n}")) for n in rings}
        out = out.withColumns({f"_x{j}_{n}": F.coalesce(F.last(source[n], ignorenulls=True).over(w), F.get(f"_p_{n}", F.lit(j))) for n in rings})
        for n in rings:
            held.setdefault(n, []).append(f"_x{j}_{n}")
    out = out.withColumns({n: F.array_compact(F.array(*held[n])) for n in rings})
    return out.drop(*[c for n in rings for c in (f"_e_{n}", f"_p_{n}", f"_b_{n}", *held[n])])
