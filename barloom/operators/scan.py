"""Sequential state machines over long series, block by block, exact.

Each block first runs from a guess: the machine starts cold ``back`` rows before the block. The state it
reaches at the block edge is then compared with the state the previous block ended in. Where they differ
the block is run again from the true state, until every edge agrees. Machines that forget their start
(trailing stops, reversals, greedy cuts) agree almost everywhere on the first pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.blocks import BLOCK_ROWS, SERIES, to_blocks
from barloom.session import cut_lineage

Kernel = Callable[[pd.DataFrame, "list[float] | None"], "tuple[dict[str, np.ndarray], list[float]]"]


def _runner(kernel: Kernel, names: list[str], columns: list[str], seeded: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn", ignore_index=True)
        core = pdf[pdf["_core"]]
        if core.empty:
            return pd.DataFrame(columns=[*columns, *names, "_sin", "_sout"])
        if seeded:
            state = [float(v) for v in pdf["_seed"].iat[0]]
        else:
            lead_in = pdf[pdf["_i"] <= 0]
            state = kernel(lead_in, None)[1] if len(lead_in) else None
        outs, end = kernel(core.reset_index(drop=True), state)
        res = core[columns].reset_index(drop=True)
        for n in names:
            res[n] = outs[n]
        none: list = [None] * len(res)
        sin, sout = list(none), list(none)
        sin[-1], sout[-1] = state, [float(v) for v in end]
        res["_sin"], res["_sout"] = sin, sout
        return res

    return run


def block_scan(
    df: DataFrame,
    kernel: Kernel,
    outputs: dict[str, T.DataType],
    back: int = 256,
    keys: Sequence[str] = SERIES,
    order: str = "ts",
    block_rows: int = BLOCK_ROWS,
    tolerance: float = 1e-12,
) -> DataFrame:
    """``df`` plus ``outputs`` of ``kernel(rows, state) -> (outputs, state)`` run along each series."""
    keys = list(keys)
    data = [c for c in df.columns if c not in ("_blk", "_core", "_i")]
    framed = to_blocks(df, min(back, block_rows), keys=keys, order=order, block_rows=block_rows)
    columns = list(dict.fromkeys([*data, "_rn", "_blk", "_i", "_core"]))
    base = framed.select(*columns)
    state = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        base.schema.fields
        + [T.StructField(n, t) for n, t in outputs.items()]
        + [T.StructField("_sin", state), T.StructField("_sout", state)]
    )
    names = list(outputs)
    done = cut_lineage(base.groupBy(*keys, "_blk").applyInPandas(_runner(kernel, names, columns, False), schema))
    while True:
        edges = done.where("_sout is not null").select(*keys, "_blk", "_sin", "_sout")
        before = F.lag("_sout").over(Window.partitionBy(*keys).orderBy("_blk"))
        differs = F.exists(
            F.zip_with("_sin", "_seed", lambda a, b: ~(
                a.eqNullSafe(b) | F.coalesce(
                    F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1e-300)), F.lit(False)))),
            lambda x: x,
        )
        bad = edges.withColumn("_seed", before).where("_seed is not null").where(F.col("_sin").isNull() | differs)
        bad = bad.select(*keys, "_blk", "_seed")
        if bad.isEmpty():
            break
        again = done.select(*columns).join(bad, [*keys, "_blk"])
        redone = again.groupBy(*keys, "_blk").applyInPandas(_runner(kernel, names, columns, True), schema)
        done = cut_lineage(done.join(bad, [*keys, "_blk"], "left_anti").unionByName(redone))
    return done.select(*data, *names)
