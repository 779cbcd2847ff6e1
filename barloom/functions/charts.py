"""Chart patterns: peak-based ones over a peaks-only table, frame-based ones per bar."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import diff, div, flag, lag, lead, pct, rmax, rmin, rstd, sma
from barloom.functions.registry import native, table
from barloom.operators.blocks import BLOCK_ROWS, SERIES, bw, carry, core_rows, number_rows, to_blocks
from barloom.session import cut_lineage

G = "chart"
DISTANCE = 5
# Price tolerances of tops and bottoms, and of the shoulders.
TOL_TOPS, TOL_SHOULDERS = 0.02, 0.03


KINDED = (*SERIES, "kind")


def local_extrema(bars: DataFrame, price: str = "close", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Local maxima and minima, plateaus placed at their middle row; a plateau may be of any length.

    The last row of a run of equal prices sees the next price one step on; where the run began and the
    price before it are carried forward, across blocks if need be.
    """
    b = to_blocks(bars.select(*SERIES, "ts", F.col(price).alias("price")), 16, 1, block_rows=block_rows)
    chg = lag("price").isNull() | (F.col("price") != lag("price"))
    b = b.withColumns({"_chg": chg, "_prev": lag("price"), "_after": lead("price")})
    b = carry(b, 16, lasts={
        "_begin": F.when(F.col("_chg"), F.struct(F.col("_rn").alias("rn"), F.col("_prev").alias("v")))},
        block_rows=block_rows)
    v, p, n = F.col("price"), F.col("_begin")["v"], F.col("_after")
    kind = F.when((v > p) & (v > n), "peak").when((v < p) & (v < n), "trough")
    ends = b.where("_core").withColumn("kind", kind).where("kind is not null")
    pos = F.floor((F.col("_begin")["rn"] + F.col("_rn")) / 2)
    mid = ends.select(*KINDED, pos.alias("pos"), "price", F.col("_rn").alias("_end"), F.col("ts").alias("_ts"))
    # Only plateaus sit elsewhere than at their last row and need their timestamp looked up.
    flat = mid.where("pos <> _end").drop("_ts").join(
        b.where("_core").select(*SERIES, F.col("_rn").alias("pos"), "ts"), [*SERIES, "pos"])
    return mid.where("pos = _end").withColumnRenamed("_ts", "ts").unionByName(flat).drop("_end")


def _thin(distance: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Keep the tallest, drop anything nearer than ``distance``; unsure where the frame edge could decide."""
        pdf = pdf.sort_values("_rn", ignore_index=True)
        sign = 1.0 if pdf["kind"].iat[0] == "peak" else -1.0
        pos, h = pdf["pos"].to_numpy(), sign * pdf["price"].to_numpy()
        n = len(pdf)
        status = np.zeros(n, dtype=np.int8)  # 0 open, 1 kept, 2 dropped, 3 unsure
        left_open, right_open = bool(pdf["_more_left"].iat[0]), bool(pdf["_more_right"].iat[0])
        for i in np.lexsort((-pos, -h)):
            if status[i] == 2:
                continue
            near = [j for d in (-1, 1) for j in _near(pos, i, d, distance, n)]
            edge = (left_open and pos[i] - pos[0] < distance) or (right_open and pos[-1] - pos[i] < distance)
            if status[i] == 3 or edge or any(status[j] == 3 for j in near if (h[j], pos[j]) > (h[i], pos[i])):
                status[i] = 3
                for j in near:
                    if status[j] == 0:
                        status[j] = 3
                continue
            status[i] = 1
            for j in near:
                if (h[j], pos[j]) < (h[i], pos[i]):
                    status[j] = 2
        pdf["_status"] = status.astype("int32")
        return pdf[pdf["_core"]].drop(columns=["_more_left", "_more_right"])

    return run


def _near(pos, i, step, distance, n):
    j = i + step
    while 0 <= j < n and abs(pos[j] - pos[i]) < distance:
        yield j
        j += step


def spaced_extrema(bars: DataFrame, price: str = "close", distance: int = DISTANCE,
                   block_rows: int = BLOCK_ROWS, margin: int = 256) -> DataFrame:
    """Extrema of a kind at least ``distance`` rows apart, tallest first (the later of equals wins).

    A decision depends only on taller neighbours, so a block with a margin decides nearly all of them for
    sure. Should a chain of ever taller neighbours run past the margin, the margin is doubled and the
    thinning repeated until no row is unsure.
    """
    cand = number_rows(cut_lineage(local_extrema(bars, price, block_rows)), KINDED)
    last = cand.groupBy(*KINDED).agg(F.max("_rn").alias("_n"))
    while True:
        rows = max(block_rows, margin)
        b = to_blocks(cand, margin, margin, KINDED, block_rows=rows).join(last, list(KINDED))
        b = b.withColumn("_more_left", F.col("_blk") * rows + 1 - margin > 1).withColumn(
            "_more_right", (F.col("_blk") + 1) * rows + margin < F.col("_n")).drop("_n")
        schema = T.StructType([f for f in b.schema.fields if f.name not in ("_more_left", "_more_right")]
                              + [T.StructField("_status", T.IntegerType())])
        out = cut_lineage(b.groupBy(*KINDED, "_blk").applyInPandas(_thin(distance), schema))
        if out.where("_status = 3").isEmpty():
            break
        margin *= 2
    return out.where("_status = 1").select(*KINDED, "ts", "pos", "price")


def _peak_flags(points: DataFrame, block_rows: int) -> DataFrame:
    p = to_blocks(number_rows(points, KINDED), 2, keys=KINDED, block_rows=block_rows)
    w = bw(KINDED)
    p1, p2, v = F.lag("price").over(w), F.lag("price", 2).over(w), F.col("price")
    tiny = F.lit(1e-12)
    double = F.abs(p1 - v) / F.greatest(p1, tiny) <= TOL_TOPS
    spread = F.greatest(p2, p1, v) - F.least(p2, p1, v)
    triple = p2.isNotNull() & (spread / F.greatest((p2 + p1 + v) / 3, tiny) <= TOL_TOPS)
    top = F.col("kind") == "peak"
    head = (top & (p1 > p2) & (p1 > v)) | (~top & (p1 < p2) & (p1 < v))
    shoulders = head & (F.abs(p2 - v) / F.greatest(F.abs(p1), tiny) <= TOL_SHOULDERS)
    out = core_rows(p.withColumns({"_d": flag(double), "_t": flag(triple), "_s": flag(shoulders), "_top": top}))
    names = {n: F.max(F.when(F.col("_top") == up, F.col(c)).otherwise(0)).alias(n)
             for up, group in ((True, PEAK_PATTERNS), (False, TROUGH_PATTERNS)) for n, c in zip(group, ("_d", "_t", "_s"))}
    return out.groupBy(*SERIES, "ts").agg(*names.values())


PEAK_PATTERNS = ("pattern_double_top", "pattern_triple_top", "pattern_head_and_shoulders")
TROUGH_PATTERNS = ("pattern_double_bottom", "pattern_triple_bottom", "pattern_inverse_head_and_shoulders")


def peak_pattern_table(bars: DataFrame, block_rows: int) -> DataFrame:
    keys = [*SERIES, "ts"]
    flags = _peak_flags(spaced_extrema(bars, block_rows=block_rows), block_rows)
    return bars.select(*keys).join(flags, keys, "left").na.fill(0, [*PEAK_PATTERNS, *TROUGH_PATTERNS])


table([*PEAK_PATTERNS, *TROUGH_PATTERNS], peak_pattern_table, G)

LOOK, LOOK_WEDGE, LOOK_CUP = 20, 30, 50
native("_ret20", ["close"], lambda: pct("close", LOOK), back=LOOK)
native("_mean20c", ["close"], lambda: sma("close", LOOK), back=LOOK)
native("_tight", ["close", "_mean20c"], lambda: rstd("close", LOOK) < F.col("_mean20c") * 0.02, back=LOOK)
native("_width20", ["high", "low"], lambda: rmax("high", LOOK) - rmin("low", LOOK), back=LOOK)
native("_width20_d", ["_width20"], lambda: diff("_width20"), back=1)
native("_narrowing20", ["_width20_d"], lambda: sma("_width20_d", 3) < 0, back=3)
native("pattern_bullish_flag", ["_ret20", "_tight"], lambda: flag((F.col("_ret20") > 0.08) & F.col("_tight")), group=G)
native("pattern_bearish_flag", ["_ret20", "_tight"], lambda: flag((F.col("_ret20") < -0.08) & F.col("_tight")), group=G)
native("pattern_bullish_pennant", ["_ret20", "_narrowing20"], lambda: flag((F.col("_ret20") > 0.08) & F.col("_narrowing20")), group=G)
native("pattern_bearish_pennant", ["_ret20", "_narrowing20"], lambda: flag((F.col("_ret20") < -0.08) & F.col("_narrowing20")), group=G)
native("pattern_rectangle", ["_width20", "_mean20c"], lambda: flag(div("_width20", "_mean20c") < 0.02), group=G)

for _s in ("high", "low"):
    native(f"_max30_{_s}", [_s], lambda s=_s: rmax(s, LOOK_WEDGE), back=LOOK_WEDGE)
    native(f"_min30_{_s}", [_s], lambda s=_s: rmin(s, LOOK_WEDGE), back=LOOK_WEDGE)
    native(f"_span30_{_s}_d", [f"_max30_{_s}", f"_min30_{_s}"],
           lambda s=_s: diff(F.col(f"_max30_{s}") - F.col(f"_min30_{s}")), back=1)
    native(f"_span30_{_s}_t", [f"_span30_{_s}_d"], lambda s=_s: sma(f"_span30_{s}_d", 3), back=3)
native("pattern_triangle", ["_span30_high_t", "_span30_low_t"],
       lambda: flag((F.col("_span30_high_t") < 0) & (F.col("_span30_low_t") != 0)), group=G)
native("_width30_d", ["_max30_high", "_min30_low"], lambda: diff(F.col("_max30_high") - F.col("_min30_low")), back=1)
native("_narrowing30", ["_width30_d"], lambda: sma("_width30_d", 3) < 0, back=3)
native("pattern_falling_wedge", ["_max30_high", "_min30_low", "_narrowing30"],
       lambda: flag((diff("_max30_high") < 0) & (diff("_min30_low") < 0) & F.col("_narrowing30")), back=1, group=G)
native("pattern_rising_wedge", ["_max30_high", "_min30_low", "_narrowing30"],
       lambda: flag((diff("_max30_high") > 0) & (diff("_min30_low") > 0) & F.col("_narrowing30")), back=1, group=G)
native("_max50c", ["close"], lambda: rmax("close", LOOK_CUP), back=LOOK_CUP)
native("_min50c", ["close"], lambda: rmin("close", LOOK_CUP), back=LOOK_CUP)
native("pattern_cup_and_handle", ["close", "_max50c", "_min50c"],
       lambda: flag(div(F.col("_max50c") - F.col("_min50c"), "_max50c").between(0.12, 0.5)
                    & (F.col("close") > F.col("_max50c") * 0.95) & (F.col("close") < lag("close", 10))), back=10, group=G)
native("pattern_inverted_cup_and_handle", ["close", "_max50c", "_min50c"],
       lambda: flag(div(F.col("_max50c") - F.col("_min50c"), "_min50c").between(0.12, 0.5)
                    & (F.col("close") < F.col("_min50c") * 1.05) & (F.col("close") > lag("close", 10))), back=10, group=G)
FRAME_PATTERNS = (
    "pattern_bullish_flag", "pattern_bearish_flag", "pattern_bullish_pennant", "pattern_bearish_pennant", "pattern_rectangle",
    "pattern_triangle", "pattern_falling_wedge", "pattern_rising_wedge", "pattern_cup_and_handle", "pattern_inverted_cup_and_handle",
)
CHARTS = (*PEAK_PATTERNS, *TROUGH_PATTERNS, *FRAME_PATTERNS)
