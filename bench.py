"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from barloom.catalog import QUERIES
from barloom.session import local_session

HEADLINE = [
    "ma1_sma", "ma2_ema", "tr2_adx", "os1_rsi", "os2_connors_rsi", "vo1_bollinger", "vl1_obv", "cs1_16_candlesticks", "sw3_last_swings",
    "sw17_pullback_stage", "pa7_structure_break", "st2_bounded_oscillators", "jn1_asof_close", "dsc1_single_signals", "dsc3_mode_a", "rm2_segments",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
