import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import charts
from barloom.functions.machines import adjusting_kernel, sar_kernel
from barloom.functions.registry import REGISTRY, compute
from barloom.operators.asof import asof_join
from barloom.operators.blocks import number_rows
from barloom.operators.quantiles import grouped_quantiles
from barloom.operators.scan import block_scan
from barloom.plans.backtest import running_drawdown
from barloom.plans.instances import segments
from barloom.sources import store
from pyspark.sql import types as T

KEY = ["pair", "ts"]


def ordered(df, cols):
    return df.select("pair", "ts", *cols).toPandas().sort_values(KEY).reset_index(drop=True)


def test_row_numbers(bars):
    got = number_rows(bars, bucket_rows=64).toPandas().sort_values(KEY)
    assert (got["_rn"] == got.groupby("pair").cumcount() + 1).all()


SMALL = ["sma_20", "sma_50", "ema_12", "rsi", "macd_signal", "obv", "vwap", "last_swing_high", "bars_since_swing_low", "streak",
         "pa_level_high", "structure_break_bullish", "pattern_three_white_soldiers", "future_return_5", "state_swing_failure"]


def test_block_size_does_not_matter(bars):
    one, many = ordered(compute(bars, SMALL), SMALL), ordered(compute(bars, SMALL, block_rows=64), SMALL)
    pd.testing.assert_frame_equal(one, many, rtol=1e-9, atol=1e-9, check_dtype=False)


def test_no_feature_looks_ahead(bars):
    names = ["sma_50", "ema_26", "rsi", "atr", "obv", "kama", "last_swing_high", "pa_level_low", "pullback_stage", "trend_structure", "cci", "nvi"]
    cut = bars.where("ts < '2023-02-20'")
    full = ordered(compute(bars, names).where("ts < '2023-02-20'"), names)
    part = ordered(compute(cut, names), names)
    pd.testing.assert_frame_equal(full, part, rtol=1e-9, atol=1e-9, check_dtype=False)


def test_ewm_matches_pandas(bars, walks):
    got = ordered(compute(bars, ["ema_200"], block_rows=64), ["ema_200"])
    for pair, g in walks.groupby("pair"):
        want = g["close"].ewm(span=200, adjust=False, min_periods=200).mean().to_numpy()
        np.testing.assert_allclose(got[got.pair == pair]["ema_200"].to_numpy(), want, rtol=1e-12)


@pytest.mark.parametrize(("kernel", "col"), [(sar_kernel, "psar"), (adjusting_kernel, "mcginley")])
def test_sequential_scans_agree_across_blocks(bars, kernel, col):
    out = {col: T.DoubleType()}
    one = ordered(block_scan(bars, kernel, out), [col])
    many = ordered(block_scan(bars, kernel, out, back=16, block_rows=100), [col])
    np.testing.assert_allclose(one[col], many[col], rtol=1e-9)


def test_segments_agree_across_blocks(bars):
    f = compute(bars, ["seg_trigger"])
    a, b = segments(f), segments(f, block_rows=700)
    pd.testing.assert_frame_equal(ordered(a, ["seg_start"]), ordered(b, ["seg_start"]))


def brute_extrema(h, distance=5):
    runs, i = [], 0
    while i < len(h):
        j = i
        while j + 1 < len(h) and h[j + 1] == h[i]:
            j += 1
        runs.append((i, j))
        i = j + 1
    peaks = [(a + b) // 2 for (a, b), p, n in zip(runs[1:-1], runs[:-2], runs[2:]) if h[p[0]] < h[a] > h[n[0]]]
    keep = dict.fromkeys(peaks, True)
    for p in sorted(peaks, key=lambda q: (h[q], q), reverse=True):
        if keep[p]:
            for q in peaks:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    return [p for p in peaks if keep[p]]


def test_spaced_extrema_with_long_plateau(spark):
    r = np.random.default_rng(5)
    h = np.round(np.concatenate([r.normal(0, 1, 200), np.full(60, 9.0), r.normal(0, 1, 150)]), 1) + 20
    pdf = pd.DataFrame({"pair": "p", "timeframe": "1h", "ts": pd.date_range("2023-01-01", periods=len(h), freq="h"), "close": h})
    df = spark.createDataFrame(pdf)
    got = charts.spaced_extrema(df, block_rows=32, margin=4).where("kind = 'peak'").orderBy("pos").toPandas()["pos"].tolist()
    assert [g - 1 for g in got] == brute_extrema(h)


def test_quantiles_exact(bars, walks):
    got = grouped_quantiles(bars, ["pair"], ["close", "volume"], [0.05, 0.5, 0.9]).toPandas()
    for _, r in got.iterrows():
        assert r["value"] == pytest.approx(walks[walks.pair == r["pair"]][r["metric"]].quantile(r["prob"]))


def test_asof_matches_pandas(spark, bars, walks):
    right = walks[walks.index % 7 == 0][["pair", "ts", "volume"]].assign(ts=lambda d: d.ts + pd.Timedelta("20min"))
    got = asof_join(bars.select("pair", "ts", "close"), spark.createDataFrame(right), slot_seconds=36000).toPandas().sort_values(KEY).reset_index(drop=True)
    want = pd.merge_asof(walks.sort_values("ts"), right.rename(columns={"volume": "rv"}).sort_values("ts"), on="ts", by="pair").sort_values(KEY)
    np.testing.assert_allclose(got["r_volume"].to_numpy(float), want["rv"].to_numpy(float))


def test_running_drawdown_across_blocks(bars, walks):
    src = bars.withColumn("r", F.col("close") - 100)
    got = running_drawdown(src, "r", block_rows=50).toPandas().sort_values(KEY)
    for pair, g in walks.groupby("pair"):
        c = (g["close"] - 100).cumsum()
        np.testing.assert_allclose(got[got.pair == pair]["drawdown"], c - c.cummax(), atol=1e-6)


def test_upsert_replaces_and_grows(spark, bars, tmp_path):
    path = str(tmp_path / "t")
    store.upsert(spark, path, bars.select("pair", "timeframe", "ts", "close"))
    newer = bars.where("pair = 'cold'").select("pair", "timeframe", "ts", (F.col("close") * 0).alias("close"), F.lit(1).alias("extra"))
    store.upsert(spark, path, newer)
    got = store.read_table(spark, path)
    assert got.count() == bars.count()
    assert got.where("pair = 'cold' and close = 0 and extra = 1").count() == 200
    assert got.where("pair = 'hot' and extra is null").count() == 1800


def test_user_feature(bars):
    from barloom.functions.registry import native

    native("my_range", ["high", "low"], lambda: F.col("high") - F.col("low"))
    try:
        assert compute(bars, ["my_range"]).where("my_range < 0").count() == 0
    finally:
        REGISTRY.pop("my_range")


def test_catch_up_equals_a_full_compute(bars):
    from pyspark.sql import functions as F

    from barloom.functions.registry import compute
    from barloom.sources.store import catch_up

    names = ["psar", "mcginley", "obv", "vwap", "last_swing_high", "sma_20"]
    done = bars.where("ts < timestamp'2023-02-01'")
    key = ["pair", "timeframe", "ts"]
    new = catch_up(bars, done, names).select(*key, *[F.round(n, 6).alias(n) for n in names])
    full = compute(bars, names).join(done.groupBy("pair", "timeframe").agg(F.max("ts").alias("last")), ["pair", "timeframe"], "left").where(
        "last is null or ts > last").select(*key, *[F.round(n, 6).alias(n) for n in names])
    assert new.count() == full.count() > 0 and new.exceptAll(full).isEmpty()
