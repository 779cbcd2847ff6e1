"""Rings over block edges, nearest and first-touch joins, trend and pullback classes against plain Python."""

import numpy as np
import pandas as pd
import pytest

from barloom.functions.pullback_quality import PULLBACK_QUALITY
from barloom.functions.registry import compute
from barloom.functions.trend_class import TREND_CLASS
from barloom.operators.nearest import nearest_join
from barloom.operators.touch import first_touch
from barloom.plans import confluence, discovery
from barloom.plans.mtf import mtf_table
from barloom.plans.structure import structure_alignment, trend_synthesis
from tests.conftest import walk

KEY = ["pair", "ts"]
TF = ("4h", "1h", "15m")


def ordered(df, cols):
    return df.select("pair", "ts", *cols).toPandas().sort_values(KEY).reset_index(drop=True)


def test_rings_pass_block_edges(bars, walks):
    names = ["swing_high", "high_ring", "low_ring"]
    for block in (64, 32768):
        got = ordered(compute(bars, names, block_rows=block), names)
        for pair, g in got.groupby("pair"):
            high = walks[walks.pair == pair].sort_values("ts")["high"].to_numpy()
            seen = []
            for i, (flag, ring) in enumerate(zip(g["swing_high"], g["high_ring"])):
                if flag == 1:
                    seen.insert(0, high[i])
                assert [x["high"] for x in ring] == seen[:8]


def test_rare_events_stay_in_the_ring(spark):
    """A series with a swing every few hundred rows: the ring reaches back over many blocks."""
    n = 1500
    close = 100 + np.zeros(n)
    at = [50, 400, 401 + 300, 1100, 1400]
    close[at] += np.arange(1, len(at) + 1)
    pdf = pd.DataFrame({"pair": "flat", "timeframe": "1h", "ts": pd.date_range("2023-01-01", periods=n, freq="h"), "open": close, "high": close, "low": close - 1,
                        "close": close, "volume": 1.0})
    got = ordered(compute(spark.createDataFrame(pdf), ["high_ring"], block_rows=64), ["high_ring"])
    confirmed = [pdf["ts"][i + 2] for i in at]
    assert [pd.Timestamp(x["ts"]) for x in got["high_ring"].iloc[-1]] == confirmed[::-1]
    assert [pd.Timestamp(x["ts"]) for x in got["high_ring"].iloc[600]] == confirmed[1::-1] and len(got["high_ring"].iloc[51]) == 0


@pytest.mark.parametrize("names", [TREND_CLASS, [*PULLBACK_QUALITY, "pullback_overall_bearish"], ["swing_order", "pullbacks_so_far", "swing_strength"]])
def test_block_size_does_not_matter(bars, names):
    one, many = ordered(compute(bars, names), names), ordered(compute(bars, names, block_rows=64), names)
    pd.testing.assert_frame_equal(one, many, rtol=1e-9, atol=1e-9, check_dtype=False)
    assert one.drop(columns=KEY).nunique().max() > 2


@pytest.mark.parametrize("slot", [3600, 40_000, 10**9])
def test_nearest_join_equals_brute_force(spark, slot):
    r = np.random.default_rng(3)
    t0 = pd.Timestamp("2023-01-01")
    left = pd.DataFrame({"pair": r.choice(["a", "b", "lonely"], 200), "ts": t0 + pd.to_timedelta(r.integers(0, 100, 200) * 1800, unit="s"), "x": range(200)})
    right = pd.DataFrame({"pair": r.choice(["a", "b"], 60), "ts": t0 + pd.to_timedelta(r.integers(0, 100, 60) * 1800, unit="s"), "y": range(60)})
    got = nearest_join(spark.createDataFrame(left), spark.createDataFrame(right), ["pair"], ties=["y"], slot_seconds=slot).toPandas().set_index("x")
    for _, row in left.iterrows():
        mine = right[right.pair == row.pair]
        g = got.loc[row.x]
        if mine.empty:
            assert pd.isna(g.r_y) and pd.isna(g.r_distance)
            continue
        best = min(mine.itertuples(), key=lambda m: (abs(m.ts - row.ts), m.ts, -m.y))
        assert (int(g.r_y), g.r_distance) == (best.y, abs(best.ts - row.ts).total_seconds())
    none = nearest_join(spark.createDataFrame(left), spark.createDataFrame(right).limit(0), ["pair"]).toPandas()
    assert len(none) == 200 and none["r_y"].isna().all()


@pytest.mark.parametrize("fanout", [4, 32, 1024])
def test_first_touch_equals_brute_force(spark, fanout):
    r = np.random.default_rng(5)
    pdf = pd.concat([walk(900, "hot", 1), walk(60, "cold", 2), walk(1, "single", 3)], ignore_index=True)
    close = pdf["close"].to_numpy()
    wide = r.choice([0.5, 3.0, 12.0, 1e6], len(pdf))
    long = r.random(len(pdf)) < 0.5
    entries = pdf[["pair", "timeframe", "ts"]].assign(target=np.where(long, close + wide, close - wide), stop=np.where(long, close - 2 * wide, close + 2 * wide), k=range(len(pdf)))
    entries.loc[7, "stop"] = np.nan
    entries = pd.concat([entries, entries.iloc[:50].assign(k=range(10_000, 10_050)), entries.iloc[:1].assign(ts=pd.Timestamp("1999-01-01"), k=99_999)], ignore_index=True)
    frame = spark.createDataFrame(entries.astype(object).where(entries.notna(), None), "pair string, timeframe string, ts timestamp, target double, stop double, k long")
    got = first_touch(frame, spark.createDataFrame(pdf), fanout=fanout).toPandas().set_index("k")
    far = 0
    for row in entries.itertuples():
        g = got.loc[row.k]
        later = pdf[(pdf.pair == row.pair) & (pdf.ts > row.ts)].reset_index(drop=True)
        if row.ts not in set(pdf[pdf.pair == row.pair].ts):
            assert pd.isna(g.touch_ts)
            continue
        up = row.target >= row.stop or np.isnan(row.stop)
        hit = later[(later.high >= row.target) | (later.low <= row.stop)] if up else later[(later.low <= row.target) | (later.high >= row.stop)]
        if hit.empty:
            assert pd.isna(g.touch_ts) and pd.isna(g.touch_side) and pd.isna(g.bars_held)
            continue
        first = hit.iloc[0]
        stopped = first.low <= row.stop if up else first.high >= row.stop
        far += hit.index[0] >= 64
        assert (g.touch_ts, g.touch_side, int(g.bars_held)) == (first.ts, "stop" if stopped else "target", hit.index[0] + 1)
    assert far > 10


@pytest.fixture(scope="module")
def three(spark):
    """Fast walks and the slower bars they add up to."""
    fast = pd.concat([walk(1200, p, s, "15m") for p, s in (("a", 1), ("b", 2))], ignore_index=True)
    out = [fast]
    for tf, rule in (("1h", "1h"), ("4h", "4h")):
        g = fast.set_index("ts").groupby("pair").resample(rule)
        agg = g.agg({"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"}).reset_index()
        out.append(agg.assign(timeframe=tf)[fast.columns])
    return spark.createDataFrame(pd.concat(out, ignore_index=True)).cache()


def test_synthesis_and_alignment_do_not_depend_on_blocks(three):
    for plan in (trend_synthesis, structure_alignment):
        a, b = (plan(three, TF, block_rows=n).toPandas().sort_values(KEY).reset_index(drop=True) for n in (32768, 512))
        pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12, check_dtype=False)
        assert len(a) == 2400
    assert a["alignment_class"].nunique() > 2 and a["swing_score"].max() > 0


def test_synthesis_votes(three):
    got = trend_synthesis(three, TF).toPandas()
    order = ["strong_uptrend", "uptrend", "neutral", "downtrend", "strong_downtrend"]
    points = {"strong_uptrend": 2, "uptrend": 1, "neutral": 0, "downtrend": -1, "strong_downtrend": -1}
    for r in got.sample(200, random_state=1).itertuples():
        votes = dict.fromkeys(order, 0)
        for t, w in ((r.htf_trend, 5), (r.ttf_trend, 3), (r.ltf_trend, 2)):
            votes[t] += w
        assert r.primary_trend == max(votes, key=votes.get)
        sd = np.std([points[x] for x in (r.htf_trend, r.ttf_trend, r.ltf_trend)])
        assert r.alignment == ("perfect_alignment" if sd <= 0.5 else "good_alignment" if sd <= 1 else "partial_alignment" if sd <= 1.5 else "conflicting")


def test_gates_and_confluence(three):
    for mode in "hi":
        states, raw = discovery.signals_of(mode)
        aligned = mtf_table(three, TF, states, [*raw, *discovery.CONTEXT_EXTRA]).cache()
        last, each = (discovery.gate_report(aligned, mode, at).toPandas() for at in ("last", "bar"))
        assert len(last) == len(each) == 4 and set(last["gated_bars"]) <= {0, 1200}
        assert (each["sample_size"] <= each[["gated_bars", "signal_bars"]].min(axis=1)).all() and (last["signal_bars"].sort_values().to_numpy() == each["signal_bars"].sort_values().to_numpy()).all()
    out = confluence.confluence_scores(three, TF, {"h": ("rsi",), "t": ("macd",), "l": ("bb_pct",)}, "bearish").toPandas()
    parts = list(confluence.WEIGHTS)
    assert out[parts].stack().between(0, 100).all() and len(out) == 2400
    np.testing.assert_allclose(out["confluence_score"], sum(out[p] * w for p, w in confluence.WEIGHTS.items()), rtol=1e-12)
    assert confluence.categories({"h": ("rsi", "ema_50"), "t": ("rsi",), "l": ("volume_breakout",)})["pattern"] == (1, 0.25)


def test_trailing_modes(spark):
    """Steps that are too small or too soon do not move a stop, a lock fixes it, swing levels only ratchet."""
    from barloom.plans.risk import trailing_stop

    price = [100.0, 101.0, 101.1, 105.0, 90.0, 120.0, 121.0]
    pdf = pd.DataFrame({"pair": "p", "timeframe": "1h", "ts": pd.date_range("2023-01-01", periods=7, freq="h"), "close": price, "atr": 2.0,
                        "swing_level": [np.nan, 95.123456, 94.0, 96.0, 97.0, 90.0, 99.0], "locked": [0.0, 0, 0, 0, 0, 1, 0]})
    df = spark.createDataFrame(pdf)
    stops = lambda **k: trailing_stop(df.drop("locked") if k.pop("free", False) else df, **k).orderBy("ts").toPandas()["stop"].tolist()
    assert stops(mode="atr", k=2.0, min_improve=0.1, free=True) == [96.0, 97.0, 97.0, 101.0, 101.0, 116.0, 117.0]
    assert stops(mode="atr", k=2.0, min_improve=0.1) == [96.0, 97.0, 97.0, 101.0, 101.0, 101.0, 101.0]
    assert stops(mode="atr", k=2.0, cooldown=2 * 3600, free=True) == [96.0, 96.0, 97.1, 97.1, 97.1, 116.0, 116.0]
    got = stops(mode="swing", places=2, free=True)
    assert np.isnan(got[0]) and got[1:] == [95.12, 95.12, 96.0, 97.0, 97.0, 99.0]
    assert stops(mode="percent", pct=0.1, long=False, free=True, places=1) == [110.0, 110.0, 110.0, 110.0, 99.0, 99.0, 99.0]
