"""Bars that touch a price of 0, against the SQL twins."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.test_oracle import rows

TYPES = ("view", "click")


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Three ticks in each quarter of an hour over twelve days, with lows and closes of 0 in the middle and near the end."""
    out, n = [], 12 * 96
    for k, pair in enumerate(TYPES):
        for i in range(n):
            base = 50 + 20 * math.sin(i / (19 + k)) + 7 * math.sin(i / 5.3)
            for j, v in enumerate((base, base + 3 * math.cos(i), base + 2 * math.sin(2.1 * i))):
                low = i in (n - 30, n - 81, 500) and j == 1
                close = i in (n // 2, n - 113, n - 1) and j == 2
                out.append((pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=15 * i + 4 * j + k), pair, 0.0 if low or close else round(v, 2)))
    events = pd.DataFrame(out, columns=["ts", "event_type", "value"])
    events["event_id"], events["user_id"], events["props"] = range(len(events)), 1, '{"k": 3}'
    folder = tmp_path_factory.mktemp("zeros")
    events["ts"] = events["ts"].astype("datetime64[us]")
    events[["event_id", "ts", "user_id", "event_type", "value", "props"]].to_parquet(folder / "events.parquet", index=False)
    return str(folder)


def matches(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    want = cur.fetchall()
    assert want and rows([tuple(r) for r in df.collect()], df.columns) == rows(want, [d[0] for d in cur.description])
    return want


def test_levels_next_to_a_level_of_zero(spark, zeros):
    assert any(r[3] == 0 for r in matches(spark, zeros, "pa17_support_resistance"))


@pytest.mark.parametrize("name", ["bt1_mask_backtest", "jn1_mtf_states", "lb1_forward_labels", "lb4_excursions", "ag5_returns_with_median"])
def test_returns_from_a_close_of_zero(spark, zeros, name):
    matches(spark, zeros, name)


def test_windows_with_a_price_of_zero(spark, zeros):
    assert any(r[3] == math.inf for r in matches(spark, zeros, "rm28_window_features"))


@pytest.fixture(scope="module")
def zero_hours(tmp_path_factory):
    """Three ticks an hour over 700 hours; one hour in twelve closes at 0 and one in 24 is 0 throughout, at times the first or last of a segment."""
    r = np.random.default_rng(4)
    out = []
    for k, pair in enumerate(TYPES):
        price = 60 + np.cumsum(r.normal(0, 1.5, (700, 3)).ravel()).reshape(700, 3)
        price[r.random(700) < 1 / 12, 2] = 0
        price[r.random(700) < 1 / 24] = 0
        for i, j in np.ndindex(700, 3):
            out.append((pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=60 * i + 15 * j + k), pair, round(abs(price[i, j]), 2)))
    events = pd.DataFrame(out, columns=["ts", "event_type", "value"])
    events["event_id"], events["user_id"], events["props"] = range(len(events)), 1, '{"k": 3}'
    folder = tmp_path_factory.mktemp("zero_hours")
    events["ts"] = events["ts"].astype("datetime64[us]")
    events[["event_id", "ts", "user_id", "event_type", "value", "props"]].to_parquet(folder / "events.parquet", index=False)
    return str(folder)


@pytest.mark.parametrize("name", ["rm3_4_identity_and_price", "rm5_14_swings", "jn2_indicator_statistics", "sa14_indicator_combinations"])
def test_segments_next_to_a_close_of_zero(spark, zero_hours, name):
    assert any(math.inf in r for r in matches(spark, zero_hours, name))
