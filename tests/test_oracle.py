"""Catalogue queries against their SQL twins on the smallest tables, and checks of the contract itself."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

SAMPLE = ["ma1_sma", "ma11_kama", "tr2_adx", "os2_connors_rsi", "vo1_bollinger", "vl9_vwap", "cs1_16_candlesticks", "sw17_pullback_stage", "pa2_trend_structure_frames",
          "pa17_support_resistance", "ch7_16_frame_patterns", "st6_relative_to_median", "st10_held_events", "lb1_forward_labels", "jn1_asof_close", "dsc1_single_signals",
          "dsc3_mode_a", "snk2_upsert_features", "src1_normalise_klines", "bt5_ledger", "str2_tumbling_bars", "rm2_segments"]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)


def rows(data, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(cur.fetchall(), [d[0] for d in cur.description])


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "discovered_accuracy" in entry.entry(spark).columns
