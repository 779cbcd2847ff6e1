import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import barloom.functions  # noqa: E402, F401
from barloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, "tests")


def walk(n: int, pair: str, seed: int, timeframe: str = "1h") -> pd.DataFrame:
    r = np.random.default_rng(seed)
    close = 100 + np.cumsum(r.normal(0, 0.5, n))
    high, low = close + r.uniform(0, 2, n), close - r.uniform(0, 2, n)
    return pd.DataFrame({
        "pair": pair, "timeframe": timeframe, "ts": pd.date_range("2023-01-01", periods=n, freq={"1h": "h", "15m": "15min"}[timeframe]),
        "open": r.uniform(low, high), "high": high, "low": low, "close": close, "volume": r.integers(1000, 10000, n).astype(float)})


@pytest.fixture(scope="session")
def walks(spark):
    """Two hourly walks, one nine times as long as the other."""
    return pd.concat([walk(1800, "hot", 1), walk(200, "cold", 2)], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, walks):
    return spark.createDataFrame(walks).cache()
