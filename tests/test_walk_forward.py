"""Walk-forward mixtures: which rows each fold reads, and regimes that are there to be found."""

import numpy as np
import pandas as pd

from barloom.plans.models import walk_forward_windows


def rows(n, pair, seed):
    r = np.random.default_rng(seed)
    level = np.repeat(r.integers(0, 3, n // 25 + 1), 25)[:n]
    x = level * 4.0 + r.normal(size=n)
    return pd.DataFrame({"pair": pair, "timeframe": "1h", "ts": pd.date_range("2023-01-01", periods=n, freq="h"), "a": x, "b": -x + r.normal(size=n), "level": level})


def test_folds_and_regimes(spark):
    pdf = pd.concat([rows(730, "long", 1), rows(210, "short", 2), rows(200, "none", 3)], ignore_index=True)
    pdf.loc[5, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    got = walk_forward_windows(df, 200, 100, features=["a", "b"]).toPandas().sort_values(["pair", "ts"])
    assert got.groupby("pair").size().to_dict() == {"long": 530, "short": 10}
    long = got[got.pair == "long"]
    assert (long["fold"].to_numpy() == np.arange(530) // 100).all()
    assert (long["regime"] == long["level"]).mean() > 0.9 and long["confidence"].between(0.33, 1).all()
    # a fold sees its own rows only: later rows change nothing
    cut = walk_forward_windows(df.where("ts < '2023-01-17 08:00:00'"), 200, 100, features=["a", "b"]).toPandas().sort_values(["pair", "ts"])
    same = long.head(len(cut[cut.pair == "long"]))
    np.testing.assert_array_equal(cut[cut.pair == "long"]["regime"], same["regime"])
    assert walk_forward_windows(df.where("pair = 'none'"), 200, 100, features=["a", "b"]).count() == 0
