"""Triples counted inside tasks, and recursions that leave other columns in Arrow."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from barloom.functions.registry import _recursions
from barloom.plans.discovery import triple_counts


def test_triple_counts_equal_all_triples(spark):
    r, signals = random.Random(3), ("a", "b")
    cols = [f"{p}_state_{s}" for p in "htl" for s in signals]
    data = [(r.choice(["x", "y"]), r.choice([None, 0.0, 1.5, -2.0]), *[r.choice([None, -1, 0, 1]) for _ in cols]) for _ in range(500)]
    df = spark.createDataFrame(data, "pair string, future_return double, " + ", ".join(f"{c} int" for c in cols)).repartition(5)
    want = Counter()
    for pair, ret, *v in data:
        v = [x or 0 for x in v]
        for i, j, k in itertools.product(range(2), repeat=3):
            key = (pair, signals[i], v[i], signals[j], v[2 + j], signals[k], v[4 + k])
            for name, n in (("n", 1), ("up", (ret or 0) > 0), ("down", (ret or 0) < 0)):
                want[(*key, name)] += int(n)
    got = {(x.pair, *x.h, *x.t, *x.l, n): x[n] for x in triple_counts(df, signals).collect() for n in ("n", "up", "down")}
    assert got == dict(want)
    # the rows that are shuffled do not grow with the bars
    many = df.crossJoin(spark.range(20)).drop("id").coalesce(1)
    assert triple_counts(many, signals).count() == triple_counts(df, signals).count() <= 2 * 6**3


def test_recursions_leave_other_columns_in_arrow():
    ring = pa.array([[{"ts": i, "high": 1.0}] for i in range(4)])
    rows = pa.table({"_rn": [3, 1, 2, 4], "x": [3.0, 1.0, None, 4.0], "y": [float("nan"), 1.0, 2.0, 3.0], "ring": ring})
    out = _recursions([("ema", "x", None, 0.5, 1), ("gap", "", lambda p: p["x"] - p["ema"], 1.0, 1)])(rows)
    assert out.column_names == ["_rn", "x", "y", "ring", "ema", "gap"] and out["ring"].type == ring.type
    assert out["_rn"].to_pylist() == [1, 2, 3, 4] and out["ring"].to_pylist()[0][0]["ts"] == 1 and out["y"].to_pylist()[2] is None
    x = rows.to_pandas().sort_values("_rn")["x"].reset_index(drop=True)
    np.testing.assert_allclose(out["ema"].to_numpy(), x.ewm(alpha=0.5, adjust=False, min_periods=1).mean().to_numpy())
