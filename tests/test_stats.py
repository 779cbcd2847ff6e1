import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.tails import chi2_sf, f_sf, normal_two_sided, t_two_sided
from barloom.plans import stats as S


def test_tail_probabilities(spark):
    d = spark.createDataFrame([(3.841458820694124, 1.0)], "x double, k double")
    r = d.select(chi2_sf(F.col("x"), F.col("k")).alias("c"), normal_two_sided(F.lit(1.959963984540054)).alias("z"),
                 f_sf(F.lit(4.964602743730711), F.lit(1), F.lit(10)).alias("f"), t_two_sided(F.lit(2.2281388519649385), F.lit(10)).alias("t")).first()
    for v in r:
        assert v == pytest.approx(0.05, abs=1e-9)


def test_distance_correlation_matches_definition(spark):
    r = np.random.default_rng(3)
    has, y = r.integers(0, 2, 60), np.round(r.normal(0, 1, 60), 1)
    df = spark.createDataFrame([("i", int(h), float(v)) for h, v in zip(has, y)], "indicator_name string, has int, outcome double")
    got = S.distance_correlation(df).first()["distance_corr"]

    def centred(x):
        a = np.abs(x[:, None] - x[None, :])
        return a - a.mean(0) - a.mean(1)[:, None] + a.mean()

    a, b = centred(has.astype(float)), centred(y)
    want = math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean()))
    assert got == pytest.approx(want, rel=1e-9)


def test_mutual_information_matches_definition(spark):
    """Against all pairs of 2,000 rows, with repeated outcomes, a presence of one row and one of three, at two block sizes."""
    r = np.random.default_rng(5)
    has = r.integers(0, 2, 1000)
    groups = {"linked": (has, has * 0.8 + np.where(r.random(1000) < 0.3, r.integers(-3, 4, 1000) / 2, r.normal(0, 1, 1000))),
              "free": (r.integers(0, 2, 980), r.normal(0, 1, 980)),
              "three": (np.array([1, 1, 1] + [0] * 12), np.array([0.5, 0.6, 0.6, *r.normal(0, 1, 12)])),
              "one": (np.array([1, 0, 0, 0, 0]), np.array([5.0, 1, 2, 2, 4]))}
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329

    def want(has, y):
        y = np.floor(y * 1e9).astype(np.int64)
        keep = np.array([(has == h).sum() > 1 for h in has])
        has, y = has[keep], y[keep]
        total = 0.0
        for i in range(len(y)):
            own = np.delete(np.abs(y - y[i]), i)[np.delete(has, i) == has[i]]
            k = min(3, len(own))
            d = np.abs(y - y[i])
            near = np.sort(own)[k - 1]
            total += psi(k if near else int((own == 0).sum()) + 1) - psi(len(own) + 1) - psi(int(((d < near) | (d == 0)).sum()))
        return max(0.0, psi(len(y)) + total / len(y)), len(y)

    rows = [(name, int(h), float(v)) for name, (hs, ys) in groups.items() for h, v in zip(hs, ys)]
    rows += [("free", 1, None), ("free", 0, float("nan")), ("free", 0, float("inf")), ("nothing", 1, None)]
    df = spark.createDataFrame(rows, "indicator_name string, has int, outcome double")
    for block in (5, 32_768):
        got = {x["indicator_name"]: (x["mutual_info"], x["observations"]) for x in S.mutual_information(df, block=block).collect()}
        assert set(got) == set(groups)
        for name, (hs, ys) in groups.items():
            assert got[name] == (pytest.approx(want(hs, ys)[0], abs=1e-9), want(hs, ys)[1]), name
    assert got["linked"][0] > 0.05 > got["free"][0]
    assert S.mutual_information(df.where("false")).count() == 0


def test_kruskal_known_value(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 5)] + [("b", float(v)) for v in (6, 7, 8, 9, 10)]
    got = S.kruskal_anova(spark.createDataFrame(rows, "g string, x double"), ["x"], "g", 5).first()
    assert got["h_statistic"] == pytest.approx(6.818181818)
    assert got["kw_p"] == pytest.approx(0.00902343, abs=1e-7)
    assert got["f_statistic"] == pytest.approx(25.0)


def test_holm_stops_at_first_failure(spark):
    df = spark.createDataFrame([("m", "a", "b", 0.01), ("m", "a", "c", 0.04), ("m", "b", "c", 0.03)], "metric string, group_a string, group_b string, p double")
    got = {r["p"]: r["reject"] for r in S.holm(df, "p", ["metric"]).collect()}
    assert got == {0.01: True, 0.03: False, 0.04: False}


def test_permutation_importance(spark):
    """The feature that decides the label loses accuracy, noise does not; the permutation is one, and runs agree."""
    from pyspark.sql import functions as F

    from barloom.plans.stats import keyed_bijection, permutation_importance

    for n in (1, 2, 7, 100):
        for key in (1, 2, 3):
            got = [r["j"] for r in spark.range(n).select(keyed_bijection(F.col("id"), n, key).alias("j")).collect()]
            assert sorted(got) == list(range(n))
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    df = spark.createDataFrame([(*map(float, v), "up" if v[0] > 0 else "down") for v in x], "a double, b double, c double, y string")
    one, two = (permutation_importance(df.repartition(k), ["a", "b", "c"], "y", trees=10, depth=4, repeats=5).toPandas().set_index("feature") for k in (1, 5))
    assert one.loc["a", "importance_mean"] > 0.3 and one.loc[["b", "c"], "importance_mean"].abs().max() < 0.1
    assert (one["importance_std"] >= 0).all() and abs(one.loc["a", "importance_mean"] - two.loc["a", "importance_mean"]) < 0.15


def test_combinations_of_equal_returns_are_listed_by_name(spark):
    """The same returns in two orders are one average, of which the first name is kept."""
    returns = [0.1, 0.2, 0.3]
    assert (0.1 + 0.2) + 0.3 > (0.3 + 0.2) + 0.1
    rows = [([n], v, v) for n, vs in (("a", returns[::-1]), ("b", returns)) for v in vs]
    df = spark.createDataFrame(rows, "confirming_indicators array<string>, next_1d_return_pct double, next_3d_return_pct double").coalesce(1)
    got = S.indicator_combinations(df, min_n=3, top=1).collect()
    assert [r["combo"] for r in got] == ["a"]
    assert (got[0]["avg_1d"], got[0]["avg_3d"]) == (0.2, 0.2)


def test_exact_mean(spark):
    """Equal to the exact mean in any order, for values of very different size; infinities, NaN and missing values as in a plain mean."""
    r = np.random.default_rng(8)
    values = (r.normal(0, 1, 400) * 10.0 ** r.integers(-6, 22, 400)).tolist()
    exact = float(sum(map(Fraction, values)) / len(values))
    groups = {"up": sorted(values), "down": sorted(values, reverse=True), "inf": [1.0, math.inf, None], "both": [math.inf, -math.inf], "nan": [2.0, math.nan],
              "none": [None, None], "gap": [1.5, None, 2.5], "huge": [1e300, 1e300], "zero": [0.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").coalesce(1)
    got = {x["g"]: x["m"] for x in df.groupBy("g").agg(S.exact_mean(F.col("v")).alias("m")).collect()}
    assert got["up"] == got["down"] == pytest.approx(exact, rel=1e-15)
    assert got["inf"] == math.inf and math.isnan(got["both"]) and math.isnan(got["nan"]) and got["none"] is None
    assert (got["gap"], got["huge"], got["zero"]) == (2.0, 1e300, 0.0)


def test_granger_leaves_out_infinite_outcomes(spark):
    r = np.random.default_rng(9)
    rows = [("p", "1h", "i", f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00", float(v), int(h)) for i, (v, h) in enumerate(zip(r.normal(0, 1, 200), r.integers(0, 2, 200)))]
    odd = [("p", "1h", "i", f"2024-02-01 {h:02d}:00:00", v, 1) for h, v in enumerate((math.inf, math.nan, None))]
    schema = "pair string, timeframe string, indicator_name string, start_time string, outcome double, has int"
    plain, mixed = (S.granger(spark.createDataFrame(x, schema).withColumn("start_time", F.col("start_time").cast("timestamp"))).collect() for x in (rows, rows + odd))
    assert plain == mixed and len(plain) == 1
