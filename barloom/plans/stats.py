"""Association tests over instance tables. All indicators or features are tested in one pass.

Inputs are long tables (metric, grp, value); ranks come from distinct-value counts with binned prefixes,
so no test collects or pairs up its observations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.tails import chi2_sf, f_sf, normal_two_sided, t_two_sided
from barloom.operators.blocks import BLOCK_ROWS, SERIES, core_rows, number_rows, to_blocks
from barloom.operators.quantiles import with_prefix_counts
from barloom.plans.models import complete
from barloom.session import cut_lineage

EXCLUDED_TIMEFRAMES = ("1m",)


def usable(instances: DataFrame) -> DataFrame:
    return instances.where(~F.col("timeframe").isin(*EXCLUDED_TIMEFRAMES))


def long_groups(df: DataFrame, metrics: Sequence[str], group: str, min_group: int = 10) -> DataFrame:
    """(metric, grp, value) without groups smaller than ``min_group``."""
    long = df.select(F.col(group).alias("grp"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["grp"], list(metrics), "metric", "value").where("value is not null and not isnan(value)")
    sizes = long.groupBy("metric", "grp").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_group)
    return long.join(sizes.drop("_n"), ["metric", "grp"])


def _rank_sums(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, grp): n and rank sum; plus total and tie term per keys."""
    per_group = long.groupBy(*keys, "value", "grp").agg(F.count(F.lit(1)).alias("c"))
    values = per_group.groupBy(*keys, "value").agg(F.sum("c").alias("n"))
    ranked = with_prefix_counts(values, keys).withColumn("_rank", F.col("below") + (F.col("n") + 1) / 2.0)
    tied = ranked.groupBy(*keys).agg(F.max("total").alias("total"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    sums = per_group.join(ranked.select(*keys, "value", "_rank"), [*keys, "value"]).groupBy(*keys, "grp").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("_rank")).alias("rank_sum"))
    return sums.join(tied, keys)


def kruskal_anova(df: DataFrame, metrics: Sequence[str], group: str, min_group: int = 10) -> DataFrame:
    """Kruskal-Wallis with tie correction and one-way analysis of variance, per metric."""
    long = long_groups(df, metrics, group, min_group)
    r = _rank_sums(long, ["metric"])
    n = F.col("total").cast("double")
    h = r.groupBy("metric").agg(
        F.count(F.lit(1)).alias("groups"), F.max("total").alias("total"), F.max("ties").alias("ties"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_s"))
    raw = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    kw = h.where("groups >= 2").select("metric", "groups", "total", (raw / (1 - F.col("ties") / (n * n * n - n))).alias("h_statistic"))
    g = long.groupBy("metric", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    g = g.withColumn("_gm", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("metric")) / F.sum("n").over(Window.partitionBy("metric")))
    a = g.groupBy("metric").agg(F.sum(F.col("n") * (F.col("m") - F.col("_gm")) ** 2).alias("_b"), F.sum((F.col("n") - 1) * F.col("v")).alias("_w"))
    j = kw.join(a, "metric").withColumn("f_statistic", F.try_divide(F.col("_b") / (F.col("groups") - 1), F.col("_w") / (F.col("total") - F.col("groups"))))
    return j.select("metric", "groups", F.col("total").alias("observations"), "h_statistic", chi2_sf(F.col("h_statistic"), F.col("groups") - 1).alias("kw_p"),
                    "f_statistic", f_sf(F.col("f_statistic"), F.col("groups") - 1, F.col("total") - F.col("groups")).alias("anova_p"))


def holm(df: DataFrame, p: str, by: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Step-down rejection: each p against alpha over the number of tests left, until the first failure."""
    w = Window.partitionBy(*by).orderBy(p, *[c for c in ("group_a", "group_b") if c in df.columns])
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    ok = F.coalesce(F.col(p) <= alpha / (m - F.row_number().over(w) + 1), F.lit(False)).cast("int")
    return df.withColumn("_ok", ok).withColumn("reject", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")


def pairwise(df: DataFrame, metrics: Sequence[str], group: str, method: str = "mannwhitney", min_group: int = 10, alpha: float = 0.05) -> DataFrame:
    """All pairs of groups by Mann-Whitney (normal approximation) or the pooled t test, with Holm's rule.

    An observation joins one row per partner group; the number of regime labels is small and fixed.
    """
    long = long_groups(df, metrics, group, min_group)
    labels = long.select("metric", "grp").distinct()
    pairs = labels.alias("a").join(labels.alias("b"), (F.col("a.metric") == F.col("b.metric")) & (F.col("a.grp") < F.col("b.grp"))).select(
        F.col("a.metric").alias("metric"), F.col("a.grp").alias("group_a"), F.col("b.grp").alias("group_b"))
    keys = ["metric", "group_a", "group_b"]
    if method == "mannwhitney":
        counted = long.groupBy("metric", "grp", "value").agg(F.count(F.lit(1)).alias("c"))
        x = pairs.join(counted, "metric").where((F.col("grp") == F.col("group_a")) | (F.col("grp") == F.col("group_b")))
        values = x.groupBy(*keys, "value").agg(F.sum("c").alias("n"))
        ranked = with_prefix_counts(values, keys).withColumn("_rank", F.col("below") + (F.col("n") + 1) / 2.0)
        tied = ranked.groupBy(*keys).agg(F.max("total").alias("total"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
        first = x.where(F.col("grp") == F.col("group_a")).join(ranked.select(*keys, "value", "_rank"), [*keys, "value"]).groupBy(*keys).agg(
            F.sum("c").alias("n1"), F.sum(F.col("c") * F.col("_rank")).alias("r1"))
        n, n1 = F.col("total").cast("double"), F.col("n1")
        n2 = n - n1
        u = F.col("r1") - n1 * (n1 + 1) / 2
        big = F.greatest(u, n1 * n2 - u)
        sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
        out = first.join(tied, keys).select(*keys, u.alias("statistic"), F.try_divide(big - n1 * n2 / 2 - 0.5, sd).alias("_z"))
        out = out.select(*keys, "statistic", F.least(F.lit(1.0), normal_two_sided(F.col("_z"))).alias("p_value"))
    else:
        g = long.groupBy("metric", "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
        ga = g.select("metric", F.col("grp").alias("group_a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("v").alias("va"))
        gb = g.select("metric", F.col("grp").alias("group_b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"))
        j = pairs.join(ga, ["metric", "group_a"]).join(gb, ["metric", "group_b"])
        dof = F.col("na") + F.col("nb") - 2
        pooled = ((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb")) / dof
        t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(pooled * (1 / F.col("na") + 1 / F.col("nb"))))
        out = j.select(*keys, t.alias("statistic"), dof.alias("_d")).select(*keys, "statistic", t_two_sided(F.col("statistic"), F.col("_d")).alias("p_value"))
    return holm(out, "p_value", ["metric"], alpha)


def flags(instances: DataFrame, indicators: DataFrame, outcome: str, group: str = "dominant_structure") -> DataFrame:
    """(indicator, instance) rows with has 0/1: every instance appears for every indicator name."""
    wide = instances.select("instance_id", *SERIES, "start_time", F.col(group).alias("grp"), F.col(outcome).cast("double").alias("outcome"))
    names = indicators.select("indicator_name").distinct().agg(F.collect_set("indicator_name").alias("_names"))
    has = indicators.where("confirms is not null").groupBy("instance_id").agg(F.collect_set("indicator_name").alias("_has"))
    # One row holding the handful of indicator names; its size does not depend on the data.
    j = wide.join(has, "instance_id", "left").join(names, F.lit(True))
    return j.withColumn("indicator_name", F.explode("_names")).withColumn(
        "has", F.coalesce(F.array_contains("_has", F.col("indicator_name")), F.lit(False)).cast("int")).drop("_names", "_has")


def chi_square(fl: DataFrame) -> DataFrame:
    """Indicator presence against regime, all indicators at once; Yates' correction for 2 x 2 tables."""
    cells = fl.groupBy("indicator_name", "grp", "has").agg(F.count(F.lit(1)).alias("o"))
    by = lambda *c: Window.partitionBy("indicator_name", *c)
    m = cells.withColumns({"r": F.sum("o").over(by("grp")), "c": F.sum("o").over(by("has")), "n": F.sum("o").over(by())})
    size = m.groupBy("indicator_name").agg(F.countDistinct("grp").alias("_r"), F.countDistinct("has").alias("_c"), F.max("n").alias("n"))
    rows = m.select("indicator_name", "grp", "r").distinct()
    cols = m.select("indicator_name", "has", "c").distinct()
    full = rows.join(cols, "indicator_name").join(m.select("indicator_name", "grp", "has", "o"), ["indicator_name", "grp", "has"], "left").join(size, "indicator_name")
    e = F.col("r") * F.col("c") / F.col("n")
    gap = F.abs(F.coalesce("o", F.lit(0)) - e)
    yates = (F.col("_r") == 2) & (F.col("_c") == 2)
    term = F.pow(F.when(yates, gap - F.least(F.lit(0.5), gap)).otherwise(gap), 2) / e
    s = full.groupBy("indicator_name").agg(F.sum(term).alias("chi2"), F.max("_r").alias("_r"), F.max("_c").alias("_c"), F.max("n").alias("n"))
    s = s.where("_r >= 2 and _c >= 2").withColumn("dof", (F.col("_r") - 1) * (F.col("_c") - 1))
    v = F.sqrt(F.col("chi2") / (F.col("n") * F.least(F.col("_r") - 1, F.col("_c") - 1)))
    return s.select("indicator_name", "chi2", "dof", chi2_sf(F.col("chi2"), F.col("dof")).alias("p_value"), v.alias("cramers_v"))


def digamma(x: Column) -> Column:
    """The digamma function of a positive number: six steps of its recurrence, then the asymptotic series."""
    x = x.cast("double")
    y = x + 6
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6)
    return reduce(lambda a, i: a - 1 / (x + i), range(6), series)


def _radius(values: DataFrame, keys: list[str], k: int, block: int) -> DataFrame:
    """Adds ``r``, the distance of each distinct value (with its count ``n``) to the nearest point but ``k - 1`` of its group, itself left out.

    Distinct values are cut into blocks by position and lend ``k`` of their own to the neighbouring blocks, so no group is ordered in one task.
    """
    at = with_prefix_counts(values.withColumn("_one", F.lit(1)), keys, n="_one").withColumnRenamed("below", "_at").drop("total", "_one")
    own, low, high = ((F.floor((F.col("_at") + d) / block)).cast("long") for d in (0, -k, k))
    lent = at.withColumn("_own", own).withColumn("_block", F.explode(F.array_distinct(F.array(own, low, high))))
    near = F.collect_list(F.struct("value", "n")).over(Window.partitionBy(*keys, "_block").orderBy("value").rowsBetween(-k, k))
    away = F.flatten(F.transform("_near", lambda s: F.array_repeat(F.abs(s["value"] - F.col("value")), F.least(s["n"], F.lit(k + 1)).cast("int"))))
    # the first entry is the point itself
    return lent.withColumn("_near", near).where("_own = _block").withColumn("r", F.get(F.array_sort(away), F.col("k"))).drop("_at", "_own", "_block", "_near")


def mutual_information(fl: DataFrame, neighbours: int = 3, block: int = 32_768) -> DataFrame:
    """Mutual information (nats) of presence and outcome by the distance to the third nearest neighbour of the same presence.

    psi(N) + mean psi(k) - mean psi(points of the same presence) - mean psi(points nearer than the k-th neighbour, itself and equal ones
    included), at least 0. Outcomes that are null or not finite do not count; the others are taken in whole billionths, so distances and
    ties are exact. ``k`` is smaller where fewer than four instances share the presence, and it is the number of equal points of the
    presence where the distance is 0. A presence of one instance is left out of everything; an indicator with no other has no row.
    """
    keys = ["indicator_name", "has"]
    values = fl.where("abs(outcome) < double('infinity')").groupBy(*keys, F.floor(F.col("outcome") * 1e9).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sizes = values.groupBy(*keys).agg(F.sum("n").alias("size")).where("size > 1").withColumn("k", F.least(F.lit(neighbours), F.col("size") - 1).cast("int"))
    values = cut_lineage(values.join(sizes, keys))
    inside = F.greatest(F.col("r") - 1, F.lit(0))
    points = cut_lineage(_radius(values, keys, neighbours, block).withColumn("lo", F.col("value") - inside).withColumn("hi", F.col("value") + inside + 1))
    asked = points.select("indicator_name", F.explode(F.array("lo", "hi")).alias("value"), F.lit(0).cast("long").alias("n"))
    pooled = values.select("indicator_name", "value", "n").union(asked).groupBy("indicator_name", "value").agg(F.sum("n").alias("n"))
    ranks = cut_lineage(with_prefix_counts(pooled, ["indicator_name"]).select("indicator_name", "value", "below"))
    for bound in ("lo", "hi"):
        points = points.join(ranks.select("indicator_name", F.col("value").alias(bound), F.col("below").alias(f"_{bound}")), ["indicator_name", bound])
    k = F.when(F.col("r") == 0, F.col("n")).otherwise(F.col("k"))
    term = digamma(k) - digamma(F.col("size")) - digamma(F.col("_hi") - F.col("_lo"))
    out = points.groupBy("indicator_name").agg(F.sum(F.col("n") * term).alias("_s"), F.sum("n").alias("observations"))
    return out.select("indicator_name", F.greatest(F.lit(0.0), digamma(F.col("observations")) + F.col("_s") / F.col("observations")).alias("mutual_info"), "observations")


def _distance_rows(values: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over j of |y_i - y_j| for each distinct value, from prefix counts and sums."""
    ranked = with_prefix_counts(values, keys)
    cum = with_prefix_counts(values.withColumn("_vs", F.col("n") * F.col("value")), keys, n="_vs").withColumnsRenamed({"below": "sum_below", "total": "sum_total"})
    j = ranked.join(cum.select(*keys, "value", "sum_below", "sum_total"), [*keys, "value"])
    y, n = F.col("value"), F.col("n")
    above = F.col("total") - F.col("below") - n
    return j.withColumn("row_sum", y * F.col("below") - F.col("sum_below") + (F.col("sum_total") - F.col("sum_below") - n * y) - y * above)


def distance_correlation(fl: DataFrame) -> DataFrame:
    """Distance correlation of presence (0/1) and the outcome in n log n.

    For a binary variable the cross distances are all distances less those inside the two groups, and
    sums of absolute differences follow from sorted prefix sums, so no pair of rows is formed.
    """
    known = fl.where("outcome is not null").select("indicator_name", "has", F.col("outcome").alias("value"))
    vals = known.groupBy("indicator_name", "value").agg(F.count(F.lit(1)).alias("n"))
    gvals = known.groupBy("indicator_name", "has", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = _distance_rows(vals, ["indicator_name"])
    inside = _distance_rows(gvals, ["indicator_name", "has"]).groupBy("indicator_name").agg(F.sum(F.col("n") * F.col("row_sum")).alias("inside"))
    sizes = known.groupBy("indicator_name").agg(F.count(F.lit(1)).alias("total_n"), F.sum("has").alias("n1"), F.sum(F.col("value") ** 2).alias("_y2"), F.sum("value").alias("_y"))
    all_b = rows.groupBy("indicator_name").agg(F.sum(F.col("n") * F.col("row_sum")).alias("b"), F.sum(F.col("n") * F.col("row_sum") ** 2).alias("bb"))
    ab = gvals.join(rows.select("indicator_name", "value", "row_sum"), ["indicator_name", "value"]).groupBy("indicator_name").agg(
        F.sum(F.when(F.col("has") == 1, F.col("n") * F.col("row_sum")).otherwise(0.0)).alias("b1"),
        F.sum(F.when(F.col("has") == 0, F.col("n") * F.col("row_sum")).otherwise(0.0)).alias("b0"))
    j = sizes.join(all_b, "indicator_name").join(inside, "indicator_name").join(ab, "indicator_name")
    N, n1 = F.col("total_n").cast("double"), F.col("n1").cast("double")
    n0 = N - n1
    a = 2 * n0 * n1
    cov = (F.col("b") - F.col("inside")) / N**2 + a / N**2 * F.col("b") / N**2 - 2 / N**3 * (n0 * F.col("b1") + n1 * F.col("b0"))
    vx = a / N**2 + (a / N**2) ** 2 - 2 / N**3 * (n1 * n0**2 + n0 * n1**2)
    vy = (2 * N * F.col("_y2") - 2 * F.col("_y") ** 2) / N**2 + (F.col("b") / N**2) ** 2 - 2 / N**3 * F.col("bb")
    value = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))))
    return j.select("indicator_name", F.col("total_n").alias("observations"), F.coalesce(value, F.lit(0.0)).alias("distance_corr"))


def granger(fl: DataFrame, max_lag: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Does presence help predict the next outcomes: smallest F-test p over lags 1..max_lag, per series and indicator.

    Lagged columns are built in blocks; one aggregate yields each Gram matrix; only those (at most 8 x 8)
    are solved in Python.
    """
    keys = [*SERIES, "indicator_name"]
    src = complete(fl, ["outcome"]).select(*keys, F.col("start_time").alias("ts"), "outcome", F.col("has").cast("double").alias("x"))
    b = to_blocks(src, max_lag, keys=keys, block_rows=block_rows)
    w = Window.partitionBy(*keys, "_blk").orderBy("_rn")
    lags = {f"y{k}": F.lag("outcome", k).over(w) for k in range(1, max_lag + 1)} | {f"x{k}": F.lag("x", k).over(w) for k in range(1, max_lag + 1)}
    d = core_rows(b.withColumns(lags)).withColumn("one", F.lit(1.0))
    names = ["outcome", "one", *[f"y{k}" for k in range(1, max_lag + 1)], *[f"x{k}" for k in range(1, max_lag + 1)]]
    grams = []
    for k in range(1, max_lag + 1):
        have = F.col(f"y{k}").isNotNull()
        cells = [F.sum(F.when(have, F.coalesce(F.col(p), F.lit(0.0)) * F.coalesce(F.col(q), F.lit(0.0)))) for i, p in enumerate(names) for q in names[: i + 1]]
        grams += [F.array(*cells).alias(f"g{k}"), F.sum(have.cast("int")).alias(f"n{k}")]
    g = d.groupBy(*keys).agg(*grams)

    def solve(it):
        for pdf in it:
            res = []
            for _, r in pdf.iterrows():
                for k in range(1, max_lag + 1):
                    n = r[f"n{k}"]
                    cells = r[f"g{k}"]
                    m = np.zeros((len(names), len(names)))
                    pos = 0
                    for i in range(len(names)):
                        for j in range(i + 1):
                            m[i, j] = m[j, i] = cells[pos] if cells[pos] is not None else 0.0
                            pos += 1
                    small = [1, *range(2, 2 + k)]
                    big = [*small, *range(2 + max_lag, 2 + max_lag + k)]
                    dof = (n or 0) - len(big)
                    if dof <= 0:
                        continue
                    sse = []
                    for cols in (small, big):
                        a, bvec = m[np.ix_(cols, cols)], m[cols, 0]
                        coef = np.linalg.lstsq(a, bvec, rcond=None)[0]
                        sse.append(m[0, 0] - 2 * coef @ bvec + coef @ a @ coef)
                    if sse[1] <= 1e-12 * max(m[0, 0], 1e-300):
                        continue
                    f = (sse[0] - sse[1]) / k / (sse[1] / dof)
                    res.append((*[r[c] for c in keys], k, float(max(f, 0.0)), float(k), float(dof)))
            yield pd.DataFrame(res, columns=[*keys, "lag", "f_statistic", "d1", "d2"])

    out = g.mapInPandas(solve, "pair string, timeframe string, indicator_name string, lag int, f_statistic double, d1 double, d2 double")
    out = out.withColumn("p_value", f_sf(F.col("f_statistic"), F.col("d1"), F.col("d2"))).where("p_value is not null")
    return out.groupBy(*keys).agg(F.min("p_value").alias("p_value"), F.min_by("lag", "p_value").alias("lag"), F.min_by("f_statistic", "p_value").alias("f_statistic"))


# ---- models ----
def _vectors(df: DataFrame, features: Sequence[str], label: str | None = None, scale: bool = True) -> DataFrame:
    clean = complete(df.na.drop(subset=[label]) if label else df, features)
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw")]
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    if label:
        stages.append(StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"))
    out = Pipeline(stages=stages).fit(clean).transform(clean)
    return out if scale else out.withColumnRenamed("_raw", "features")


def logistic_regime(df: DataFrame, features: Sequence[str], label: str, folds: int = 3, seed: int = 42) -> DataFrame:
    """L1 multinomial fit: cross-validated accuracy and mean absolute coefficient per feature."""
    data = _vectors(df, features, label)
    lr = LogisticRegression(elasticNetParam=1.0, regParam=0.01, maxIter=50, family="multinomial")
    cv = CrossValidator(estimator=lr, estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, seed=seed,
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"))
    model = cv.fit(data)
    coef = np.abs(model.bestModel.coefficientMatrix.toArray()).mean(axis=0)
    rows = [(f, float(c), float(model.avgMetrics[0])) for f, c in zip(features, coef, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, mean_abs_coef double, cv_accuracy double")


def keyed_bijection(i: Column, n: int, key: int) -> Column:
    """A permutation of 0..n-1: ``a * i + b`` modulo n with ``a`` prime to n, both chosen by ``key``. The same on every retry."""
    r = np.random.default_rng(key)
    a = 1
    if n > 2:
        a = int(r.integers(2, n))
        while math.gcd(a, n) != 1:
            a = a + 1 if a + 1 < n else 1
    return F.pmod(i * F.lit(a) + F.lit(int(r.integers(0, max(n, 1)))), F.lit(n))


def permutation_importance(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 10,
                           repeats: int = 10, seed: int = 42) -> DataFrame:
    """Accuracy lost when one feature is replaced by its value on another row.

    Rows are numbered in the order of a hash of their values; a keyed bijection of the numbers names the other row of each repeat. One
    join hands every row its partners and one scoring pass judges all features and repeats.
    """
    features = list(features)
    clean = complete(df.na.drop(subset=[label]), features).select(*features, label)
    data = cut_lineage(_vectors(clean, features, label, scale=False))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    base = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(data))
    rows = data.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), "label", F.lit(1).alias("_one"), F.xxhash64(*features, "label").alias("_h"))
    rows = cut_lineage(number_rows(rows, ["_one"], "_h", 1 << 50).select("x", "label", (F.col("_rn") - 1).alias("i")))
    n = rows.count()
    partners = F.array(*[F.struct(F.lit(r).alias("r"), keyed_bijection(F.col("i"), n, seed + r).alias("j")) for r in range(repeats)])
    asked = rows.select("x", "label", F.explode(partners).alias("p")).select("x", "label", "p.r", "p.j")
    swapped = asked.join(rows.select(F.col("i").alias("j"), F.col("x").alias("y")), "j").withColumn("f", F.explode(F.array(*[F.lit(k) for k in range(len(features))])))
    mixed = F.transform("x", lambda v, k: F.when(k == F.col("f"), F.get(F.col("y"), k)).otherwise(v))
    scored = model.transform(swapped.select("r", "f", "label", array_to_vector(mixed).alias("features")))
    lost = scored.groupBy("f", "r").agg((F.lit(base) - F.avg((F.col("prediction") == F.col("label")).cast("double"))).alias("lost"))
    found = {r["f"]: r for r in lost.groupBy("f").agg(F.avg("lost").alias("m"), F.stddev_pop("lost").alias("s")).collect()}
    out = [(f, float(found[k]["m"]), float(found[k]["s"]), float(model.featureImportances[k])) for k, f in enumerate(features) if k in found]
    return df.sparkSession.createDataFrame(out, "feature string, importance_mean double, importance_std double, forest_importance double")


def pca_contribution(df: DataFrame, features: Sequence[str], k: int = 3) -> DataFrame:
    data = _vectors(df, features)
    model = PCA(k=k, inputCol="features", outputCol="pc").fit(data)
    load, var = model.pc.toArray(), model.explainedVariance.toArray()
    rows = [(f"PC{j + 1}", f, float(load[i, j]), float(var[j])) for j in range(k) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "component string, feature string, loading double, explained_variance double")


def silhouette(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    data = _vectors(df, features, label).withColumn("prediction", F.col("label").cast("int"))
    score = ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(data)
    sizes = data.groupBy(F.col(label).alias("regime")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("silhouette", F.lit(float(score)))


def cluster_stability(df: DataFrame, features: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5), seed: int = 42) -> DataFrame:
    data = _vectors(df, features).cache()
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=50).fit(data)
        score = ClusteringEvaluator(featuresCol="features").evaluate(model.transform(data))
        rows.append((k, float(model.summary.trainingCost), float(score)))
    data.unpersist()
    best = max(rows, key=lambda r: r[2])[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, inertia double, silhouette double, best boolean")


# ---- sequences and combinations ----
def transitions(instances: DataFrame, by: Sequence[str] = SERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Counts and shares of structure to next structure, per series by default."""
    src = instances.select(*by, F.col("start_time").alias("ts"), "dominant_structure", "instance_id")
    b = to_blocks(src, 0, 1, keys=by, block_rows=block_rows)
    nxt = F.lead("dominant_structure").over(Window.partitionBy(*by, "_blk").orderBy("_rn"))
    rows = core_rows(b.withColumn("to_structure", nxt)).where("to_structure is not null").withColumnRenamed("dominant_structure", "from_structure")
    c = rows.groupBy("from_structure", "to_structure").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("from_structure")))


def transition_indicators(instances: DataFrame, indicators: DataFrame, top: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The most frequent confirming indicators of the most frequent transitions."""
    src = instances.select(*SERIES, F.col("start_time").alias("ts"), "dominant_structure", "instance_id")
    b = to_blocks(src, 0, 1, block_rows=block_rows)
    w = Window.partitionBy(*SERIES, "_blk").orderBy("_rn")
    rows = core_rows(b.withColumn("to_structure", F.lead("dominant_structure").over(w))).where("to_structure is not null")
    t = rows.select("instance_id", F.col("dominant_structure").alias("from_structure"), "to_structure")
    best = t.groupBy("from_structure", "to_structure").agg(F.count(F.lit(1)).alias("transitions")).orderBy(
        F.desc("transitions"), "from_structure", "to_structure").limit(top)
    hit = t.join(best, ["from_structure", "to_structure"]).join(indicators.where("confirms is not null").select("instance_id", "confirms"), "instance_id")
    c = hit.groupBy("from_structure", "to_structure", "transitions", "confirms").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("from_structure", "to_structure").orderBy(F.desc("n"), "confirms")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def exact_mean(x: Column) -> Column:
    """Mean of a double column that does not depend on the order of its rows, so that equal sets of values have equal means.

    Values are summed as decimals, to 18 digits behind the point and with room for 1e11 rows; those from 1e27 on, infinities and NaN as doubles.
    """
    parts, rest = [], x
    for limit, scale in ((1e9, 18), (1e18, 9), (1e27, 0)):
        # NaN is above every number.
        parts.append(F.try_divide(F.sum(F.when(F.abs(rest) < limit, rest).cast(f"decimal(38,{scale})")), F.count(x)).cast("double"))
        rest = F.when(F.abs(rest) >= limit, rest)
    parts.append(F.try_divide(F.sum(rest), F.count(x)))
    return F.when(F.count(x) > 0, reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]))


def indicator_combinations(instances: DataFrame, size: int = 3, min_n: int = 20, top: int = 20) -> DataFrame:
    """Returns after instances that share a set of one to ``size`` confirming indicators.

    Combinations of the same instances have the same average and are listed by name.
    """
    c = F.array_sort(F.array_distinct("confirming_indicators"))
    one = F.transform(c, lambda a: F.array(a))
    grown = [one]
    for _ in range(size - 1):
        grown.append(F.flatten(F.transform(grown[-1], lambda s: F.transform(
            F.filter(c, lambda x: x > F.element_at(s, -1)), lambda x: F.array_append(s, x)))))
    combos = F.explode(F.concat(*grown)).alias("combo")
    x = instances.select("next_1d_return_pct", "next_3d_return_pct", combos).withColumn("combo", F.concat_ws("+", "combo"))
    g = x.groupBy("combo").agg(F.count(F.lit(1)).alias("n"), exact_mean(F.col("next_1d_return_pct")).alias("avg_1d"), exact_mean(F.col("next_3d_return_pct")).alias("avg_3d"),
                               F.avg(F.when(F.col("next_1d_return_pct") > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    return g.where(F.col("n") >= min_n).orderBy(F.desc("avg_3d"), "combo").limit(top)


def correlation_direction(instances: DataFrame, indicators: DataFrame) -> DataFrame:
    """HIGH or LOW: the sign of the correlation of an indicator's mean with being in each structure."""
    j = indicators.select("instance_id", "indicator_name", "mean_value").where("mean_value is not null").join(
        instances.select("instance_id", "dominant_structure"), "instance_id")
    g = j.groupBy("indicator_name", "dominant_structure").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("mean_value").alias("s"))
    t = j.groupBy("indicator_name").agg(F.count(F.lit(1)).cast("double").alias("_all"), F.avg("mean_value").alias("m"), F.var_pop("mean_value").alias("v"))
    x = g.join(t, "indicator_name")
    p = F.col("n") / F.col("_all")
    corr = F.try_divide(F.col("s") / F.col("_all") - F.col("m") * p, F.sqrt(F.col("v") * p * (1 - p)))
    return x.select("indicator_name", "dominant_structure", corr.alias("correlation"), F.when(corr > 0, "HIGH").otherwise("LOW").alias("direction"))


def causal_suite(fl: DataFrame) -> DataFrame:
    """Every indicator with its chi-square, mutual information, distance correlation and Granger results."""
    g = granger(fl).groupBy("indicator_name").agg(F.min("p_value").alias("granger_p"))
    parts = [chi_square(fl).select("indicator_name", "cramers_v", F.col("p_value").alias("chi2_p")), mutual_information(fl).drop("observations"),
             distance_correlation(fl).drop("observations"), g]
    return reduce(lambda a, b: a.join(b, "indicator_name", "full"), parts)


def drivers(suite: DataFrame, direction: DataFrame) -> DataFrame:
    """Causing and affecting factors per structure with a formula text; thresholds as in the rule book."""
    kind = F.when((F.col("granger_p") < 0.05) | (F.col("mutual_info") > 0.15), "causing").when(F.col("mutual_info") > 0.05, "affecting")
    j = suite.withColumn("kind", kind).where("kind is not null").join(direction, "indicator_name")
    factor = F.struct("indicator_name", "direction", "kind")
    text = F.concat_ws(" AND ", F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "causing", F.struct("indicator_name", "direction")))),
                                            lambda s: F.concat_ws(" is ", s["indicator_name"], s["direction"])))
    return j.groupBy("dominant_structure").agg(F.to_json(F.array_sort(F.collect_list(factor))).alias("factors_json"), text.alias("formula"))
