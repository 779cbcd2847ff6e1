"""Swing registry, hidden Markov regimes, window clustering and next-regime prediction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.registry import compute
from barloom.operators.asof import asof_join
from barloom.operators.blocks import BLOCK_ROWS, SERIES, carry, core_rows, number_rows, to_blocks
from barloom.operators.quantiles import grouped_quantiles
from barloom.plans.hmm import MOST_STEPS, STATES, fit_chain
from barloom.session import cut_lineage

# Bar features copied to a swing, with the value used when a bar has none; the features of the hidden chain.
SWING_FEATURES = {
    "rsi": 50.0, "adx": 20.0, "atr_ratio": 0.0, "macd_hist": 0.0, "volume_zscore": 0.0, "bb_width": 0.0, "local_slope": 0.0, "return_gradient": 0.0,
    "directional_persistence": 0.0, "kc_width": 0.0, "normalized_variance": 0.0, "roc": 0.0, "ppo": 0.0, "volume_roc": 0.0, "obv_change": 0.0,
}
HMM_FEATURES = (
    "magnitude_pct", "duration", "local_slope", "return_gradient", "directional_persistence", "atr_ratio", "bb_width", "kc_width", "normalized_variance",
    "rsi", "roc", "ppo", "macd_hist", "adx", "volume_roc", "obv_change", "volume_zscore",
)


def swing_registry(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per confirmed pivot (two where a bar is both) with its move from the pivot before and its structure."""
    f = compute(bars, ["swing_high", "swing_low", *SWING_FEATURES, "_slope10", "_gradient10"], block_rows, keep=("_rn",))
    kinds = F.array_compact(F.array(
        F.when(F.col("swing_high") == 1, F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("swing_low") == 1, F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))
    x = f.select(*SERIES, "ts", F.col("_rn").alias("bar_no"), F.posexplode(kinds).alias("_k", "p"), F.coalesce("_slope10", F.lit(0.0)).alias("slope"), F.coalesce("_gradient10", F.lit(0.0)).alias("gradient"),
                 *[F.coalesce(c, F.lit(d)).alias(c) for c, d in SWING_FEATURES.items()])
    x = x.withColumn("_ord", F.unix_seconds("ts") * 2 + F.col("_k")).select("*", "p.*").drop("p", "_k")
    b = to_blocks(number_rows(cut_lineage(x), ties=("_ord",)), 2, block_rows=block_rows)
    w = Window.partitionBy(*SERIES, "_blk").orderBy("_rn", "_ord")
    before = F.lag("price").over(w)
    kind = F.col("kind")
    up = F.col("price") > before
    structure = F.when(F.col("_rn") <= 2, "unknown").when((kind == "high") & up, "HH").when(kind == "high", "LH").when(up, "HL").otherwise("LL")
    b = b.withColumns({"magnitude_pct": F.coalesce(F.try_divide(F.abs(F.col("price") - before), before) * 100, F.lit(0.0)), "structure": structure,
                       "duration": F.coalesce(F.col("bar_no") - F.lag("bar_no").over(w), F.lit(0)).cast("double")})
    return core_rows(b, keep=("_rn",)).withColumnRenamed("_rn", "swing_no").drop("_ord")


def hmm_regimes(swings: DataFrame, features: Sequence[str] = HMM_FEATURES, states: int = STATES, iterations: int = MOST_STEPS,
                seed: int = 42, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict]:
    """Hidden Markov regime and its posterior probability of every swing."""
    return fit_chain(swings, features, ["swing_no", "ts", "kind"], "swing_no", states, iterations, seed=seed, block_rows=block_rows)


def transition_table(spark, model: dict) -> DataFrame:
    t = model["transitions"]
    return spark.createDataFrame([(i, j, float(t[i, j])) for i in range(len(t)) for j in range(len(t))], "from_regime int, to_regime int, probability double")


def centroids(swings: DataFrame, regimes: DataFrame) -> DataFrame:
    """Mean features per regime with a label from the level of range, trend strength, slope and momentum."""
    j = swings.join(regimes.select(*SERIES, "swing_no", "regime"), [*SERIES, "swing_no"])
    c = j.groupBy("regime").agg(F.count(F.lit(1)).alias("swings"), *[F.avg(x).alias(x) for x in (*SWING_FEATURES, "slope", "magnitude_pct")])
    q = grouped_quantiles(c.withColumn("_one", F.lit(1)), ["_one"], ["atr_ratio"], [0.35, 0.7]).agg(
        F.max(F.when(F.col("prob") < 0.5, F.col("value"))).alias("_lo"), F.max(F.when(F.col("prob") > 0.5, F.col("value"))).alias("_hi"))
    x = c.join(q, F.lit(True))
    vol = F.when(F.col("atr_ratio") >= F.col("_hi"), "high_vol").when(F.col("atr_ratio") <= F.col("_lo"), "low_vol").otherwise("normal_vol")
    trend = F.when(F.col("adx") < 18, "ranging").when((F.col("slope") > 0) & (F.col("rsi") > 40), "uptrend").when((F.col("slope") < 0) & (F.col("rsi") < 60), "downtrend").otherwise("transition")
    return x.withColumn("label", F.concat_ws("_", trend, vol)).drop("_lo", "_hi")


def regime_runs(regimes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Consecutive swings of one regime as instances with an id per regime and order."""
    b = to_blocks(regimes.withColumn("_rn", F.col("swing_no")), 2, block_rows=block_rows)
    w = Window.partitionBy(*SERIES, "_blk").orderBy("_rn")
    b = b.withColumn("_new", F.coalesce(F.col("regime") != F.lag("regime").over(w), F.lit(True)))
    r = core_rows(carry(b, 2, lasts={"_run": F.when(F.col("_new"), F.col("_rn"))}, block_rows=block_rows), keep=())
    return r.groupBy(*SERIES, "regime", "_run").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("swings")).withColumn(
        "instance_id", F.format_string("R%d_I%d", F.col("regime"), F.col("_run"))).drop("_run")


def to_bars(bars: DataFrame, regimes: DataFrame) -> DataFrame:
    """Each bar takes the regime of the newest swing; bars before the first are unknown (-1)."""
    newest = regimes.groupBy(*SERIES, "ts").agg(F.max_by("regime", "swing_no").alias("regime"))
    return asof_join(bars.select(*SERIES, "ts", "close"), newest, list(SERIES), prefix="_").withColumn("hmm_regime", F.coalesce("_regime", F.lit(-1))).drop("_regime", "_ts")


def hmm_states(bars: DataFrame, regimes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Bars with the regime and probability of their newest swing, whether the regime changed there, and the bars it has lasted."""
    newest = regimes.groupBy(*SERIES, "ts").agg(F.max_by(F.struct("regime", "probability"), "swing_no").alias("x")).select(*SERIES, "ts", "x.regime", "x.probability")
    x = asof_join(bars.select(*SERIES, "ts", "close"), newest, list(SERIES), prefix="_").withColumn("hmm_regime", F.coalesce("_regime", F.lit(-1)))
    b = to_blocks(x.select(*SERIES, "ts", "close", "hmm_regime", F.coalesce("_probability", F.lit(0.0)).alias("hmm_probability")), 2, block_rows=block_rows)
    w = Window.partitionBy(*SERIES, "_blk").orderBy("_rn")
    b = b.withColumn("regime_changed", F.when(F.col("hmm_regime").eqNullSafe(F.lag("hmm_regime").over(w)), 0).otherwise(1))
    b = carry(b, 2, lasts={"_since": F.when(F.col("regime_changed") == 1, F.col("_rn"))}, block_rows=block_rows)
    return core_rows(b.withColumn("bars_in_regime", F.col("_rn") - F.col("_since") + 1).drop("_since"))


def predicted_regimes(swings: DataFrame, regimes: DataFrame, trees: int = 100, depth: int = 6, seed: int = 42, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Forest for the regime of the next swing, trained on the first 80 % of each series: every swing with the regime that followed,
    the predicted one, its probability and whether they match (``held_out`` for the last 20 %), and the features' importances."""
    cols = [*SWING_FEATURES, "slope", "gradient", "magnitude_pct"]
    j = swings.join(regimes.select(*SERIES, "swing_no", "regime"), [*SERIES, "swing_no"])
    b = to_blocks(j.withColumn("_rn", F.col("swing_no")), 0, 1, block_rows=block_rows)
    nxt = F.lead("regime").over(Window.partitionBy(*SERIES, "_blk").orderBy("_rn"))
    x = core_rows(b.withColumn("label", nxt.cast("double"))).where("label is not null")
    n = x.groupBy(*SERIES).agg(F.max("swing_no").alias("_n"))
    data = VectorAssembler(inputCols=[*cols, "regime"], outputCol="features").transform(cut_lineage(x.join(n, list(SERIES))))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data.where("swing_no <= 0.8 * _n"))
    out = model.transform(data).select(
        *SERIES, "ts", "swing_no", F.col("label").cast("int").alias("next_regime"), F.col("prediction").cast("int").alias("predicted_regime"),
        F.array_max(vector_to_array("probability")).alias("confidence"), (F.col("label") == F.col("prediction")).alias("matches"), (F.col("swing_no") > 0.8 * F.col("_n")).alias("held_out"))
    return out, [(c, float(v)) for c, v in zip([*cols, "regime"], model.featureImportances.toArray(), strict=True)]


def next_regime(swings: DataFrame, regimes: DataFrame, trees: int = 100, depth: int = 6, seed: int = 42, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, float]:
    """Importances and accuracy on the held-out swings of ``predicted_regimes``."""
    out, rows = predicted_regimes(swings, regimes, trees, depth, seed, block_rows)
    acc = out.where("held_out").agg(F.avg(F.col("matches").cast("int"))).first()[0]
    return swings.sparkSession.createDataFrame(rows, "feature string, importance double"), float(acc or 0.0)


# ---- window clustering ----
WINDOW_FEATURES = ("parkinson_vol", "robust_slope", "log_slope")


def complete(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows whose features are all finite numbers; windows with a price of 0 have none."""
    for c in features:
        rows = rows.where(F.abs(c) < float("inf"))
    return rows


def fit_window_model(rows: DataFrame, features: Sequence[str] = WINDOW_FEATURES, k: int = 3, variance: float = 0.95, restarts: int = 3, seed: int = 42) -> PipelineModel:
    """Scaling, components for 95 % of the variance, then the likeliest of several Gaussian mixtures."""
    clean = complete(rows, features)
    base = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]).fit(clean)
    scaled = base.transform(clean)
    full = PCA(k=len(features), inputCol="scaled", outputCol="pc").fit(scaled)
    keep = int(np.searchsorted(np.cumsum(full.explainedVariance.toArray()), variance) + 1)
    pca = PCA(k=min(keep, len(features)), inputCol="scaled", outputCol="pc").fit(scaled)
    pcs = cut_lineage(pca.transform(scaled).select("pc"))
    best = max((GaussianMixture(k=k, featuresCol="pc", predictionCol="cluster", probabilityCol="probability", seed=seed + r).fit(pcs) for r in range(restarts)),
               key=lambda m: m.summary.logLikelihood)
    return PipelineModel(stages=[*base.stages, pca, best])


def predict_windows(model: PipelineModel, rows: DataFrame, features: Sequence[str] = WINDOW_FEATURES, sort_by: str | None = None) -> DataFrame:
    """Clusters renumbered by their mean of the first feature, with the probability of the chosen one."""
    p = cut_lineage(model.transform(complete(rows, features)).withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("raw", "scaled", "pc", "probability"))
    order = p.groupBy("cluster").agg(F.avg(sort_by or features[0]).alias("_m"))
    order = order.select("cluster", (F.row_number().over(Window.orderBy("_m")) - 1).alias("regime"))
    return p.join(order, "cluster").drop("cluster")


def _mixture(x: np.ndarray, k: int, starts: int, r: np.random.Generator, steps: int = 100, tolerance: float = 1e-3, ridge: float = 1e-6):
    """Full-covariance Gaussian mixture of a few hundred rows, the likeliest of ``starts``: weights, means, Cholesky factors."""
    n, d = x.shape

    def density(rows, w, m, c):
        z = np.stack([np.linalg.solve(f, (rows - mu).T).T for mu, f in zip(m, c)], 1)
        return np.log(w) - 0.5 * (z**2).sum(2) - np.log(np.abs(np.diagonal(c, axis1=1, axis2=2))).sum(1) - 0.5 * d * np.log(2 * np.pi)

    best = None
    for _ in range(starts):
        # spread-out first centres, each row then belongs to the nearest
        centres = [x[r.integers(n)]]
        while len(centres) < k:
            far = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(x[r.choice(n, p=far / far.sum())] if far.sum() > 0 else x[r.integers(n)])
        resp = np.eye(k)[np.argmin([((x - c) ** 2).sum(1) for c in centres], axis=0)]
        before = -np.inf
        for _ in range(steps):
            mass = resp.sum(0) + 10 * np.finfo(float).eps
            w, m = mass / n, resp.T @ x / mass[:, None]
            c = np.stack([np.linalg.cholesky((resp[:, j, None] * (x - m[j])).T @ (x - m[j]) / mass[j] + ridge * np.eye(d)) for j in range(k)])
            lp = density(x, w, m, c)
            total = np.logaddexp.reduce(lp, axis=1)
            resp = np.exp(lp - total[:, None])
            if total.mean() - before < tolerance:
                break
            before = total.mean()
        if best is None or total.mean() > best[0]:
            best = (total.mean(), w, m, c)
    _, w, m, c = best

    def posterior(rows: np.ndarray) -> np.ndarray:
        lp = density(rows, w, m, c)
        return np.exp(lp - np.logaddexp.reduce(lp, axis=1)[:, None])

    return posterior


def _fold(features: list[str], keep: list[str], k: int, starts: int, variance: float, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn", ignore_index=True)
        train, test = pdf[~pdf["_test"]], pdf[pdf["_test"]]
        out = test[[*keep, "fold"]].copy()
        x = train[features].to_numpy(float)
        if len(x) < max(k, 2) or test.empty:
            out["regime"], out["confidence"] = -1, 0.0
            return out
        mean, scale = x.mean(0), x.std(0, ddof=1)
        scale[scale == 0] = 1.0
        z = (x - mean) / scale
        _, sizes, axes = np.linalg.svd(z, full_matrices=False)
        share = np.cumsum(sizes**2) / max((sizes**2).sum(), 1e-300)
        axes = axes[: min(int(np.searchsorted(share, variance)) + 1, len(axes))]
        posterior = _mixture(z @ axes.T, k, starts, np.random.default_rng(seed + int(pdf["fold"].iat[0])))
        own = posterior(z @ axes.T)
        order = np.argsort((own * x[:, :1]).sum(0) / np.maximum(own.sum(0), 1e-300), kind="stable")
        p = posterior((test[features].to_numpy(float) - mean) / scale @ axes.T)[:, order]
        out["regime"], out["confidence"] = p.argmax(1), p.max(1)
        return out

    return run


def walk_forward_windows(rows: DataFrame, train: int = 500, test: int = 100, k: int = 3, features: Sequence[str] = WINDOW_FEATURES, starts: int = 3,
                         variance: float = 0.95, seed: int = 42) -> DataFrame:
    """Refit on each run of ``train`` rows of a series and predict its next ``test``: fold, regime and confidence of every row after the first run.

    A row is handed to the folds it trains (``train / test`` of them at most) and the one it tests; each (series, fold) is one bounded
    group in which mixture and prediction are made, so folds of all series run side by side. Regimes are numbered by the training
    rows' mean of the first feature. A fold with fewer complete rows than regimes gives regime -1; a series without a fold gives nothing.
    """
    features, keep = list(features), [c for c in rows.columns]
    n = cut_lineage(number_rows(rows))
    last = n.groupBy(*SERIES).agg(F.max("_rn").alias("_n"))
    own = F.when(F.col("_rn") > train, F.floor((F.col("_rn") - train - 1) / test))
    first, final = F.greatest(F.lit(0), F.ceil((F.col("_rn") - train) / test)), F.least(F.floor((F.col("_rn") - 1) / test), F.floor((F.col("_n") - train - 1) / test))
    trains = F.when(final >= first, F.sequence(first, final)).otherwise(F.array().cast("array<bigint>"))
    parts = F.concat(F.transform(trains, lambda f: F.struct(f.alias("fold"), F.lit(False).alias("_test"))),
                     F.when(own.isNotNull(), F.array(F.struct(own.alias("fold"), F.lit(True).alias("_test")))).otherwise(F.array().cast("array<struct<fold: bigint, _test: boolean>>")))
    x = complete(n, features).join(last, list(SERIES)).withColumn("_p", F.explode(parts)).select(*keep, "_rn", "_p.fold", "_p._test")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", fold bigint, regime int, confidence double"
    return x.groupBy(*SERIES, "fold").applyInPandas(_fold(features, keep, k, starts, variance, seed), schema)


def dwell(rows: DataFrame, regime: str = "regime", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Switches and mean bars per stay."""
    b = to_blocks(rows.select(*SERIES, "ts", regime), 1, block_rows=block_rows)
    w = Window.partitionBy(*SERIES, "_blk").orderBy("_rn")
    x = core_rows(b.withColumn("_sw", F.coalesce((F.col(regime) != F.lag(regime).over(w)).cast("int"), F.lit(0))))
    return x.groupBy(*SERIES).agg(F.sum("_sw").alias("switches"), F.count(F.lit(1)).alias("bars")).withColumn("mean_dwell", F.col("bars") / (F.col("switches") + 1))


# Trading mode, stop multiple and risk share by regime; regime 0's row below half confidence.
ACTIONS = {0: ("conservative", 1.0, 0.005), 1: ("flat", 1.0, 0.0), 2: ("aggressive", 2.5, 0.02)}
CAUTIOUS = ACTIONS[0]


def action(regime: Column, confidence: Column) -> Column:
    row = lambda v: F.struct(F.lit(v[0]).alias("mode"), F.lit(v[1]).alias("stop_multiple"), F.lit(v[2]).alias("risk"))
    out = row(CAUTIOUS)
    for k, v in ACTIONS.items():
        out = F.when((regime == k) & (confidence >= 0.5), row(v)).otherwise(out)
    return out

