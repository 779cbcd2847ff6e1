"""Gaussian hidden Markov chains over series of any length, exact across blocks.

A step of the chain is a k x k matrix: transition probabilities times the density of the row. The product of a block's matrices says
what the block does to any state it is entered with, so blocks are reduced to one matrix each, independently; products of these, one
row per block and series, give the state every block is entered with and what follows it; then each block runs for itself from the
true values. Forward-backward uses sums of products, the most likely path the same with maxima of sums. Inside a block the same is
done once more with chunks of rows, so Python steps over the rows of one chunk while numpy works on all chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.blocks import BLOCK_ROWS, SERIES, number_rows
from barloom.session import cut_lineage

CHUNK = 128
LEAST_VARIANCE, TOLERANCE, MOST_STEPS, STATES = 1e-2, 1e-2, 200, 6


@dataclass
class Chain:
    means: np.ndarray
    var: np.ndarray
    trans: np.ndarray
    start: np.ndarray


def log_density(x: np.ndarray, m: Chain) -> np.ndarray:
    return -0.5 * (np.log(2 * math.pi * m.var).sum(1) + (((x[:, None, :] - m.means) ** 2) / m.var).sum(2))


def _chunks(lp: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as (chunks, steps): log densities, which steps are rows, and which keep the state they are entered with (a series' first)."""
    n, k = lp.shape
    steps = min(CHUNK, max(1, n))
    c = -(-n // steps)
    out = np.zeros((c * steps, k))
    out[:n] = lp
    real = np.arange(c * steps) < n
    stay = ~real
    if first:
        stay = stay | (np.arange(c * steps) == 0)
    return out.reshape(c, steps, k), real.reshape(c, steps), stay.reshape(c, steps)


def _products(lp: np.ndarray, stay: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product of the steps of each chunk, scaled to a largest entry of 1, and the logarithms of the scales."""
    c, steps, k = lp.shape
    t = np.tile(np.eye(k), (c, 1, 1))
    scale = np.zeros(c)
    top = lp.max(2)
    e = np.exp(lp - top[..., None])
    for s in range(steps):
        moved = np.where(stay[:, s, None, None], t, t @ trans)
        t = moved * e[:, s, None, :]
        most = np.maximum(t.max((1, 2)), 1e-300)
        t /= most[:, None, None]
        scale += np.log(most) + top[:, s]
    return t, scale


def _longest(lp: np.ndarray, stay: np.ndarray, log_trans: np.ndarray) -> np.ndarray:
    """The same with maxima of sums: the best path of each chunk from any state to any."""
    c, steps, k = lp.shape
    none = np.full((k, k), -np.inf)
    np.fill_diagonal(none, 0.0)
    t = np.tile(none, (c, 1, 1))
    for s in range(steps):
        step = np.where(stay[:, s, None, None], none, log_trans)
        t = (t[:, :, :, None] + step[:, None, :, :]).max(2) + lp[:, s, None, :]
    return t


def _reduce(model: Chain, cols: list[str]):
    """A block to its two matrices."""
    k = len(model.means)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        lp, _, stay = _chunks(log_density(pdf[cols].to_numpy(float), model), pdf["_rn"].iat[0] == 1)
        t, scale = _products(lp, stay, model.trans)
        best = _longest(lp, stay, np.log(model.trans + 1e-300))
        whole, log_scale, path = np.eye(k), 0.0, None
        for one, s, p in zip(t, scale, best):
            whole = whole @ one
            most = max(whole.max(), 1e-300)
            whole, log_scale = whole / most, log_scale + s + math.log(most)
            path = p if path is None else (path[:, :, None] + p[None]).max(1)
        key = pdf[[*SERIES, "_blk"]].iloc[:1].reset_index(drop=True)
        return key.assign(t=[whole.ravel().tolist()], scale=[log_scale], path=[path.ravel().tolist()])

    return run


def _connect(model: Chain):
    """Blocks of one series in order: what each is entered with and followed by, its path's ends, the series' log-likelihood."""
    k = len(model.means)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ignore_index=True)
        mats = [np.array(v).reshape(k, k) for v in pdf["t"]]
        paths = [np.array(v).reshape(k, k) for v in pdf["path"]]
        a, ll, entered = model.start, 0.0, []
        for t, s in zip(mats, pdf["scale"]):
            entered.append(a.tolist())
            a = a @ t
            total = max(a.sum(), 1e-300)
            a, ll = a / total, ll + math.log(total) + s
        b, followed = np.ones(k), []
        for t in reversed(mats):
            followed.append(b.tolist())
            b = t @ b
            b = b / max(b.max(), 1e-300)
        d = [np.log(model.start + 1e-300)]
        for p in paths:
            d.append((d[-1][:, None] + p).max(0))
        ends = [int(d[-1].argmax())]
        for p, before in zip(reversed(paths), reversed(d[:-1])):
            ends.append(int((before + p[:, ends[-1]]).argmax()))
        ends = ends[::-1]
        out = pdf[[*SERIES, "_blk"]].assign(entered=entered, followed=followed[::-1], path_in=ends[:-1], path_out=ends[1:], ll=0.0)
        out.loc[0, "ll"] = ll
        return out

    return run


def _posterior(lp, real, stay, model: Chain, entered: np.ndarray, followed: np.ndarray):
    """Scaled forward and backward values of all rows of a block, and the step counts of transitions."""
    c, steps, k = lp.shape
    t, _ = _products(lp, stay, model.trans)
    heads, tails = np.empty((c, k)), np.empty((c, k))
    a, b = entered, followed
    for i in range(c):
        heads[i] = a
        a = a @ t[i]
        a = a / max(a.sum(), 1e-300)
        j = c - 1 - i
        tails[j] = b
        b = t[j] @ b
        b = b / max(b.max(), 1e-300)
    e = np.exp(lp - lp.max(2, keepdims=True))
    alpha, beta = np.empty((c, steps, k)), np.empty((c, steps, k))
    now = heads
    for s in range(steps):
        now = np.where(stay[:, s, None], now, now @ model.trans) * e[:, s]
        now = now / np.maximum(now.sum(1, keepdims=True), 1e-300)
        alpha[:, s] = now
    now = tails
    xi = np.zeros((k, k))
    for s in range(steps - 1, -1, -1):
        beta[:, s] = now
        ahead = e[:, s] * now
        before = alpha[:, s - 1] if s else heads
        moves = real[:, s] & ~stay[:, s]
        m = before[:, :, None] * model.trans * ahead[:, None, :]
        xi += (m / np.maximum(m.sum((1, 2), keepdims=True), 1e-300))[moves].sum(0)
        now = np.where(stay[:, s, None], ahead, ahead @ model.trans.T)
        now = now / np.maximum(now.max(1, keepdims=True), 1e-300)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-300)
    return gamma, xi


def _expect(model: Chain, cols: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn")
        x, first = pdf[cols].to_numpy(float), pdf["_rn"].iat[0] == 1
        lp, real, stay = _chunks(log_density(x, model), first)
        gamma, xi = _posterior(lp, real, stay, model, np.array(pdf["entered"].iat[0]), np.array(pdf["followed"].iat[0]))
        g = gamma.reshape(-1, gamma.shape[2])[: len(x)]
        begin = g[0] if first else np.zeros(g.shape[1])
        return pd.DataFrame({"sums": [np.concatenate([[pdf["ll"].iat[0]], begin, g.sum(0), (g.T @ x).ravel(), (g.T @ x**2).ravel(), xi.ravel()]).tolist()]})

    return run


def _decode(model: Chain, cols: list[str], keep: list[str]):
    """Most likely state of each row of a block, with its posterior probability."""
    log_trans = np.log(model.trans + 1e-300)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn", ignore_index=True)
        x = pdf[cols].to_numpy(float)
        lp, real, stay = _chunks(log_density(x, model), pdf["_rn"].iat[0] == 1)
        gamma, _ = _posterior(lp, real, stay, model, np.array(pdf["entered"].iat[0]), np.array(pdf["followed"].iat[0]))
        c, steps, k = lp.shape
        chunk = _longest(lp, stay, log_trans)
        # states at the chunks' ends: forward from the block's entry, back from its end
        d = [np.where(np.arange(k) == pdf["path_in"].iat[0], 0.0, -np.inf)]
        for p in chunk:
            d.append((d[-1][:, None] + p).max(0))
        ends = [int(pdf["path_out"].iat[0])]
        for p, before in zip(chunk[::-1], d[-2::-1]):
            ends.append(int((before + p[:, ends[-1]]).argmax()))
        ends = np.array(ends[::-1])
        none = np.full((k, k), -np.inf)
        np.fill_diagonal(none, 0.0)
        now = np.where(np.arange(k) == ends[:-1, None], 0.0, -np.inf)
        back = np.empty((c, steps, k), dtype=int)
        for s in range(steps):
            w = now[:, :, None] + np.where(stay[:, s, None, None], none, log_trans)
            back[:, s] = w.argmax(1)
            now = w.max(1) + lp[:, s]
        states = np.empty((c, steps), dtype=int)
        at = ends[1:]
        for s in range(steps - 1, -1, -1):
            states[:, s] = at
            at = back[np.arange(c), s, at]
        out = pdf[keep].copy()
        out["regime"] = states.ravel()[: len(x)]
        out["probability"] = gamma.reshape(-1, k).max(1)[: len(x)]
        return out

    return run


def _standard(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Columns to mean 0 and variance 1; a missing value is the mean."""
    st = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return rows.withColumns({c: F.coalesce((F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"] or 1.0), F.lit(0.0)) for c in cols})


class _Blocks:
    """Standardised rows in blocks, reduced and connected under a model."""

    def __init__(self, rows: DataFrame, cols: list[str], keep: list[str], order: str, block_rows: int):
        numbered = _standard(rows.select(*keep, *cols), cols)
        numbered = numbered.withColumn("_rn", F.col(order)) if order in ("swing_no",) else number_rows(numbered, order=order)
        self.cols, self.keep = cols, keep
        self.rows = cut_lineage(numbered.withColumn("_blk", F.floor((F.col("_rn") - 1) / block_rows)).repartition(*SERIES, "_blk"))

    def connected(self, model: Chain) -> DataFrame:
        types = {c: self.rows.schema[c].dataType.simpleString() for c in (*SERIES, "_blk")}
        key = ", ".join(f"{c} {t}" for c, t in types.items())
        reduced = self.rows.groupBy(*SERIES, "_blk").applyInPandas(_reduce(model, self.cols), f"{key}, t array<double>, scale double, path array<double>")
        joints = reduced.groupBy(*SERIES).applyInPandas(_connect(model), f"{key}, entered array<double>, followed array<double>, path_in int, path_out int, ll double")
        return self.rows.join(joints, [*SERIES, "_blk"])


def fit_chain(rows: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), order: str = "swing_no", states: int = STATES, steps: int = MOST_STEPS,
              tolerance: float = TOLERANCE, seed: int = 42, block_rows: int = BLOCK_ROWS, centers: np.ndarray | None = None) -> tuple[DataFrame, dict]:
    """Diagonal Gaussian chain by expectation maximisation until the log-likelihood gains less than ``tolerance``; every row's state.

    One model for all series, each a chain of its own, begun at ``centers`` of the standardised rows or those of k-means. With fewer than five rows per state there are fewer states, at least two. Only
    sums per state reach the driver.
    """
    cols, keep = list(cols), list(dict.fromkeys([*SERIES, *keep, order]))
    blocks = _Blocks(rows, cols, keep, order, block_rows)
    n = blocks.rows.count()
    k, d = (states if n >= 5 * states else max(2, n // 5)), len(cols)
    out_schema = ", ".join(f"{c} {blocks.rows.schema[c].dataType.simpleString()}" for c in keep) + ", regime int, probability double"
    if n < k:
        return rows.sparkSession.createDataFrame([], out_schema), {"means": np.zeros((0, d)), "var": np.zeros((0, d)), "transitions": np.zeros((0, 0)), "log_likelihood": []}
    means = centers
    if means is None:
        vec = VectorAssembler(inputCols=cols, outputCol="features").transform(blocks.rows)
        means = np.array(KMeans(k=k, seed=seed).fit(vec).clusterCenters())
    k = len(means)
    model = Chain(means, np.full((k, d), n / max(n - 1, 1) + LEAST_VARIANCE), np.full((k, k), 1 / k), np.full(k, 1 / k))
    history: list[float] = []
    for _ in range(steps):
        sums = blocks.connected(model).groupBy(*SERIES, "_blk").applyInPandas(_expect(model, cols), "sums array<double>")
        totals = sums.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).collect()
        flat = np.array([r["total"] for r in sorted(totals, key=lambda r: r["pos"])])
        ll, b, w, s, q, xi = np.split(flat, np.cumsum([1, k, k, k * d, k * d]))
        history.append(float(ll[0]))
        mass = np.maximum(w, 1e-5)[:, None]
        means = s.reshape(k, d) / mass
        spread = q.reshape(k, d) - 2 * means * s.reshape(k, d) + means**2 * w[:, None]
        moves = xi.reshape(k, k)
        left = moves.sum(1, keepdims=True)
        model = Chain(means, (np.maximum(spread, 0) + LEAST_VARIANCE) / mass, np.where(left > 0, moves / np.maximum(left, 1e-300), 1 / k), b / b.sum())
        if len(history) > 1 and history[-1] - history[-2] < tolerance:
            break
    decoded = blocks.connected(model).groupBy(*SERIES, "_blk").applyInPandas(_decode(model, cols, keep), out_schema)
    return decoded, {"means": model.means, "var": model.var, "transitions": model.trans, "start": model.start, "log_likelihood": history}
