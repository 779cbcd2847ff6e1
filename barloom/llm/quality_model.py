"""A quality classifier by positive-unlabelled learning.

Trusted positives are the labelled good documents outside the held-out fold; unlabelled text is what has no label at all. A linear
scorer over text statistics minimises the non-negative unbiased risk

    prior * R(positives as good) + max(0, R(unlabelled as bad) - prior * R(positives as bad))

with the logistic loss; where the second term falls below zero, the step goes the other way, so that it cannot be driven negative.
The prior is the estimated share of good documents, by default the share among labelled training rows. Labels of bad documents
enter nothing else, and id, language and source enter nothing at all.

Only the fit uses a sample: at most ``max_positive`` and ``max_unlabelled`` rows of statistics, by hash of the id. Statistics are
taken of every whole text in one pass.

Defined results: a null text counts as empty and is scored; rows that repeat a doc_id are scored by their own texts; a null doc_id
is never held out and has no label; without positives or unlabelled rows every score is the prior (0.5 if unknown); an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, saved, small_batches
from .words import utf8, word_hashes

STATISTICS = ["log_words", "word_bytes", "log_word_bytes", "distinct", "same_as_last", "top_word", "symbols", "bangs", "capitals", "digits", "stops", "other_marks", "line_words"]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_KINDS = [_table("#*$%&|<>"), _table("!?"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".,;:"), _table("\"'()[]{}+-/\\=@^_`~"), _table("\n")]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers per text."""
    data, bounds = utf8(column)
    hashes, words = word_hashes(column)
    n, size = np.diff(words), np.diff(bounds)
    some = size > 0
    counts = np.zeros((len(n), len(_KINDS)))
    if some.any():
        for k, t in enumerate(_KINDS):
            counts[some, k] = np.add.reduceat(t[data], bounds[:-1][some], dtype=np.int64)
    same = np.concatenate([[False], hashes[1:] == hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
    distinct, repeated, top = (np.zeros(len(n)) for _ in range(3))
    for i, (a, b) in enumerate(zip(words[:-1], words[1:])):
        if b > a:
            w = np.sort(hashes[a:b])
            edges = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
            distinct[i], top[i], repeated[i] = len(edges) - 1, np.diff(edges).max(), same[a + 1: b].sum()
    one, letters = np.maximum(n, 1), np.maximum(size, 1)
    mean = size / one
    return np.stack([np.log1p(n), np.minimum(mean, 30), np.log(np.maximum(mean, 1)), distinct / one, repeated / one, top / one, np.minimum(counts[:, 0] / one, 0.3), np.minimum(counts[:, 1] / one, 0.3),
                     counts[:, 2] / letters, counts[:, 3] / letters, np.minimum(counts[:, 4] / one, 3), np.minimum(counts[:, 5] / one, 3), np.log1p(n / (counts[:, 6] + 1))], axis=1)


def described(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, x array<double>")


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (the last is the intercept), means and scales."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    p, u = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        good = -prior * (p * sigmoid(-gp)[:, None]).mean(axis=0)
        bad = (u * sigmoid(gu)[:, None]).mean(axis=0) - prior * (p * sigmoid(gp)[:, None]).mean(axis=0)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        g = (good + bad if negative >= 0 else -bad) + decay * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w, mean, scale


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 5, held: int = 0, prior: float | None = None,
                   threshold: float = 0.3, max_positive: int = 20_000, max_unlabelled: int = 40_000) -> DataFrame:
    """doc_id, held_out, score, predicted; ``labels`` has doc_id and quality."""
    x = saved(described(docs, text, doc_id), "statistics")
    named = labels.select(F.col("doc_id").alias("id"), "quality").filter(F.col("id").isNotNull())
    train = named.filter((fold("id", folds) != held) & F.col("quality").isNotNull())
    if prior is None:
        prior = train.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        prior = 0.5 if prior is None else min(max(prior, 0.01), 0.99)
    pick = lambda rows, n: np.array([r[0] for r in rows.orderBy(F.xxhash64("doc_id", F.lit(5)), "x").limit(n).select("x").collect()])
    good = pick(x.join(train.filter("quality = 1"), F.col("doc_id") == F.col("id"), "left_semi"), max_positive)
    open_ = pick(x.join(named, F.col("doc_id") == F.col("id"), "left_anti"), max_unlabelled)
    if not len(good) or not len(open_):
        z = F.lit(float(np.log(prior / (1 - prior))))
    else:
        w, mean, scale = fit(good, open_, prior)
        z = F.lit(float(w[-1]))
        for i in range(len(mean)):
            z = z + F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("x")[i] - float(mean[i])) / float(scale[i]))) * float(w[i])
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    out = x.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.select(F.col("doc_id").alias(doc_id), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
