"""Toxicity by class-conditional Kneser-Ney models.

Two character models of order 5, one of toxic and one of ordinary labelled text, predict each symbol of a word from the four before
it. Their own counts are discounted and interpolated with one shared lower-order model, whose Kneser-Ney continuation counts come
from all documents, labelled or not: a rare expression falls back on the same counts in both classes and speaks for neither. A
document is compared by its length-normalised log-likelihoods: the mean difference over the text and over its best window. A
logistic curve over the two, fitted on a bounded sample of training rows by counts without them, turns them into a score.

A symbol is the boundary or one of 26 classes of bytes (letters without case; bytes of other alphabets fold into the same range), so
a model is at most 27 ** 5 counts, which bounds what is gathered and broadcast whatever the corpus holds. Counts cover every text
and, per class, every labelled row outside the held-out fold; only the curve is fitted on a sample of at most ``max_fit`` ids.

Defined results: a null text counts as empty; a text without letters has the score of two equal likelihoods; rows that repeat a
doc_id are scored by their own texts; a null doc_id is never held out and has no label; without labels of both classes every score
is the share of toxic rows (0 if there are none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import fold, saved, small_batches
from .words import _SPACES, blocks

BASE, ORDER = 27, 5
CODES = BASE**ORDER
WINDOW = 32
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 1 + (np.arange(128, 256) & 31) % 26
_STOP = np.zeros(256, bool)
_STOP[list(_SPACES)] = True


def coded(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Block by block: the text index and the 5-symbol code of each letter and each end of a word; contexts stay within a word."""
    parts = [(t or "").encode() + b"\n" for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    for lo, hi in blocks(data, bounds, _STOP):
        s = _SYMBOL[data[lo:hi]]
        code, alive = s.copy(), np.ones(len(s), bool)
        for back in range(1, ORDER):
            before = np.zeros_like(s)
            before[back:] = s[:-back]
            alive &= before != 0
            code += np.where(alive, before, 0) * BASE**back
            if back == 1:
                keep = (s != 0) | alive
        at = np.flatnonzero(keep)
        yield np.searchsorted(bounds, at + lo, side="right") - 1, code[at]


def count_rows(docs: DataFrame) -> DataFrame:
    """(code, toxic, ordinary) from (text, label): all codes seen, with their counts in the two classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CODES, bool)
        counts = np.zeros((2, CODES), np.int32)
        for batch in batches:
            label = np.array([-1 if y is None else y for y in batch.column(1).to_pylist()])
            for at, code in coded(batch.column(0).to_pylist()):
                seen[code] = True
                for y in (0, 1):
                    mine = code[label[at] == y]
                    if len(mine):
                        np.add.at(counts[y], mine, 1)
        found = np.flatnonzero(seen)
        for a in range(0, len(found), 100_000):
            c = found[a: a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(counts[1, c].astype(np.int64)), pa.array(counts[0, c].astype(np.int64))], ["code", "toxic", "ordinary"])

    return docs.select("text", "label").mapInArrow(work, "code int, toxic long, ordinary long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def shared_model(code: np.ndarray, d: float = 0.75) -> np.ndarray:
    """Continuation probabilities p(symbol | three before it) of shape (27 ** 3, 27) from the distinct codes of all texts."""
    p = np.full((1, BASE), 1 / BASE)
    seen = [np.bincount(code % BASE ** (ORDER - 1), minlength=BASE ** (ORDER - 1))]
    for k in range(ORDER - 2, 0, -1):
        seen.append(np.bincount(np.flatnonzero(seen[-1]) % BASE**k, minlength=BASE**k))
    for n in reversed(seen):
        n = n.reshape(-1, BASE).astype(float)
        total = n.sum(axis=1, keepdims=True)
        lower = np.tile(p, (n.shape[0] // p.shape[0], 1))
        p = np.where(total > 0, np.maximum(n - d, 0) / np.maximum(total, 1) + d * (n > 0).sum(axis=1, keepdims=True) / np.maximum(total, 1) * lower, lower)
    return p


def ratios(code: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """log p(symbol | context, toxic) - log p(symbol | context, ordinary) for every code."""
    lower = shared_model(code)
    out = np.zeros(CODES, np.float32)
    order = np.argsort(code)
    code, classes = code[order], (toxic[order], ordinary[order])
    discounts = []
    for c in classes:
        one, two = (c == 1).sum(), (c == 2).sum()
        discounts.append(one / (one + 2 * two) if one and two else 0.75)
    slab = CODES // BASE
    for lead in range(BASE):
        a, b = np.searchsorted(code, [lead * slab, (lead + 1) * slab])
        at = code[a:b] - lead * slab
        for sign, c, d in zip((1, -1), classes, discounts):
            n = np.zeros(slab)
            n[at] = c[a:b]
            n = n.reshape(-1, BASE)
            total = n.sum(axis=1, keepdims=True)
            p = np.where(total > 0, np.maximum(n - d, 0) / np.maximum(total, 1) + d * (n > 0).sum(axis=1, keepdims=True) / np.maximum(total, 1) * lower, lower)
            out[lead * slab: (lead + 1) * slab] += (sign * np.log(p)).ravel().astype(np.float32)
    return out.astype(np.float16)


def compared(docs: DataFrame, table: np.ndarray, text: str, doc_id: str) -> DataFrame:
    """(doc_id, mean, best): the mean log ratio of a symbol over the text and over its best window of ``WINDOW`` symbols.

    Windows do not cross the cuts at white space that blocks of a very long text have.
    """
    known = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = known.value
        for batch in batches:
            n = batch.num_rows
            total, size, best = np.zeros(n), np.zeros(n), np.full(n, -np.inf)
            for at, code in coded(batch.column(1).to_pylist()):
                if not len(at):
                    continue
                r = ratio[code].astype(np.float64)
                total += np.bincount(at, r, n)
                size += np.bincount(at, minlength=n)
                run = np.concatenate([[0], np.cumsum(r)])
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                start = np.repeat(first, np.diff(np.append(first, len(at))))
                from_ = np.maximum(start, np.arange(1, len(at) + 1) - WINDOW)
                np.maximum.at(best, at[first], np.maximum.reduceat((run[1:] - run[from_]) / WINDOW, first))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total / np.maximum(size, 1)), pa.array(np.where(size > 0, best, 0.0))], ["doc_id", "mean", "best"])

    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, mean double, best double")


def curve(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept, which the ridge leaves free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    hold = np.eye(len(w)) * ridge
    hold[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def with_labels(texts: DataFrame, train: DataFrame, folds: int, held: int) -> DataFrame:
    """(text, label) of all of ``texts``: the label from ``train``, null for rows without one.

    Held-out rows and rows without an id have no label and stay where they are; the others meet the labels by a merge join at any
    size, so what is moved is the same share of the texts on a small and on a large table.
    """
    apart = F.coalesce(fold("__id", folds) == held, F.lit(True))
    found = texts.filter(~apart).join(train.hint("merge"), F.col("__id") == F.col("id"), "left").select("text", "label")
    return found.unionAll(texts.filter(apart).select("text", F.lit(None).cast(train.schema["label"].dataType).alias("label")))


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 4, held: int = 2, threshold: float = 0.3, max_fit: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted; ``labels`` has doc_id and toxic."""
    small_batches(docs.sparkSession)
    train = labels.select(F.col("doc_id").alias("id"), F.col("toxic").alias("label")).filter((fold("id", folds) != held) & F.col("label").isin(0, 1)).dropDuplicates(["id"])
    # at most max_fit rows of one training row in four fit the curve, on ratios of counts without them; the final ratios count every training row
    fits = train.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)) == 0).orderBy(F.xxhash64("id", F.lit(9)), "id").limit(max_fit)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    rows = count_rows(with_labels(texts, train, folds, held)).toPandas().sort_values("code")
    fitting = saved(texts.join(F.broadcast(fits), F.col("__id") == F.col("id")), "fitting")
    less = count_rows(fitting).toPandas().set_index("code").reindex(rows["code"], fill_value=0)
    code, toxic, ordinary = rows["code"].to_numpy(np.int64), rows["toxic"].to_numpy(float), rows["ordinary"].to_numpy(float)
    without = ratios(code, toxic - less["toxic"].to_numpy(float), ordinary - less["ordinary"].to_numpy(float))
    sample = compared(fitting, without, "text", "__id").join(fits, F.col("doc_id") == F.col("id")).select("mean", "best", "label").collect()
    x = saved(compared(docs, ratios(code, toxic, ordinary), text, doc_id), "compared")
    a = np.array([tuple(r) for r in sample]).reshape(-1, 3)
    share = float(a[:, 2].mean()) if len(a) else 0.0
    if 0 < share < 1:
        centre, scale = a[:, :2].mean(axis=0), a[:, :2].std(axis=0) + 1e-9
        w = curve((a[:, :2] - centre) / scale, a[:, 2])
        z = sum(((F.col(c) - float(centre[i])) / float(scale[i]) * float(w[i]) for i, c in enumerate(("mean", "best"))), F.lit(float(w[2])))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    else:
        score = F.lit(share)
    out = x.select("doc_id", F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), score.alias("score"))
    return out.select(F.col("doc_id").alias(doc_id), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
