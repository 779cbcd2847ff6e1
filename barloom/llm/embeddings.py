"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine >= c lie within squared distance B = 2 - 2c. They are rotated and split into blocks; a block of b of d
dimensions has the proportional budget B * b / d, and a pair within B keeps within the budget of at least one block. Each block is
range-joined on a grid over its first dimensions with cells as wide as the budget's root, so that partners lie in the same or a
neighbouring cell. Candidates of all blocks are checked exactly, on the cosine of the given vectors in double precision.

Links are counted where they are found: the first block whose budget a pair keeps owns the pair, so no pair is written out, none is
counted twice, and a task passes on one count and one neighbour of its component per vector. Equal vectors collapse first and count
with their number. A cell of more than ``tile`` vectors is split into tiles, and each pair of tiles is a task of its own.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null label or a null
vec_id, link with nothing (component_id = vec_id, kept); vectors of different length never link; rows that repeat a vec_id are
judged by their own vectors; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import connected_components, saved, small_batches

BLOCKS = 8
GRID = 2
TILE = 2000
_SLACK = 1e-6


@lru_cache
def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]


def spans(d: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, d, min(blocks, d) + 1).astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Rotated unit vectors, rounded so that they are the same in every task."""
    return np.round(vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None] @ rotation(vectors.shape[1]), 9)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def linked(rows: pa.Table, block: int, d: int, cosine: float, blocks: int) -> pa.Table:
    """Counts and component neighbours from the links that ``block`` owns between the home and the guest rows of a cell."""
    v, r, m = _matrix(rows["embedding"].combine_chunks(), d), rows["r"].to_numpy(), rows["m"].to_numpy()
    guest, same = rows["guest"].to_numpy(zero_copy_only=False), rows["same"].to_numpy(zero_copy_only=False)
    y, cuts, budget = rotated(v), spans(d, blocks), 2 - 2 * cosine
    kept = [budget * (b - a) / d + _SLACK for a, b in cuts]
    home, other = np.flatnonzero(~guest), np.flatnonzero(guest)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    a, b = cuts[block]
    z = y[other, a:b]
    for at in range(0, len(home), 256):
        h = home[at: at + 256]
        x = y[h, a:b]
        near = (x * x).sum(axis=1)[:, None] + (z * z).sum(axis=1) - 2 * x @ z.T <= kept[block] + _SLACK
        i, j = np.nonzero(near)
        i, j = h[i], other[j]
        ok = (((y[i, a:b] - y[j, a:b]) ** 2).sum(axis=1) <= kept[block]) & (~same[j] | (r[i] < r[j])) & (r[i] != r[j])
        i, j = i[ok], j[ok]
        for e, f in cuts[:block]:
            ok = ((y[i, e:f] - y[j, e:f]) ** 2).sum(axis=1) > kept[cuts.index((e, f))]
            i, j = i[ok], j[ok]
        p, q = v[i], v[j]
        ok = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))) >= cosine
        left.append(i[ok])
        right.append(j[ok])
    i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    n, low = np.zeros(len(r), np.int64), r.copy()
    np.add.at(n, i, m[j])
    np.add.at(n, j, m[i])
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (before == low).all():
            break
    hit = n > 0
    return pa.table({"r": r[hit], "n": n[hit], "low": low[hit]})


def near_vectors(vectors: DataFrame, cosine: float = 0.98, blocks: int = BLOCKS, grid: int = GRID, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for (vec_id, embedding, label): vectors of one label with at least ``cosine`` are linked."""
    small_batches(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", "label")
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.coalesce(
        F.exists(e, lambda x: x != 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    classes = saved(rows.filter(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("r"), F.count("*").alias("m")), "vectors")
    label = rows.schema["label"].dataType.simpleString()
    key = ["label", "d", "block", "cell"]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes):
                some = batch.filter(pa.array(sizes == d))
                y = rotated(_matrix(some.column("embedding"), int(d)))
                for j, (a, b) in enumerate(spans(int(d), blocks)):
                    wide = np.sqrt((2 - 2 * cosine) * (b - a) / d + 2 * _SLACK)
                    at = np.floor(y[:, a: min(b, a + grid)] / wide).astype(np.int64)
                    steps = [s for s in product((-1, 0, 1), repeat=at.shape[1]) if s >= (0,) * at.shape[1]]
                    for guest, step in [(False, (0,) * at.shape[1]), *((True, s) for s in steps)]:
                        cell = ((at + step + (1 << 19)) * ((1 << 20) ** np.arange(at.shape[1]))).sum(axis=1)
                        n = len(cell)
                        yield pa.RecordBatch.from_arrays(
                            [some.column("r"), some.column("label"), pa.array(np.full(n, d, np.int32)), pa.array(np.full(n, j, np.int32)), pa.array(cell),
                             pa.array(np.full(n, guest)), pa.array(np.full(n, guest and not any(step)))], ["r", *key, "guest", "same"])

    spread = saved(classes.select("r", "label", F.size("embedding").alias("d"), "embedding").mapInArrow(
        cells, f"r long, label {label}, d int, block int, cell long, guest boolean, same boolean"), "cells")
    crowded = spread.groupBy(*key).agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests")).filter("homes > 0 and guests > 1")
    parts = lambda c: F.ceil(F.col(c) / tile).cast("int")
    tiled = spread.join(crowded.select(*key, parts("homes").alias("p"), parts("guests").alias("q")), key)
    own = F.pmod(F.xxhash64("r"), F.when(F.col("guest"), F.col("q")).otherwise(F.col("p"))).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("guest"), F.col("p")).otherwise(F.col("q")) - 1))
    tiled = tiled.select("*", own.alias("mine"), each.alias("theirs")).withColumns({
        "s": F.when(F.col("guest"), F.col("theirs")).otherwise(F.col("mine")), "t": F.when(F.col("guest"), F.col("mine")).otherwise(F.col("theirs"))})
    full = tiled.join(classes.select("r", "m", "embedding"), "r").select("r", "m", "embedding", *key, "guest", "same", "s", "t")

    def work(k: tuple, rows: pa.Table) -> pa.Table:
        return linked(rows, k[2].as_py(), k[1].as_py(), cosine, blocks)

    found = saved(full.groupBy(*key, "s", "t").applyInArrow(work, "r long, n long, low long"), "vector-links")
    counts = found.groupBy("r").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("r").alias("a"), F.col("low").alias("b")), "vectors-cc")
    named = classes.join(counts, "r", "left").join(comps.withColumnRenamed("node", "r"), "r", "left").select(
        F.col("label").alias("__label"), F.col("embedding").alias("__embedding"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "r").alias("component_id"))
    out = rows.withColumn("__sound", sound).join(named, F.col("__sound") & (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__embedding")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a) USING (vec_id)
"""
