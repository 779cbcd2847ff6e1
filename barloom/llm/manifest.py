"""Merkle manifest of a dataset as a postorder append log.

Rows become leaves; the leaves of a group (a source) in order form a tree in which every three consecutive nodes have one parent, and
the trees' roots in the groups' order form one more tree, whose root stands for the dataset. Aligned builders take blocks of
``ARITY ** LEVELS`` leaves each and append nodes to a log as they complete: a leaf, then each parent that its last child closes. Where
a node stands in that log follows from subtree sizes alone,

    position(level, index) = nodes complete before its first leaf + size of its subtree - 1,

so the siblings on the way from a leaf to the root are addressed without pointers or a search. A log row holds the nodes of one
block, which are consecutive, or one node above the blocks; nodes above are built round by round from the blocks' last nodes. Proofs
are taken block by block: the part within a block from its own log row, the part above it once per block.

A tree is split over tasks however large it is, and no task holds more than one block. Trees and log are Parquet tables.

Defined results: a null value is framed as ``-``; null groups come first and are one group; leaves of a group ascend by the ordering
column, null first, and by digest where it repeats; equal rows have equal digests, so their order does not matter, and each has its
own proof; an empty text is framed as ``0:``; an empty table has no root and gives an empty result. Columns that are not named are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import CRC_TABLE, crc_sql, numbered, saved

ARITY, LEVELS = 3, 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_POWERS = "array(" + ", ".join(f"{ARITY**k}L" for k in range(40)) + ")"
_PATH = "array<struct<left: string, right: string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


# closed forms, once as SQL and once in Python

def _height(n: str) -> str:
    return f"size(filter({_POWERS}, p -> p < {n}))"


def _count(n: str, level: str) -> str:
    """Nodes of a level of a tree with ``n`` leaves."""
    return f"(({n} + {_POWERS}[{level}] - 1) div {_POWERS}[{level}])"


def _before(leaf: str) -> str:
    return f"aggregate({_POWERS}, 0L, (a, p) -> a + {leaf} div p)"


def _position(level: str, index: str, n: str) -> str:
    first = f"({index} * {_POWERS}[{level}])"
    own = f"least({_POWERS}[{level}], {n} - {first})"
    return f"({_before(first)} + aggregate(slice({_POWERS}, 1, {level} + 1), 0L, (a, p) -> a + ({own} + p - 1) div p) - 1)"


def height(n: int) -> int:
    k = 0
    while ARITY**k < n:
        k += 1
    return k


def before(leaf: np.ndarray | int) -> np.ndarray | int:
    """Nodes that are complete before this leaf is appended."""
    return sum(leaf // ARITY**k for k in range(40))


def position(level: int, index: np.ndarray | int, n: int) -> np.ndarray | int:
    first = index * ARITY**level
    own = np.minimum(ARITY**level, n - first)
    return before(first) + sum(-(-own // ARITY**k) for k in range(level + 1)) - 1


def appended(digests: list[str], up: int) -> Iterator[tuple[int, int, str]]:
    """Nodes over consecutive digests in the order in which they complete: (levels above, index, digest), up to ``up`` levels."""
    open_: list[list[str]] = [[] for _ in range(up + 1)]
    made = [0] * (up + 1)

    def close(k: int) -> tuple[int, int, str]:
        h = hashlib.sha256("".join(open_[k]).encode()).hexdigest()
        open_[k] = []
        open_[k + 1].append(h)
        made[k + 1] += 1
        return k + 1, made[k + 1] - 1, h

    for i, d in enumerate(digests):
        yield 0, i, d
        open_[0].append(d)
        k = 0
        while k < up and len(open_[k]) == ARITY:
            yield close(k)
            k += 1
    for k in range(up):
        if open_[k]:
            yield close(k)


_LOG = "tree string, level int, index long, n long, first long, digests binary"


def _build(base: int):
    """A builder over rows (tree, i, n, digest) that come block by block: its nodes as log rows."""

    def rows(tree: str, i: int, n: int, digests: list[str]) -> Iterator[tuple]:
        up = min(LEVELS, height(n) - base)
        nodes = list(appended(digests, up))
        if base == 0:
            yield tree, up, i // ARITY**LEVELS, n, before(i), bytes.fromhex("".join(h for _, _, h in nodes))
        else:
            for k, j, h in nodes:
                if k:
                    level, index = base + k, i // ARITY**k + j
                    yield tree, level, index, n, int(position(level, index, n)), bytes.fromhex(h)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("digests", pa.binary())])
        out: list[tuple] = []
        block, digests = None, []
        for batch in batches:
            for tree, i, n, digest in zip(*(c.to_pylist() for c in batch.columns)):
                if block is None or (tree, i // ARITY**LEVELS) != (block[0], block[1] // ARITY**LEVELS):
                    if block:
                        out.extend(rows(*block, digests))
                    block, digests = (tree, i, n), []
                digests.append(digest)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
                out = []
        if block:
            out.extend(rows(*block, digests))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return work


def _by_block(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"i div {ARITY**LEVELS}")).repartition("tree", "block").sortWithinPartitions("tree", "block", *more, "i")


def append_log(leaves: DataFrame, name: str = "manifest-log") -> DataFrame:
    """The log of all trees: ``leaves`` has tree, i (place in the tree), n (leaves of the tree) and digest; (tree, first) is its key."""
    log = saved(_by_block(leaves.select("tree", "i", "n", "digest")).select("tree", "i", "n", "digest").mapInArrow(_build(0), _LOG), name)
    base, most = LEVELS, log.agg(F.max("n")).first()[0] or 0
    while ARITY**base < most:
        nodes = log.filter((F.col("level") == base) & (F.col("n") > ARITY**base)).select("tree", F.col("index").alias("i"), "n", F.lower(F.hex(F.expr("substring(digests, -32)"))).alias("digest"))
        above = saved(_by_block(nodes).select("tree", "i", "n", "digest").mapInArrow(_build(base), _LOG), name)
        log = log.union(above)
        base += LEVELS
    return log


def tops(log: DataFrame) -> DataFrame:
    """(tree, n, top): the digest that is left of each tree."""
    return log.filter(F.col("level") == F.expr(_height("n"))).select("tree", "n", F.lower(F.hex(F.expr("substring(digests, -32)"))).alias("top"))


def _chains(log: DataFrame) -> DataFrame:
    """(tree, block, chain): what stands beside the way from the last node of each block up to the tree's top."""
    ends = log.select("tree", "first", F.lower(F.hex(F.expr("substring(digests, -32)"))).alias("digest"))
    blocks = log.filter(f"level = {LEVELS} and n > {ARITY**LEVELS}").select("tree", F.col("index").alias("block"), "n")
    steps = blocks.withColumn("level", F.explode(F.expr(f"sequence({LEVELS}, {_height('n')} - 1)")))
    steps = steps.withColumn("at", F.expr(f"block div {_POWERS}[level - {LEVELS}]"))
    steps = steps.withColumn("s", F.explode(F.expr(f"filter(transform(sequence(0, {ARITY - 1}), d -> at - at % {ARITY} + d), s -> s <> at and s < {_count('n', 'level')})")))
    # a block's row begins where its first leaf stands; a node above the blocks is a row of its own
    first = F.expr(f"if(level = {LEVELS}, {_before(f's * {ARITY**LEVELS}L')}, {_position('level', 's', 'n')})")
    found = steps.withColumn("first", first).join(ends, ["tree", "first"])
    side = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("s", "digest")))), lambda x: x["digest"]), "").alias(name) for name, keep in (("left", F.expr("s < at")), ("right", F.expr("s > at")))]
    levels = found.groupBy("tree", "block", "level").agg(*side)
    # a run of one has no siblings and leaves no row, but its parent is a digest of its own
    every = blocks.withColumn("level", F.explode(F.expr(f"sequence({LEVELS}, {_height('n')} - 1)"))).drop("n").join(levels, ["tree", "block", "level"], "left")
    struct = F.struct("level", F.coalesce("left", F.lit("")).alias("left"), F.coalesce("right", F.lit("")).alias("right"))
    chain = F.transform(F.array_sort(F.collect_list(struct)), lambda x: F.struct(x["left"].alias("left"), x["right"].alias("right")))
    return every.groupBy("tree", "block").agg(chain.alias("chain"))


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block by block, the log row of the block and then its leaves: each leaf with its path."""
    at: list[list[int]] = []
    segment, chain, up, start, m = "", [], 0, 0, 0
    for batch in batches:
        kinds, places = batch.column("kind").to_pylist(), batch.column("i").to_pylist()
        digests, chains, sizes = batch.column("digests"), batch.column("chain"), batch.column("n").to_pylist()
        left, right, offsets = [], [], [0]
        for row, (kind, i) in enumerate(zip(kinds, places)):
            if kind == 0:
                segment, chain = digests[row].as_py().hex(), chains[row].as_py() or []
                start, n = i, sizes[row]
                up, m = min(LEVELS, height(n)), min(ARITY**LEVELS, n - i)
                at = [position(k, np.arange(-(-m // ARITY**k)), m).tolist() for k in range(up + 1)]
                continue
            j = i - start
            for k in range(up):
                lo = j - j % ARITY
                left.append("".join(segment[64 * p: 64 * p + 64] for p in at[k][lo:j]))
                right.append("".join(segment[64 * p: 64 * p + 64] for p in at[k][j + 1: lo + ARITY]))
                j //= ARITY
            left.extend(c["left"] for c in chain)
            right.extend(c["right"] for c in chain)
            offsets.append(len(left))
        path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        mine = batch.filter(pc.equal(batch.column("kind"), 1)).drop_columns(["kind", "block", "digests", "chain"])
        yield pa.RecordBatch.from_arrays([*mine.columns, path], [*mine.schema.names, "path"])


def prove(leaves: DataFrame, log: DataFrame, outer: DataFrame | None = None) -> DataFrame:
    """``leaves`` with ``path``: level by level up to the top of its tree, what stands left and right of it in its run.

    ``outer`` (tree, path) goes on from a tree's top to the root of the tree of trees.
    """
    rows = log.filter(f"first = {_before(f'(index * {ARITY**LEVELS}L)')} and level = least({LEVELS}, {_height('n')})")
    rows = rows.select("tree", F.col("index").alias("block"), F.expr(f"index * {ARITY**LEVELS}L").alias("i"), "n", "digests").join(_chains(log), ["tree", "block"], "left")
    if outer is not None:
        rows = rows.join(outer.select("tree", F.col("path").alias("__outer")), "tree").withColumn("chain", F.concat(F.coalesce("chain", F.array().cast(_PATH)), "__outer")).drop("__outer")
    both = rows.withColumn("kind", F.lit(0)).unionByName(leaves.withColumn("kind", F.lit(1)).withColumn("block", F.expr(f"i div {ARITY**LEVELS}")), allowMissingColumns=True)
    both = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "i")
    kept = [c for c in both.columns if c not in ("kind", "block", "digests", "chain")]
    schema = ", ".join(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in kept)
    return both.mapInArrow(_prove, f"{schema}, path {_PATH}")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path one after the other, level by level and left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


@dataclass
class Manifest:
    leaves: DataFrame  # the ordering column, digest, extra columns, tree, i, n
    log: DataFrame
    trees: DataFrame  # tree, digest (its top), i (place among the trees), n (trees)
    trees_log: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """Every leaf with its subroot and its path to the root."""
        outer = saved(prove(self.trees.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "i", "n", "digest"), self.trees_log).select(F.col("name").alias("tree"), "path"), "manifest-outer")
        paths = prove(self.leaves, self.log, outer)
        # the leaf's own part of the path gives its tree's top, so no further join by tree is needed
        own = F.slice("path", F.lit(1), F.expr(_height("n")))
        return paths.withColumn("subroot", folded(F.col("digest"), own))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", extra: dict[str, Column] | None = None) -> Manifest:
    """Trees, log and root of ``docs``; ``extra`` columns are computed from the row and go along with its leaf."""
    rows = docs.select(F.col(order).alias("id"), F.col(group).alias("group"), leaf_digest(*map(F.col, columns)).alias("digest"), *[c.alias(k) for k, c in (extra or {}).items()])
    leaves = numbered(saved(rows, "manifest-leaves"), ["id", "digest"], "group", "manifest-order")
    leaves = saved(leaves.withColumn("tree", framed(F.col("group"))), "manifest-numbered")
    log = append_log(leaves)
    heads = leaves.filter("i = 0").select("tree", "group").join(tops(log).select("tree", F.col("top").alias("digest")), "tree")
    trees = saved(numbered(saved(heads, "manifest-trees"), ["group"], None, "manifest-trees").select("tree", "digest", "i", "n"), "manifest-trees")
    trees_log = append_log(trees.select(F.lit("").alias("tree"), "i", "n", "digest"), "manifest-trees-log")
    top = tops(trees_log).first()
    return Manifest(leaves.drop("group"), log, trees, trees_log, top["top"] if top else None)


def _frame_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


#: Levels by recursion, each row's runs on the way up, and the fold over them by one more recursion.
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, documents.*, CASE WHEN {crc_sql("doc_id::VARCHAR", "crc_table.t")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered_text FROM documents, crc_table),
leaf AS (
  SELECT r, doc_id, source, sha256({" || ".join(map(_frame_sql, COLUMNS))}) AS h, sha256({" || ".join(_frame_sql("tampered_text" if c == "text" else c) for c in COLUMNS)}) AS tampered FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaf),
node AS (
  SELECT source, 0 AS level, i, n, h FROM placed
  UNION ALL
  SELECT source, level + 1, i // {ARITY}, (max(n) + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY source, level, i // {ARITY}),
subroot AS (
  SELECT source, h, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, n, h FROM subroot
  UNION ALL
  SELECT level + 1, i // {ARITY}, (max(n) + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // {ARITY}),
beside AS (
  SELECT p.r, x.level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < p.i // ({ARITY} ** x.level)::BIGINT), '') AS l, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > p.i // ({ARITY} ** x.level)::BIGINT), '') AS g
  FROM placed p JOIN node x ON x.source IS NOT DISTINCT FROM p.source AND x.n > 1 AND x.i // {ARITY} = p.i // ({ARITY} ** (x.level + 1))::BIGINT GROUP BY p.r, x.level
  UNION ALL
  SELECT p.r, s.height + x.level, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < s.i // ({ARITY} ** x.level)::BIGINT), ''), coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > s.i // ({ARITY} ** x.level)::BIGINT), '')
  FROM placed p JOIN subroot s ON s.source IS NOT DISTINCT FROM p.source JOIN upper x ON x.n > 1 AND x.i // {ARITY} = s.i // ({ARITY} ** (x.level + 1))::BIGINT GROUP BY p.r, s.height, x.level),
fold AS (
  SELECT r, 0 AS level, tampered AS h FROM placed
  UNION ALL
  SELECT fold.r, fold.level + 1, sha256(l || h || g) FROM fold JOIN beside USING (r, level)),
folded AS (SELECT r, arg_max(h, level) AS folded_root FROM fold GROUP BY r),
proof AS (SELECT r, string_agg(l || g, '' ORDER BY level) AS p FROM beside GROUP BY r)
SELECT doc_id, placed.h AS leaf, subroot.h AS subroot, upper.h AS root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = upper.h AS verified
FROM placed JOIN subroot ON subroot.source IS NOT DISTINCT FROM placed.source JOIN upper ON upper.n = 1 JOIN folded ON folded.r = placed.r LEFT JOIN proof ON proof.r = placed.r
"""
