"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set is its distinct ``n``-word shingles (ASCII letters folded; a shorter text is one shingle; a text without words is
empty). Equal sets collapse first. The k smallest hashes of a set are its sketch; inverted lists of the retained values generate
overlaps, the sketch of the union estimates the similarity of a pair, and the exact sets decide.

Which values go into the lists follows from a count bound. Sets of similarity t and union size u have at least
``bound(u) = t*k - z*sd`` values in common in their sketches (the draw of the k smallest from the union is hypergeometric; for u <= k
the count is exact), so if each set leaves out its ``bound - 1`` most frequent values, two such sets still meet in a list. Passages
that very many documents share are left out that way without a cap. With z = 6 a pair at exactly t is missed with a chance near
1e-9, and one above it more rarely.

A list of at most ``short`` members is compared in full. Members of longer lists get lists anew, from all hashes of their exact sets:
of similar sets each may leave out its ``ceil(t * n) - 1`` most frequent hashes, so a passage drops out up to three quarters of a set.
Two members are compared if what both have from the list's hash on, in the order from rare to frequent, can hold the intersection that
the similarity asks for: the first hash they share has all of it from there on.
In a round on these lists a few members of each, chosen by hash, are compared with the members of other components; links join
components, and a list of one component is done. When few pairs between components are left (or ``rounds`` are over), they are all
compared, so no link between components is left out and no group of copies is expanded into all its pairs.

Defined results: empty and null texts link with nothing (n_shingles 0); so do rows with a null doc_id, whose component is null and
which are kept; rows that repeat a doc_id are judged by their own texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import connected_components, saved, small_batches
from .words import shingle_sets

_SIGN = np.uint64(1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Unsigned hashes as signed ones of the same order."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((flat ^ _SIGN).view(np.int64)))


def signatures(docs: DataFrame, k: int, shingle: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, node (128-bit digest of the set, null if empty), sketch (the k smallest hashes in order)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(s[:k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), _lists(sketches)], ["doc_id", "n_shingles", "node", "sketch"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(work, f"doc_id {kind}, n_shingles long, node binary, sketch array<bigint>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of the rows of (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), shingle))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(sets)], ["node", "hashes"])

    return docs.mapInArrow(work, "node binary, hashes array<bigint>")


def needed(n: Column, k: int, t: float, z: float) -> Column:
    """Sketch values that a set of size n has in common with any set of similarity t or more."""
    def bound(u: Column) -> Column:
        sd = F.sqrt(F.lit(t * (1 - t) * k) * (u - k) / F.greatest(u - 1, F.lit(1.0)))
        return F.when(u <= k, F.ceil(F.lit(t) * u - 1e-9)).otherwise(F.floor(F.lit(t * k) - z * sd))

    n = n.cast("double")
    return F.greatest(F.lit(1), F.least(bound(n), bound(n / t))).cast("int")


def _rarest(rows: DataFrame, total: Column, need: Column) -> DataFrame:
    """(v, r, n, s) of the hashes that a set must put into lists: all but its need - 1 most frequent ones. Hashes of one set come first; s is
    how many of the hashes given more than one set has and come at or after v in the order of all hashes, from rare to frequent."""
    often = rows.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
    # the window groups are single documents
    ranked = rows.join(often, "v").withColumns({"x": F.expr("row_number() over (partition by r order by c, v)"), "shared": F.expr("count(*) over (partition by r)")})
    return ranked.filter(F.col("x") <= total - need + 1 - (total - F.col("shared"))).select("v", "r", "n", (F.col("shared") - F.col("x") + 1).alias("s"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75, shingle: int = 5, k: int = 64, z: float = 6.0,
                    short: int = 32, hubs: int = 4, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: sets with 100 * intersection >= percent * union are linked."""
    small_batches(docs.sparkSession)
    t = percent / 100
    sigs = saved(signatures(docs, k, shingle, text, doc_id), "sketches")
    there = F.col("doc_id").isNotNull() & F.col("node").isNotNull()
    reps = sigs.filter(there).groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = saved(reps.withColumn("r", F.monotonically_increasing_id()), "sets")

    lists = _rarest(reps.select("r", "n", F.size("sketch").alias("m"), F.explode("sketch").alias("v")), F.col("m"), needed(F.col("n"), k, t, z))
    lists = saved(lists.withColumn("s", F.col("n")), "lists")
    lists = saved(lists.join(lists.groupBy("v").agg(F.count("*").alias("q")).filter("q > 1"), "v"), "lists")

    chosen = lists.groupBy("r").agg(F.max("q").alias("q")).join(reps, "r").select("r", "q", "n", "sketch", "node", F.col("low").alias("__low"))
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(chosen.select("__low").distinct(), F.col("__id") == F.col("__low"), "left_semi")
    sets = saved(full_sets(texts, shingle).join(chosen, "node").dropDuplicates(["r"]).select("r", "n", "q", "hashes", "sketch"), "hashes")
    crowd = sets.filter(F.col("q") > short).select("r", "n", F.explode("hashes").alias("v"))
    long = saved(_rarest(crowd, F.col("n"), F.ceil(F.lit(t) * F.col("n") - 1e-9)), "long-lists")

    def side(c: str, *columns: str) -> DataFrame:
        return sets.select(*[F.col(x).alias(f"{x}_{c}") for x in ("r", *columns)])

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a", "n", "sketch", "hashes"), "r_a").join(side("b", "n", "sketch", "hashes"), "r_b")
        both = both.withColumn("u", F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, k))
        common = F.size(F.array_intersect(F.array_intersect("u", "sketch_a"), F.col("sketch_b")))
        likely = both.filter(common >= (t - z * (t * (1 - t) / k) ** 0.5) * F.size("u"))
        exact = likely.withColumn("i", F.size(F.array_intersect("hashes_a", "hashes_b")))
        return exact.filter(100 * F.col("i") >= percent * (F.col("n_a") + F.col("n_b") - F.col("i"))).select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))

    def close(a: Column, b: Column, sa: Column, sb: Column) -> Column:
        """Sizes allow the similarity, and so does what either set has from this hash on: of the hashes that a pair shares, the first one
        in the order of all passes if the pair is similar, so no link is lost."""
        return (percent * F.greatest(a, b) <= 100 * F.least(a, b)) & (percent * (a + b) <= (100 + percent) * F.least(sa, sb))

    def within(rows: DataFrame) -> DataFrame:
        """Pairs of different components in one list."""
        a, b = (rows.select("v", *[F.col(x).alias(f"{x}_{s}") for x in ("r", "n", "s", "c")]) for s in "ab")
        return a.join(b, "v").filter((F.col("r_a") < F.col("r_b")) & (F.col("c_a") != F.col("c_b")) & close(*map(F.col, ("n_a", "n_b", "s_a", "s_b")))).select("r_a", "r_b")

    pairs = within(lists.filter(F.col("q") <= short).withColumn("c", F.col("r")))
    found = tested = None
    for turn in range(rounds + 1):
        act = long.withColumn("c", F.col("r")) if found is None else long.join(found.withColumnsRenamed({"node": "r", "component": "c"}), "r", "left").withColumn("c", F.coalesce("c", "r"))
        # per list: the member with the least of its own, which is near most of a group of copies, and the first ones in orders by hash
        alone = (F.col("n") - F.col("s")) / F.col("n")
        pick = [F.min(F.struct((F.lit(0.0) if i or turn else alone).alias("o"), F.xxhash64("r", F.lit(turn * hubs + i)).alias("h"), "r", "n", "s", "c")) for i in range(hubs)]
        per = act.groupBy("v").agg(F.count("*").cast("double").alias("q"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.array(*pick).alias("hub")).filter("lo < hi")
        last = turn == rounds
        if turn:
            alike = act.groupBy("v", "c").agg(F.count("*").cast("double").alias("m")).groupBy("v").agg(F.sum(F.col("m") * F.col("m")).alias("qq"))
            rows, cross = per.join(alike, "v").agg(F.sum("q"), F.sum((F.col("q") * F.col("q") - F.col("qq")) / 2)).first()
            if not rows:
                break
            last = last or cross <= 10 * rows
        if last:
            pairs = within(act.join(per.select("v"), "v", "left_semi"))
        else:
            star = act.join(per.select("v", "hub"), "v").select("r", "n", "s", "c", F.explode("hub").alias("hub")).filter(
                (F.col("c") != F.col("hub.c")) & close(*map(F.col, ("n", "hub.n", "s", "hub.s")))).select(
                F.least("r", "hub.r").alias("r_a"), F.greatest("r", "hub.r").alias("r_b"))
            pairs = star if turn else pairs.union(star)
        pairs = pairs.distinct()
        pairs = saved(pairs if tested is None else pairs.join(tested, ["r_a", "r_b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = verified(pairs)
        found = connected_components(links if found is None else links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), "near")
        if last:
            break

    comps = reps.select("r", "node", "low").withColumn("c", F.col("r")) if found is None else reps.select("r", "node", "low").join(
        found.select(F.col("node").alias("r"), F.col("component").alias("c")), "r", "left").withColumn("c", F.coalesce("c", "r"))
    smallest = comps.groupBy("c").agg(F.min("low").alias("component_id"))
    named = comps.join(smallest, "c").select("node", "component_id")
    out = sigs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(named, "node", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) USING (doc_id)
"""
