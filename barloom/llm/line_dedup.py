"""Line dedup by pairwise alignment.

A line leaves a document if an earlier one aligns it: the two sequences of line hashes are aligned with patience diff, gaps without
unique lines by their longest common run, and the aligned common blocks of at least ``min_chars`` characters are deleted from the later
document. The result is that of all pairs of documents, found through the shortest runs of lines of that size (mostly one line), which
every such block holds:

1. Each later holder of a run meets the first one. That star has one pair per (document, run) at most, so a line of a third of all
   documents makes as many pairs as it has holders and no all-pairs group.
2. Runs that stay (crossing or repeated lines) meet their other holders. Pairs with a rare common line are listed by it, at most
   ``RARE`` for each line of the later document. An alignment sees only the lines that both have, so all other pairs depend on the
   frequent lines alone: documents count once for each sequence of frequent lines, on both sides. Earlier sequences that share
   nothing but the run with the later one differ only by its shape, and one of each shape is enough; the others are found by the run
   and a second common line. A position goes from a later document if the first earlier document that cuts it in this way comes before
   it; should these two have a rare line in common, the later document meets every holder of its runs.

Later means the larger (doc_id, text hash). Alignment reads the original lines of both sides, so the result does not depend on the
order of work.

Defined results: a null text stays null, an empty one empty; a text of which every line goes becomes the empty string; rows with a
null doc_id pair with nothing; rows equal in doc_id and text are one document and get one result; columns named n_lines or
n_removed are replaced. Hashes of lines, runs and shapes have 64 bits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import saved, small_batches



def longest_run(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest run of lines in both, the first one in ``b`` and then in ``a``, by a suffix automaton of ``a``."""
    if set(a).isdisjoint(b):
        return 0, 0, 0
    step: list[dict[int, int]] = [{}]
    link, size, end = [-1], [0], [-1]
    last = 0
    for k, x in enumerate(a):
        new = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(k)
        p, last = last, new
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p < 0:
            continue
        q = step[p][x]
        if size[q] != size[p] + 1:
            step.append(dict(step[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            end.append(end[q])
            copy = len(step) - 1
            while p >= 0 and step[p].get(x) == q:
                step[p][x] = copy
                p = link[p]
            link[q] = copy
            q = copy
        link[new] = q
    best = (0, 0, 0)
    at = run = 0
    for k, x in enumerate(b):
        while at and x not in step[at]:
            at = link[at]
            run = size[at]
        if x in step[at]:
            at, run = step[at][x], run + 1
        if run > best[2]:
            best = (end[at] - run + 1, k - run + 1, run)
    return best


def runs(seq: list[int], chars: list[int], min_chars: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest run of at least ``min_chars`` characters from each position on and up to each position.

    Every block of that many characters is covered by such runs inside it, so two documents without a common one have no block to align.
    """
    out = set()
    total = lo = 0
    for hi, n in enumerate(chars):
        total += n
        while total - chars[lo] >= min_chars:
            # the run from lo on first reaches the size at hi or before
            total -= chars[lo]
            lo += 1
        if total >= min_chars:
            out.add((lo, hi))
    total, hi = 0, -1
    for lo in range(len(chars)):
        while total < min_chars and hi + 1 < len(chars):
            hi += 1
            total += chars[hi]
        if total < min_chars:
            break
        out.add((lo, hi))
        total -= chars[lo]
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs, rising in both: common ends first, then the longest rising run of lines unique in both, then the gaps."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        at = {a[k]: k for k in range(i, m) if ca[a[k]] == 1}
        pairs = [(at[b[k]], k) for k in range(j, n) if cb[b[k]] == 1 and b[k] in at]
        if not pairs:
            p, q, n_run = longest_run(a[i:m], b[j:n])
            if n_run:
                p, q = i + p, j + q
                out += [(p + x, q + x) for x in range(n_run)]
                todo += [(i, p, j, q), (p + n_run, m, q + n_run, n)]
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = []
        for x, (p, _) in enumerate(pairs):
            k = bisect_left(tails, p)
            tails[k: k + 1] = [p]
            ends[k: k + 1] = [x]
            back.append(ends[k - 1] if k else -1)
        x, chain = ends[-1], []
        while x >= 0:
            chain.append(pairs[x])
            x = back[x]
        for p, q in reversed(chain):
            todo.append((i, p, j, q))
            out.append((p, q))
            i, j = p + 1, q + 1
        todo.append((i, m, j, n))
    return sorted(out)


def removed(a: list[int], b: list[int], chars: list[int], min_chars: int) -> list[int]:
    """Positions of ``b`` in aligned blocks of at least ``min_chars`` characters."""
    cut: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for p, q in [*patience(a, b), (-9, -9)]:
        if (p, q) != (last[0] + 1, last[1] + 1):
            if sum(chars[k] for k in block) >= min_chars:
                cut += block
            block = []
        block.append(q)
        last = (p, q)
    return cut


def projected(seq: list[int], keep: set[int]) -> list[int | None]:
    """``seq`` with each run of lines outside ``keep`` as one None."""
    return narrowed(seq, seq, keep)[0]


def narrowed(seq: list[int], chars: list[int], keep: set[int]) -> tuple[list[int | None], list[int], list[int]]:
    """``seq`` with each run of lines outside ``keep`` as one None, its lengths (0 for None) and positions in ``seq``."""
    out: list[int | None] = []
    n, places = [], []
    for at, x in enumerate(seq):
        if x in keep or not out or out[-1] is not None:
            out.append(x if x in keep else None)
            n.append(chars[at] if x in keep else 0)
            places.append(at)
    return out, n, places


def digest(*parts: int | None) -> int:
    """The hash of a tuple of integers, equal in all processes."""
    return hash(tuple(0 if x is None else x for x in parts))


def held_runs(seq: list[int], chars: list[int], min_chars: int) -> dict[int, list[tuple[int, int]]]:
    """digest -> places of the runs of a document."""
    out: dict[int, list[tuple[int, int]]] = {}
    for lo, hi in runs(seq, chars, min_chars):
        out.setdefault(digest(*seq[lo: hi + 1]), []).append((lo, hi))
    return out


def pair_keys(seq: list[int | None], own_lines: dict[int, set[int]]) -> list[int]:
    """For each run (digest -> its lines) one key with each other line of the document."""
    lines = set(seq) - {None}
    return [digest(run, 2, y) for run, own in own_lines.items() for y in lines - own]


#: A line of at most so many holders is rare: all its pairs are aligned.
RARE = 32
#: A sequence with more runs left meets all the earlier ones that hold one, as its keys with a second line would be too many.
FEW = 4
#: Sequences of one shape that are tried; up to the first that shares only the run, the later one meets all the holders of the run.
TRIED = 4


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10) -> DataFrame:
    """``docs`` with the text of later documents shortened, n_lines and n_removed."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    seqs = docs.filter(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(
        F.struct(F.col(doc_id).alias("i"), h.alias("h")).alias("k"), F.transform(lines, lambda x: F.xxhash64(x)).alias("seq"), F.transform(lines, lambda x: F.length(x)).alias("chars"))
    seqs = saved(seqs, "lines")
    kind = docs.schema[doc_id].dataType.simpleString()

    def each(df: DataFrame, columns: tuple[str, ...], work, schema: str, ids: tuple[str, ...] = ("k",)) -> DataFrame:
        """``ids`` (structs of i and h) and the values that ``work`` yields for the row; ``schema`` is theirs."""
        names = [c.split(":")[0] for c in schema.split(", ")]
        id_names = [f"{c}_{f}" for c in ids for f in "ih"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, out = [], []
                for n, row in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                    for values in work(*row):
                        at.append(n)
                        out.append(values)
                at = pa.array(at, pa.int32())
                kept = [batch.column(c).take(at).field(f) for c in ids for f in (0, 1)]
                kinds = [{"int": pa.int32(), "bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}[c.split(":")[1]] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([v[x] for v in out], t) for x, t in enumerate(kinds))], [*id_names, *names])

        id_schema = ", ".join(f"{c}_i {kind}, {c}_h bigint" for c in ids)
        structs = [F.struct(F.col(f"{c}_i").alias("i"), F.col(f"{c}_h").alias("h")).alias(c) for c in ids]
        return df.select(*ids, *columns).mapInArrow(run, f"{id_schema}, {schema.replace(':', ' ')}").select(*structs, *names)

    def aligned(pairs: DataFrame, a: DataFrame) -> DataFrame:
        """(k, cut) of every k of ``pairs`` (first, k), ``a`` having the lines of first."""
        sides = pairs.join(a, "first").join(seqs.select("k", F.col("seq").alias("b"), "chars"), "k")
        cuts = each(sides, ("a", "b", "chars"), lambda a, b, n: [(removed(a, b, n, min_chars),)], "cut:array<int>")
        return gathered(cuts.select("k", F.explode_outer("cut").alias("at")))

    held = saved(each(seqs, ("seq", "chars"), lambda s, n: [(x,) for x in held_runs(s, n, min_chars)], "run:bigint"), "held")
    seqs = seqs.dropDuplicates(["k"])
    first = held.groupBy("run").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last").select("run", "first")
    pairs = held.join(first, "run").filter("first < k").select("first", "k").distinct()
    cuts = saved(aligned(pairs, seqs.select(F.col("k").alias("first"), F.col("seq").alias("a"))), "cuts")

    def left_runs(seq: list[int], chars: list[int], cut: list[int]) -> list[tuple[int]]:
        gone = set(cut)
        return [(x,) for x, places in held_runs(seq, chars, min_chars).items() if any(q not in gone for lo, hi in places for q in range(lo, hi + 1))]

    left = each(seqs.join(cuts, "k"), ("seq", "chars", "cut"), left_runs, "run:bigint")
    left = saved(left.join(first, "run").filter("first < k").select("k", "run"), "left")
    if not left.isEmpty():
        cuts = gathered(cuts.select("k", F.explode("cut").alias("at")).union(other_cuts(seqs, held, left, each, min_chars)))
    cuts = cuts.filter(F.size("cut") > 0).select(F.col("k.i").alias("__i"), F.col("k.h").alias("__h"), F.col("cut").alias("__cut"))
    out = docs.join(cuts, (F.col(doc_id) == F.col("__i")) & (h == F.col("__h")), "left")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__cut"))
    new = F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.array_join(F.transform(rest, lambda i: F.get(F.col("__lines"), i)), "\n"))
    out = out.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_removed", F.coalesce(F.size("__cut"), F.lit(0)).cast("long"))
    return out.withColumn(text, new).drop("__i", "__h", "__cut", "__lines")


def gathered(cuts: DataFrame) -> DataFrame:
    """(k, cut) of rows (k, at), null for none: the positions of a document once each, so no list is longer than the document."""
    return cuts.distinct().groupBy("k").agg(F.collect_list("at").alias("cut"))


def other_cuts(seqs: DataFrame, held: DataFrame, left: DataFrame, each, min_chars: int) -> DataFrame:
    """(k, at): positions that earlier documents other than the first holders cut, for the runs of ``left`` (k, run)."""
    none = F.array().cast("array<bigint>")
    later = saved(left.distinct().groupBy("k").agg(F.collect_list("run").alias("open")).join(seqs, "k"), "later")
    later_lines = saved(later.select("k", F.explode(F.array_distinct("seq")).alias("line")), "later-lines")
    holders = held.join(left.select("run").distinct(), "run", "left_semi").distinct().groupBy("k").agg(F.collect_list("run").alias("open"))
    holders = saved(holders.join(seqs, "k"), "holders")
    shared = holders.select("k", F.explode(F.array_distinct("seq")).alias("line")).join(later_lines.select("line").distinct(), "line", "left_semi")
    shared = saved(shared, "shared")
    counts = saved(shared.groupBy("line").agg(F.count("*").alias("n")), "holders-of-lines")
    frequent = counts.filter(F.col("n") > RARE).select("line")

    def all_cuts(pairs: DataFrame) -> DataFrame:
        a = holders.select(F.col("k").alias("first"), F.col("seq").alias("a"), F.col("open").alias("a_open"))
        sides = pairs.join(a, "first").join(later, "k").filter(F.arrays_overlap("open", "a_open"))
        return each(sides, ("a", "seq", "chars"), lambda a, b, n: [(x,) for x in removed(a, b, n, min_chars)], "at:int").distinct()

    rare = shared.join(counts.filter(F.col("n") <= RARE), "line").select("line", F.col("k").alias("first"))
    rare = saved(later_lines.join(rare, "line").filter("first < k").select("first", "k").distinct(), "rare-pairs")
    cuts = saved(all_cuts(rare), "rare-cuts")

    def frequent_part(seq: list[int], chars: list[int], open_: list[int], keep: list[int]) -> list[tuple]:
        own = set(keep)
        a, n, places = narrowed(seq, chars, own)
        wanted = set(open_)
        there = sorted(x for x, (at, *_) in held_runs(seq, chars, min_chars).items() if x in wanted and own.issuperset(seq[at[0]: at[1] + 1]))
        return [(a, n, places, there, digest(*a))] if there else []

    def narrow(docs: DataFrame, lines: DataFrame) -> DataFrame:
        keep = lines.join(frequent, "line", "left_semi").groupBy("k").agg(F.collect_list("line").alias("keep"))
        return each(docs.join(keep, "k"), ("seq", "chars", "open", "keep"), frequent_part,
                    "a:array<bigint>, n:array<int>, places:array<int>, open:array<bigint>, sig:bigint")

    members = saved(narrow(later, later_lines), "members")
    open_ = members.select("sig", F.explode("open").alias("run")).distinct().groupBy("sig").agg(F.collect_list("run").alias("open"))
    later_seqs = members.groupBy("sig").agg(F.min("k").alias("k"), F.max("k").alias("top"), F.min_by("a", "k").alias("b"), F.min_by("n", "k").alias("n"))
    later_seqs = saved(later_seqs.join(open_, "sig"), "later-sequences")
    earlier = narrow(holders, shared).groupBy("sig").agg(
        F.min("k").alias("k"), F.min_by("a", "k").alias("a"), F.min_by("n", "k").alias("n"), F.min_by("open", "k").alias("open"))
    earlier = saved(earlier, "earlier-sequences")
    tops = later_seqs.select("k", "top")

    def own_lines(seq: list[int | None], chars: list[int], open_: list[int]) -> dict[int, set[int]]:
        places = held_runs(seq, chars, min_chars)
        return {x: set(seq[slice(places[x][0][0], places[x][0][1] + 1)]) for x in open_}

    def keys_of_later(seq: list[int | None], chars: list[int], open_: list[int]) -> list[tuple[int]]:
        if len(open_) > FEW:
            return [(digest(x, 3),) for x in open_]
        return [(x,) for x in pair_keys(seq, own_lines(seq, chars, open_))]

    def keys_of_earlier(a: list[int | None], chars: list[int], open_: list[int], few: list[int]) -> list[tuple[int]]:
        few_runs = set(few)
        few_lines = own_lines(a, chars, [x for x in open_ if x in few_runs])
        return [(x,) for x in (*(digest(run, 3) for run in open_), *pair_keys(a, few_lines))]

    def runs_of_later(seq: list[int | None], chars: list[int], open_: list[int]) -> list[tuple[int, int, list[int]]]:
        return [(run, digest(run, 3), sorted(own)) for run, own in own_lines(seq, chars, open_).items()]

    def shapes(a: list[int | None], chars: list[int], few: list[int]) -> list[tuple[int, int, int]]:
        return [(run, digest(*projected(a, own)), digest(*a) % TRIED) for run, own in own_lines(a, chars, few).items()]

    few_later = each(later_seqs.filter(F.size("open") <= FEW), ("b", "n", "open"), runs_of_later, "run:bigint, key:bigint, own:array<bigint>")
    few_later = saved(few_later.join(tops, "k"), "later-runs")
    few = earlier.select("k", F.explode("open").alias("run")).join(few_later.select("run").distinct(), "run", "left_semi").groupBy("k").agg(F.collect_list("run").alias("few"))
    few = earlier.join(few, "k", "left").withColumn("few", F.coalesce("few", none))
    of_shape = each(few, ("a", "n", "few"), shapes, "run:bigint, shape:bigint, part:bigint").groupBy("run", "shape", "part").agg(F.min("k").alias("first"))
    a = earlier.select(F.col("k").alias("first"), "a")
    tried = few_later.join(of_shape, "run").filter("first < top").join(a, "first").join(later_seqs.select("k", "b"), "k")
    more = F.array_except(F.array_intersect(F.array_compact("a"), F.array_compact("b")), F.col("own"))
    tried = saved(tried.select("k", "run", "key", "shape", "top", "first", (F.size(more) == 0).alias("alone")), "tried")
    # sequences that share only the run are equal for the later one if the run has the same shape in them
    unsure = tried.groupBy("k", "key", "run", "shape").agg(
        F.min(F.when(F.col("alone"), F.col("first"))).alias("sure"), F.min(F.when(~F.col("alone"), F.col("first"))).alias("other"), F.first("top").alias("top"))
    unsure = unsure.filter("other IS NOT NULL AND (sure IS NULL OR other < sure)").select("k", "key", F.coalesce("sure", "top").alias("top"))
    keys = each(later_seqs, ("b", "n", "open"), keys_of_later, "key:bigint").join(tops, "k").union(unsure)
    of_earlier = each(few, ("a", "n", "open", "few"), keys_of_earlier, "key:bigint").select("key", F.col("k").alias("first"))
    pairs = keys.join(of_earlier, "key").filter("first < top").select("first", "k").union(tried.select("first", "k")).distinct()

    def cut_places(a: list[int | None], b: list[int | None], n: list[int]) -> list[tuple[int]]:
        return [(x,) for x in removed(a, ["" if x is None else x for x in b], n, min_chars)]

    sides = pairs.join(a, "first").join(later_seqs.select("k", "b", "n"), "k")
    at = each(sides, ("a", "b", "n"), cut_places, "at:int", ids=("k", "first")).groupBy("k", "at").agg(F.min("first").alias("first"))
    at = at.groupBy("k").agg(F.collect_list(F.struct("at", "first")).alias("cuts")).join(later_seqs.select("k", "sig"), "k").drop("k")
    found = members.join(at, "sig").select("k", "places", F.explode("cuts").alias("c")).filter("c.first < k").select(
        "k", F.col("c.first").alias("first"), F.get("places", F.col("c.at")).alias("at"))
    found = saved(found.join(rare.withColumn("rare", F.lit(True)), ["first", "k"], "left"), "found")
    cuts = cuts.union(found.filter("rare IS NULL").select("k", "at")).distinct()
    doubtful = found.filter("rare").join(cuts, ["k", "at"], "left_anti").select("k").distinct().join(left, "k")
    doubtful = doubtful.join(held.withColumnRenamed("k", "first"), "run").filter("first < k").select("first", "k").distinct()
    return cuts.union(all_cuts(doubtful)).distinct()
