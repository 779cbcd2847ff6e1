"""Spelling variant groups by permuterm rotations.

Words are the runs of Latin letters of all texts, counted over the corpus. A word marked with a terminator is written in all its
rotations; sorted, the rotations that begin alike stand together. For a word ``a c b`` the rotation ``b $ a c`` without its last
letter c, the edited one, is a prefix ``b $ a`` that it shares with exactly the words that hold another letter in c's place, and that is
itself a rotation of ``a b``, the word without c. So replacements, insertions and deletions of one code point are all found by scanning
the groups of one prefix. A deletion inside a run of one letter shows in several groups; the first letter of the run counts.

A group holds at most one word per letter of the alphabet and the word without a letter, whatever the corpus. The scan is linear: for
each member it emits how many neighbours the group holds for it and the best of them (largest count, then smallest in code-point
order), not the pairs. Words travel as their place in code-point order. Prefixes of more than ``TEXT`` symbols travel as four
polynomial hashes of their two parts, so a word of any length costs its length, not its square (chance of a collision near 2 ** -100).

A word's form is its best neighbour if that occurs at least ``ratio`` times as often; forms lead to a root by pointer jumping.

Defined results: a null text holds no words; a null doc_id is written as nothing in the hashed text; rows that repeat a doc_id count
each with its own text; words that occur as often and are as good are taken by code-point order; an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import CRC_TABLE, crc_sql, numbered, saved, small_batches

SHORTEST, DELETED = 7, 31
TEXT = 64
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
_PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
_BASES = np.array([1000003, 50000017, 700000001, 1400000023], np.uint64)
_FLUSH = 200_000


def runs(text: str) -> Counter:
    """Runs of at least ``SHORTEST`` letters, A-Z lower-cased; shorter ones cannot give a word, as letters only go."""
    return Counter(_RUN.findall(text.encode().lower().decode()))


def altered(run: str, h: int) -> str:
    """The run, without one code point where ``DELETED`` divides its hash."""
    at = h % len(run)
    return run if h % DELETED else run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 2) -> DataFrame:
    """(word, n): words of at least ``SHORTEST`` code points that occur ``least`` times or more in all texts."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
            n.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                if not t:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, k in runs(t).items():
                    word = altered(run, zlib.crc32(run.encode(), start))
                    if len(word) >= SHORTEST:
                        n[word] += k
                if len(n) >= _FLUSH:
                    yield flushed()
        yield flushed()

    counts = docs.select(F.col(doc_id).cast("string"), text).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= least)


def _hashes(word: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per prime the hash of every head ``word[:i]`` and of every tail ``word[i:]``, the same wherever in a word the part stands."""
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(code)
    parts = []
    for p, base in zip(_PRIMES, _BASES):
        power, inverse = (np.ones(1, np.uint64) for _ in "ab")
        back = np.uint64(pow(int(base), -1, int(p)))
        while len(power) < n + 1:
            power = np.concatenate([power, power * (power[-1] * base % p) % p])
            inverse = np.concatenate([inverse, inverse * (inverse[-1] * back % p) % p])
        head = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * power[:n] % p) % p])
        parts.append((head, (head[n] + p - head) * inverse[: n + 1] % p))
    return parts


def entries(word: str, step: int = 20_000) -> Iterator[tuple[list[str], list[int], list[bool]]]:
    """Prefix, skipped letter (0: the whole rotation) and whether that letter begins its run, for all rotations, in parts of ``step``."""
    n, turned = len(word), f"{word}${word}"
    parts = _hashes(word) if n >= TEXT else []

    def hashed(head: int, tail: int) -> str:
        return f"#{n - tail}:{head}:" + ".".join("%x,%x" % (int(h[head]), int(t[tail])) for h, t in parts)

    for lo in range(0, n, step):
        at = range(lo, min(lo + step, n))
        yield [turned[i + 1: i + n + 1] if n <= TEXT else hashed(i, i + 1) for i in at], [ord(word[i]) for i in at], [i == 0 or word[i] != word[i - 1] for i in at]
    for lo in range(0, n + 1, step):
        at = range(lo, min(lo + step, n + 1))
        yield [turned[i: i + n + 1] if n < TEXT else hashed(i, i) for i in at], [0] * len(at), [True] * len(at)


_ROTATIONS = "prefix string, letter int, first boolean, id long, n long"


def rotations(words: DataFrame) -> DataFrame:
    """Every rotation of (id, word, n): prefix and skipped letter (0: the whole rotation), and whether the letter begins its run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["prefix", "letter", "first", "id", "n"]
        prefix: list[str] = []
        letter: list[int] = []
        first: list[bool] = []
        ids: list[int] = []
        ns: list[int] = []

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(prefix, pa.string()), pa.array(letter, pa.int32()), pa.array(first, pa.bool_()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64())], names)
            for part in (prefix, letter, first, ids, ns):
                part.clear()
            return out

        for batch in batches:
            for i, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for part in entries(word):
                    prefix += part[0]
                    letter += part[1]
                    first += part[2]
                    ids += [i] * len(part[0])
                    ns += [n] * len(part[0])
                    if len(prefix) >= 50_000:
                        yield flushed()
        yield flushed()

    return words.select("id", "word", "n").mapInArrow(work, _ROTATIONS)


_FOUND = "id long, near long, best_n long, best long"


def scanned(t: pa.Table) -> pa.RecordBatch:
    """Members of whole groups with what the group holds for each: neighbours and the best of them."""
    prefix = t.column("prefix").combine_chunks()
    new = np.concatenate([[True], pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)])
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    t = t.filter(pa.array(several))
    letter, first, ids, n = (t.column(c).to_numpy() for c in ("letter", "first", "id", "n"))
    group = np.unique(group[several], return_inverse=True)[1]
    groups, whole = (int(group[-1]) + 1 if len(group) else 0), letter == 0
    # words that hold a letter, best first within their group
    order = np.lexsort((ids, -n, group))
    held = order[~whole[order]]
    size = np.bincount(group[held], minlength=groups)
    none = np.full(groups, -1)

    def kth(rows: np.ndarray, k: int) -> np.ndarray:
        size = np.bincount(group[rows], minlength=groups)
        out, has = none.copy(), size > k
        out[has] = rows[(np.cumsum(size) - size)[has] + k]
        return out

    top, second = kth(held, 0), kth(held, 1)
    begins = held[first[held]]
    top_first, without = kth(begins, 0), none.copy()
    without[group[whole]] = np.flatnonzero(whole)
    n_first = np.bincount(group[begins], minlength=groups)
    row = np.arange(len(ids))
    linked = ~whole & first & (without[group] >= 0)
    near = np.where(whole, n_first[group], size[group] - 1 + linked)
    best = np.where(whole, top_first[group], np.where(top[group] == row, second[group], top[group]))
    other = np.where(linked, without[group], -1)
    # a missing one (-1) loses against any
    n_of, id_of = np.append(n, -1), np.append(ids, -1)
    better = (n_of[other] > n_of[best]) | ((n_of[other] == n_of[best]) & (other >= 0) & (id_of[other] < id_of[best]))
    best = np.where(better, other, best)
    out = near > 0
    return pa.RecordBatch.from_arrays([pa.array(x[out].astype(np.int64)) for x in (ids, near, n_of[best], id_of[best])], ["id", "near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best) of every word that has a neighbour; ``words`` has id (place in code-point order), word and n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not len(t):
                continue
            # the last group goes on in the next batch; it is short, as a group holds a word per letter
            prefix = t.column("prefix")
            last, cut = prefix[-1], len(t)
            while cut and prefix[cut - 1] == last:
                cut -= 1
            if cut:
                yield scanned(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
        if rest is not None:
            yield scanned(rest)

    spark = words.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    ordered = rotations(words).repartition("prefix").sortWithinPartitions("prefix", "letter")
    found = saved(ordered.mapInArrow(work, _FOUND), "neighbours")
    best = F.max(F.struct("best_n", (-F.col("best")).alias("b"))).alias("m")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", F.col("m.best_n").alias("best_n"), (-F.col("m.b")).alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(id, form) links, each to a strictly more frequent word, to (id, root): pointers jump until none moves."""
    now = saved(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = saved(now.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus."""
    counts = saved(word_counts(docs, text, doc_id).withColumnRenamed("n", "times"), "counts")
    words = saved(numbered(counts, ["word"], None, "words").select(F.col("i").alias("id"), "word", F.col("times").alias("n")), "words")
    near = saved(neighbours(words), "near")
    all_ = words.join(near, "id", "left").withColumn("form", F.when(F.col("best_n") >= F.col("n") * ratio, F.col("best")))
    forms = saved(all_.select("id", "form").filter("form is not null"), "forms")
    name = words.select(F.col("id").alias("of"), "word")
    named = forms.join(rooted(forms), "id")
    for c in ("form", "root"):
        named = named.join(name.select(F.col("of").alias(c), F.col("word").alias(f"{c}_word")), c)
    out = all_.drop("form").join(named.select("id", "form_word", "root_word"), "id", "left")
    return out.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form_word").isNotNull(), F.col("best_n")).alias("form_n"))


#: Runs and their hashes, pairs through one letter left out (deletions) or masked (replacements), forms followed by recursion.
SQL = f"""
WITH RECURSIVE {CRC_TABLE},
run AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' AS head, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) WHERE length(r) >= {SHORTEST}),
counted AS (SELECT head, run, count(*) AS n FROM run GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("head || run", "crc_table.t")} AS h FROM counted, crc_table),
word AS (
  SELECT CASE WHEN h % {DELETED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1),
kept AS (SELECT word, n FROM word WHERE length(word) >= {SHORTEST} AND n >= 2),
cut AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS short FROM (SELECT *, unnest(range(length(word)))::INT AS i FROM kept)),
pair AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT cut.word, kept.word, kept.n FROM cut JOIN kept ON cut.short = kept.word
  UNION
  SELECT kept.word, cut.word, cut.n FROM cut JOIN kept ON cut.short = kept.word),
best AS (SELECT a AS word, count(*) AS n_near, max(n) AS top FROM pair GROUP BY a),
form AS (
  SELECT kept.word, kept.n, n_near, CASE WHEN top >= 10 * kept.n THEN (SELECT min(b) FROM pair WHERE pair.a = kept.word AND pair.n = top) END AS form, CASE WHEN top >= 10 * kept.n THEN top END AS form_n
  FROM kept LEFT JOIN best ON best.word = kept.word),
way AS (
  SELECT word, word AS reached, 0 AS k FROM form UNION ALL SELECT way.word, form.form, k + 1 FROM way JOIN form ON form.word = way.reached WHERE form.form IS NOT NULL)
SELECT word, form, root, n, coalesce(n_near, 0) AS n_near, form_n FROM form JOIN (SELECT word, arg_max(reached, k) AS root FROM way GROUP BY word) USING (word)
"""
