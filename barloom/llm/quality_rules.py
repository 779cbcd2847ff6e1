"""Quality rules as a short-circuit cascade of column expressions (native).

``base_counts`` adds the counts every rule may use. ``ordered`` times each rule and its rejections on a bounded sample and puts the
rules with the most rejections per second first; ``cascade`` evaluates them in that order inside one ``CASE``, so that a rule runs
only on rows that all earlier rules let pass. The order changes the cost and the named rule, never the verdict.

Defined results: a null or empty text has no words and fails the base rule; repeated rows and ids are judged one by one; columns of
the input that share a name with a result are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a boolean column over the text and the base counts; null counts as not rejected."""

    name: str
    rejects: Column


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all counted inside the row without a shuffle.

    Repeated three-word windows are found by sorting (window hash, position) pairs: equal neighbours repeat. The hash has 64 bits,
    so two different windows of one text of a million words collide with a chance below 1e-7.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    d = docs.withColumn("__w", F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t\\n\\x0B\\f\\r]+")))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    w, n = F.col("__w"), F.size("__w")
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS)).cast("long"),
        "__l": lines,
        "__s": F.sort_array(F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))),
    })
    s = F.col("__s")
    d = d.withColumns({
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__p": F.sort_array(F.transform(
            F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))),
            lambda x: x["i"])),
    })
    covered = F.aggregate("__p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return d.withColumn("n_repeat_words", covered).drop("__w", "__l", "__s", "__p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def production_rules(text: str = "text") -> list[Rule]:
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.col("n_words")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words),
        Rule("dup_lines", 100 * F.col("n_dup_lines") > 50 * (F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1)),
        Rule("word_length", (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words)),
        Rule("capitals", 2 * F.regexp_count(t, F.lit("[A-Z]")) > F.col("word_chars")),
        Rule("shouting", 3 * F.regexp_count(t, F.lit("!+")) > words),
        Rule("digits", 4 * F.regexp_count(t, F.lit("[0-9]")) > F.col("word_chars")),
    ]


def ordered(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 400, sample_chars: int = 200_000) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share), best rejections per second first, measured on at most ``sample_rows`` rows.

    The sample only sets the order. Texts above ``sample_chars`` are left out of it so that the driver holds a bounded amount.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text")).filter(F.length("text") <= sample_chars).sample(0.2, seed=7).limit(sample_rows).collect()
    if not rows:
        return [(r, 0.0, 0.0) for r in rules]
    sample = spark.createDataFrame(rows, "text string").withColumnRenamed("text", text).coalesce(1)
    counted = base_counts(sample, text).cache()
    counted.count()

    def timed(*columns: Column) -> tuple[float, list]:
        best, got = float("inf"), []
        for _ in range(2):
            t = time.perf_counter()
            got = counted.agg(F.count("*"), *columns).first()
            best = min(best, time.perf_counter() - t)
        return best, got

    idle, _ = timed()
    found = []
    for r in rules:
        s, got = timed(F.count_if(r.rejects))
        found.append((r, max(s - idle, 1e-4), got[1] / max(1, got[0])))
    counted.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add base_failed, rejected_by (first rule of the order given that rejects, null if none) and kept."""
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for r in rules:
        verdict = verdict.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name))
    return counted.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` with the base counts, base_failed, rejected_by and kept."""
    rules = production_rules(text) if rules is None else rules
    return cascade(base_counts(docs, text), [r for r, _, _ in ordered(docs, rules, text)])


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
m AS (SELECT b.*, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM b LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 50 * (length(text) - length(replace(text, chr(10), '')) + 1)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * len(regexp_extract_all(text, '[A-Z]')) > word_chars
    OR 3 * len(regexp_extract_all(text, '!+')) > n_words OR 4 * len(regexp_extract_all(text, '[0-9]')) > word_chars) AS kept
FROM m
"""
