"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the substrings of that text. A document is parsed greedily into
phrases, each the longest match in the labelled text of the language; the symbol that ends a match begins the next phrase, and one
that the labelled text lacks is a phrase of its own.
The fewer phrases, the better the labelled text predicts the document. With ``c`` phrases over ``m`` symbols and ``n`` symbols of
labelled text, ``c * log2(n) / m`` estimates the cross entropy; the language with the smallest wins, so languages with
less labelled text are not favoured or hurt. The score is the winner's share of ``2 ** -bits`` over all languages.

The automata are fitted on a bounded sample: per language the whole texts of the labelled rows of smallest hash, at most ``max_rows``,
that fit into ``max_symbols`` symbols (or the language's share of ``max_total``; a language of which every text is longer gives the
beginning of one). At most ``max_total // 2000`` languages are learned, those with most rows. Every document is parsed, and whole. Symbols are
lower-cased letters and the bytes of other alphabets (of both, the 63 commonest; the others match nothing); all else is one break.

Parsing steps through one table for all languages and all texts of a batch at once. Texts are parsed in segments of ``SEGMENT``
symbols, each for itself, so a text of any length is a number of equal steps; a cut adds at most one phrase in every language.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing can be learned; of equally good
languages the first in text order wins; rows that repeat a doc_id are judged by their own texts; a null doc_id is never held out
and its text, if it has a language, is learned from; an empty table gives an empty result. Columns that are not named are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import fold, per_worker, small_batches
from .words import blocks, utf8

SYMBOLS, SEGMENT = 64, 256
_LETTER = regex.compile(r"\p{L}")
_byte = np.zeros(256, np.uint8)
_byte[97:123] = _byte[65:91] = np.arange(97, 123)
_byte[128:] = np.arange(128, 256)
_BREAK = _byte == 0


def automaton(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions (from, byte, to) of the suffix automaton of ``text``; 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    rows = [(s, c, t) for s, out in enumerate(nexts) for c, t in out.items()]
    source, byte, target = np.array(rows, np.int64).reshape(-1, 3).T
    return source.astype(np.int32), byte.astype(np.uint8), target.astype(np.int32)


def joined(texts: list[str]) -> bytes:
    """Texts as symbols with single breaks between words and at both ends."""
    data = _byte[np.frombuffer("\n".join(["", *texts, ""]).encode(), np.uint8)]
    keep = data != 0
    keep[1:] |= data[:-1] != 0
    keep[0] = True
    return data[keep].tobytes()


def fitted(docs: DataFrame, text: str, doc_id: str, lang: str, folds: int, held: int, max_rows: int, max_symbols: int, max_total: int) -> list[dict]:
    """One row per language in text order: lang, size and its automaton's transitions. Bounded by ``max_total`` symbols."""
    train = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold("id", folds) != held, F.lit(True)))
    # those with most labelled rows, so that each gets a useful share of the symbols
    counts = train.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, max_total // 2_000)).collect()
    if not counts:
        return []
    share = min(max_symbols, max_total // len(counts))
    # eight times the rows wanted, by a hash, so that a language with a third of all rows is thinned out before it is ordered
    part = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 8 * max_rows / r["n"]))])[F.col("lang")]
    keyed = train.withColumn("h", F.xxhash64("id", "text", F.lit(13))).filter(F.pmod("h", F.lit(1 << 40)) < part * float(1 << 40)).withColumn("long", F.octet_length("text") > share)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h"))
    picked = keyed.select("lang", "long", "h").withColumn("place", place).filter(F.col("place") <= max_rows)
    rows = keyed.join(F.broadcast(picked.dropDuplicates(["lang", "h"]).drop("long")), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def build(key: tuple, t: pa.Table) -> pa.Table:
        taken, size = [], 0
        rows = sorted(zip(t.column("long").to_pylist(), t.column("place").to_pylist(), t.column("text").to_pylist()))
        for long, _, x in rows:
            n = len(joined([x]))
            if not long and 2 < n <= share - size:
                taken.append(x)
                size += n
        learned = joined(taken) if taken else joined([rows[0][2]])[:share]
        source, byte, target = automaton(learned)
        return pa.table({"lang": [key[0].as_py()], "size": pa.array([len(learned)], pa.int64()), "source": [source.tobytes()], "byte": [byte.tobytes()], "target": [target.tobytes()]})

    built = rows.select("lang", "long", "place", "text").groupBy("lang").applyInArrow(build, "lang string, size long, source binary, byte binary, target binary").collect()
    return sorted((r.asDict() for r in built if r["size"] > 2), key=lambda r: r["lang"].encode())


class Parser:
    """All automata in one table of steps: where a symbol leads from a state, negative (as its complement) where it begins a phrase."""

    def __init__(self, fits: list[dict]):
        parts = [(np.frombuffer(f["source"], np.int32).astype(np.int64), np.frombuffer(f["byte"], np.uint8), np.frombuffer(f["target"], np.int32).astype(np.int64)) for f in fits]
        seen = np.bincount(np.concatenate([b for _, b, _ in parts]), minlength=256)
        common = [b for b in np.argsort(-seen, kind="stable")[: SYMBOLS - 1] if seen[b]]
        code = np.zeros(256, np.uint8)
        code[common] = np.arange(1, len(common) + 1)
        self.code = code[_byte]
        base, tables = [0], []
        for source, byte, target in parts:
            states = int(max(target.max(), source.max())) + 2
            table = np.zeros((states, SYMBOLS), np.int32)
            known = code[byte] > 0
            at = (base[-1] + target[known]) * SYMBOLS
            # the last state has no past: any symbol begins a phrase there; one that the labelled text lacks leads back to it
            start = np.full(SYMBOLS, (base[-1] + states - 1) * SYMBOLS)
            first = source[known] == 0
            start[code[byte[known]][first]] = at[first]
            table[:] = ~start
            table[source[known], code[byte[known]]] = at
            tables.append(table)
            base.append(base[-1] + states)
        self.table = np.concatenate(tables).ravel()
        self.start = (np.array(base[1:], np.int64)[:, None] - 1) * SYMBOLS
        self.bits = np.array([math.log2(f["size"]) for f in fits])

    def phrases(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of every text in every language (languages x texts) and the texts' symbols."""
        data, bounds = utf8(column)
        texts = len(bounds) - 1
        total, size = np.zeros((len(self.start), texts)), np.zeros(texts, np.int64)
        for lo, hi in blocks(data, bounds, _BREAK):
            raw = data[lo:hi]
            of = np.searchsorted(bounds, np.arange(lo, hi), side="right") - 1 if hi - lo < 4096 else np.repeat(np.arange(texts), np.diff(np.clip(bounds, lo, hi)))
            broken = _BREAK[raw]
            # the first break of several stays, and none at the beginning of a text
            keep = ~broken
            keep[1:] |= ~broken[:-1] & (of[1:] == of[:-1])
            symbols, of = self.code[raw[keep]].astype(np.int64), of[keep]
            if not len(symbols):
                continue
            size += np.bincount(of, minlength=texts)
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            length = np.diff(np.append(begin, len(of)))
            cuts = -(-length // SEGMENT)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = np.repeat(begin, cuts) + nth * SEGMENT
            own = np.minimum(SEGMENT, np.repeat(begin + length, cuts) - start)
            order = np.argsort(-own, kind="stable")
            start, own = start[order], own[order]
            active = len(own) - np.searchsorted(own[::-1], np.arange(SEGMENT), side="right")
            state = np.repeat(self.start, len(own), axis=1)
            found = np.zeros(state.shape, np.int64)
            for k in range(int(own[0])):
                m = active[k]
                step = self.table[state[:, :m] + symbols[start[:m] + k]]
                sign = step >> 31
                found[:, :m] -= sign
                state[:, :m] = step ^ sign
            for row, f in zip(total, found):
                row += np.bincount(of[start], f, texts)
        return total, size


def languages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", folds: int = 5, held: int = 0, max_rows: int = 400, max_symbols: int = 40_000, max_total: int = 400_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark)
    fits = fitted(docs, text, doc_id, lang, folds, held, max_rows, max_symbols, max_total)
    names = [f["lang"] for f in fits]
    known = spark.sparkContext.broadcast(fits)
    key = ("language", uuid.uuid4().hex)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = per_worker(key, lambda: Parser(known.value)) if names else None
        for batch in batches:
            out = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in batch.column(1).to_pylist()], bool)
            if names and lettered.any():
                found, _ = parser.phrases(batch.column(1))
                bits = found * parser.bits[:, None]
                best = bits.argmin(axis=0)
                weight = np.exp2(-np.minimum(bits - bits.min(axis=0), 1000))
                score = np.where(lettered, 1 / weight.sum(axis=0), 0.0)
                out = np.where(lettered, best, -1)
            pred = pa.array([names[i] if i >= 0 else "und" for i in out], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pred, pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(doc_id, text).mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")
    return out.select(F.col("doc_id").alias(doc_id), F.coalesce(fold("doc_id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
