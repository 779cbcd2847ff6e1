"""Token ids in binary segments with Elias-Fano document boundaries.

A table of segments is one concatenated array of ids, cut after whole documents. A segment is a binary image:

    magic 8 bytes | n_docs u32 | id width u8 | low bits u8 | pad u16 | n_ids u64 | bytes of high bits u32 | samples u32 |
    doc ids i64 each | null marks u8 each | low bits | high bits | select samples u32 each | ids (u16 or u32, little endian)

The n_docs + 1 boundaries are monotone; Elias-Fano keeps their low bits packed and their high bits in unary, about 2 + log2(ids per
document) bits each. Every 64th one-bit is sampled, so ``select`` finds a boundary by a short scan and no 64-bit offsets are kept.
Segments are rows of a Parquet table (part, seq, part_start, n_docs, n_ids, image): task commits make a lost executor harmless, and
the store can be anything that Spark writes.

Defined results: a null text is empty and holds the end id only; null ids come first; rows that repeat a doc_id are ordered by text
hash; extra columns are not read; an empty table gives no segments.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import per_worker, shared_root, small_batches
from .memo import UnitMemo

MAGIC = b"BLSEG01\0"
HEAD = "<8sIBBHQII"
EVERY = 64
#: Ids in a segment; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 15


class EliasFano:
    """A rising list of integers: build(), select(i) and all()."""

    def __init__(self, n: int, low_width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, low_width, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), at[::EVERY].astype(np.uint32))

    def _low(self, i: int) -> int:
        a = i * self.width
        part = int.from_bytes(self.low[a // 8: (a + self.width + 7) // 8].tobytes(), "little")
        return (part >> (a % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, whole bytes are counted until the i-th one-bit lies in one."""
        at, left = int(self.samples[i // EVERY]), i % EVERY
        byte, word = at // 8, int(self.high[at // 8]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        return ((byte * 8 + (word & -word).bit_length() - 1 - i) << self.width) | self._low(i)

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.int64)
        return ((at - np.arange(self.n)) << self.width) | (low << np.arange(self.width)).sum(axis=1)


def pack(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
    ef = EliasFano.build(np.fromiter(accumulate(map(len, docs), initial=0), np.uint64, len(docs) + 1))
    kind = "<u2" if not len(ids) or int(ids.max()) < 1 << 16 else "<u4"
    head = struct.pack(HEAD, MAGIC, len(docs), int(kind[-1]), ef.width, 0, len(ids), len(ef.high), len(ef.samples))
    return b"".join([head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), ef.low.tobytes(),
                     ef.high.tobytes(), ef.samples.astype("<u4").tobytes(), ids.astype(kind).tobytes()])


class Segment:
    """Reads a segment image: ``doc_ids``, ``boundaries``, ``ids`` and ``document(i)`` by two selects."""

    def __init__(self, image: bytes):
        magic, n, size, width, _, n_ids, high, samples = struct.unpack_from(HEAD, image)
        if magic != MAGIC:
            raise ValueError("not a segment")
        at = struct.calcsize(HEAD)

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls = part("<i8", n), part("u1", n)
        self.boundaries = EliasFano(n + 1, width, part("u1", ((n + 1) * width + 7) // 8), part("u1", high), part("<u4", samples))
        self.ids = part(f"<u{size}", n_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.boundaries.select(i): self.boundaries.select(i + 1)]


class WordMemo:
    """Byte-level BPE ids by the tokenizers library, which splits texts before merging.

    A single space before a word always opens a new piece, and so do a single line feed and the word after it. Texts whose white
    space is of that kind alone are encoded unit by unit, each distinct unit once; all other texts go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        (self.feed,) = self.whole("\n")
        self.memo = UnitMemo(self.fresh, "\n")

    @classmethod
    def get(cls, path: str) -> WordMemo:
        """The memo of this worker process, which goes on from task to task."""
        return per_worker((cls.__name__, path), lambda: cls(path))

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units are encoded many at a time, a line feed before each; a unit that opens with one itself keeps it."""
        sizes, flat = [], []
        for a in range(0, len(units), 5000):
            some = units[a: a + 5000]
            plain = np.array([u[1:].split() == [u[1:]] for u in some])
            feed = np.array([u[0] == "\n" for u in some])
            text = "\n".join(["", *(u[1:] if f else u for u, f, x in zip(some, feed, plain) if x), "x"])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            feeds = np.flatnonzero(ids == self.feed)
            size = np.full(len(some), -1)
            size[plain] = np.diff(feeds) - ~feed[plain]
            keep = np.ones(len(ids), bool)
            keep[feeds[:-1][~feed[plain]]] = False
            sizes.append(size)
            flat.append(ids[: feeds[-1]][keep[: feeds[-1]]])
        return np.concatenate(sizes), np.concatenate(flat)

    def encode(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        for text, ids in zip(texts, self.memo.encode(texts)):
            yield np.append(np.array(self.whole(text), np.int32) if ids is None else ids[1:], np.int32(end)).astype(np.uint32)


def write_segments(docs: DataFrame, path: str, tokenizer: str, end: int = 2, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> None:
    """Encode ``docs`` in ascending doc_id order into a segment table at ``path``. ``tokenizer`` is a file present on every machine."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    dealt = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns(
        {"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part = WordMemo.get(tokenizer), TaskContext.get().partitionId()
        keys: list[int | None] = []
        docs: list[np.ndarray] = []
        seq = start = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, size, keys, docs
            row = [[part], [seq], [start], [len(docs)], [size], [pack(keys, docs)]]
            seq, start, size, keys, docs = seq + 1, start + size, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                              ["part", "seq", "part_start", "n_docs", "n_ids", "image"])

        for batch in batches:
            for key, ids in zip(batch.column("doc_id").to_pylist(), memo.encode(batch.column("text").to_pylist(), end)):
                if docs and size + len(ids) > SEGMENT_IDS:
                    yield flush()
                keys.append(key)
                docs.append(ids)
                size += len(ids)
        if docs:
            yield flush()

    dealt.select("doc_id", "text").mapInArrow(encode, "part int, seq int, part_start long, n_docs long, n_ids long, image binary").write.mode("overwrite").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the segments alone.

    Only one number per part, of which there are as many as partitions were asked for, passes the driver.
    """
    small_batches(spark)
    rows = spark.read.schema("part int, seq int, part_start long, n_docs long, n_ids long, image binary").parquet(path)
    sums = sorted(map(tuple, rows.groupBy("part").agg(F.sum("n_ids")).collect()))
    bases = dict(zip((p for p, _ in sums), accumulate((s for _, s in sums), initial=0)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(batch.column("part").to_pylist(), batch.column("part_start").to_pylist(), batch.column("image")):
                s = Segment(image.as_py())
                edges = s.boundaries.all()
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(edges[:-1], edges[1:])]
                keys = pc.if_else(pa.array(s.nulls.astype(bool)), pa.scalar(None, pa.int64()), pa.array(s.doc_ids))
                yield pa.RecordBatch.from_arrays([keys, pa.array(edges[:-1] + before + bases[part]), pa.array(np.diff(edges)), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("part", "part_start", "image").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write segments (to the shared folder unless ``path`` is given) and read them back."""
    import uuid

    path = path or f"{shared_root(docs.sparkSession)}/segments-{uuid.uuid4().hex}"
    write_segments(docs, path, tokenizer, **options)
    return read_segments(docs.sparkSession, path)
