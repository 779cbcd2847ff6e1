"""SentencePiece encoding and decoding by a streaming Viterbi over piece lattices.

The lattice has a node at each character boundary. For a BPE model the path to a node is the one whose last two pieces the merges
would leave apart (a pair is checked once by merging the two alone and remembered); a sequence of pieces is the encoding exactly if
each neighbouring pair is. For a unigram model the path is the one with the largest sum of scores. A step looks back at most
``longest`` characters, so a window of that length decides: whenever the backpointer paths of all nodes in the window meet in one
boundary, everything before it is committed and forgotten.

Boundaries that no piece of the vocabulary spans are known in advance: all paths meet there. Short stretches between two such
boundaries recur, and a bounded memo keeps their ids.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows and ids are encoded one by one;
columns named ids or decoded are replaced; an empty table gives an empty result. Spaces decode exactly; the character U+2581 itself
decodes as a space, as it does in the library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import per_worker, small_batches
from .memo import UnitMemo

SPACE = "▁"
MEMO = 400_000
SHORT = 64


class PieceModel:
    """Pieces, scores and byte ids of a model file; all the coding is done here."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool], bytes_at: dict[int, int], unknown: int = 0, bpe: bool = True, pairs: int = 1_000_000):
        self.pieces, self.scores, self.bpe, self.unknown = pieces, scores, bpe, unknown
        self.ids = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.byte_id, self.byte_of = bytes_at, {i: b for b, i in bytes_at.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.control = {i for i in range(len(pieces)) if not plain[i]} - set(self.byte_of)
        said = [bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() if i not in self.control else " ⁇ ".encode() if i == unknown else b"" for i, p in enumerate(pieces)]
        #: the bytes that ids decode to, one after the other
        self.said, self.sizes = np.frombuffer(b"".join(said), np.uint8), np.array([len(x) for x in said], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n+" if not crossing and not any("\n" in p for p in self.ids) else r"(?s).+")
        self.max_pairs = pairs
        #: each end of a piece, with the id of the piece if it is one itself and else -1: where it has no entry, no longer piece ends there
        self.endings: dict[str, int] = {}
        for p, i in self.ids.items():
            for k in range(len(p)):
                self.endings.setdefault(p[k:], -1)
            self.endings[p] = i
        self.apart: dict[int, bool] = {}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.units = UnitMemo(self.fresh, " ")

    @classmethod
    def get(cls, path: str) -> PieceModel:
        """The model of this worker process; what it remembers goes on from task to task."""
        return per_worker((cls.__name__, path), lambda: cls.load(path))

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
        pieces = [m.id_to_piece(i) for i in range(n)]
        return cls(pieces, [m.get_score(i) for i in range(n)], [not x for x in special], {int(pieces[i][3:-1], 16): i for i in range(n) if m.is_byte(i)}, m.unk_id())

    def merged(self, symbols: list[str]) -> list[str]:
        """The plain merges: the best-scored neighbouring pair that is a piece, the leftmost among equals, until none is left."""
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return symbols
            symbols[at: at + 2] = [symbols[at] + symbols[at + 1]]

    def _spines(self, piece: str) -> tuple[list, list] | None:
        """The symbols at the left and the right edge of a piece while it is merged by itself, each with the score of the merge that
        takes it in (None for the last); None where merges do not come in falling order of scores."""
        symbols, left, right, last = list(piece), [], [], None
        while True:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = self.ids.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            if last is not None and best >= last:
                return None
            last = best
            if at == 0:
                left.append((symbols[0], best))
            if at == len(symbols) - 2:
                right.append((symbols[-1], best))
            symbols[at: at + 2] = [symbols[at] + symbols[at + 1]]
        return ([*left, (piece, None)], [*right, (piece, None)]) if symbols == [piece] else None

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging two pieces side by side gives the two pieces: no symbol at the right edge of the one may merge with a symbol
        at the left edge of the other before either goes into a merge of its own piece."""
        if len(self.apart) >= self.max_pairs:
            self.apart.clear()
        for p in (left, right):
            if p not in self.edges:
                self.edges[p] = self._spines(self.pieces[p])
        a, b = self.edges[left], self.edges[right]
        if a is None or b is None:
            pair = [self.pieces[left], self.pieces[right]]
            found = self.merged(list("".join(pair))) == pair
        else:
            i, j, found = 0, 0, None
            while found is None:
                (x, mine), (y, yours) = a[1][i], b[0][j]
                k = self.ids.get(x + y)
                if k is not None and (mine is None or self.scores[k] > mine) and (yours is None or self.scores[k] >= yours):
                    found = False
                elif mine is None and yours is None:
                    found = True
                elif yours is None or (mine is not None and mine >= yours):
                    i += 1
                else:
                    j += 1
        self.apart[left * len(self.pieces) + right] = found
        return found

    def _walk(self, s: str, first: int, last: int, base: int, back: list[int], what: list[int], total: list[float]) -> None:
        """Extend the best paths by the nodes ``first`` to ``last``. The three lists hold, from node ``base`` on, the boundary before, the
        last piece (-1 for a character that is no piece and stands alone) and the score of the best path to a node."""
        endings, apart, n, longest, bpe = self.endings, self.apart, len(self.pieces), self.longest, self.bpe
        for j in range(first, last + 1):
            ways = []
            for i in range(j - 1, max(base, j - longest) - 1, -1):
                k = endings.get(s[i:j])
                if k is None:
                    break
                if k >= 0:
                    ways.append((i, k))
            start, piece, best = j - 1, -1, None
            if bpe:
                for i, k in reversed(ways):
                    before = what[i - base]
                    ok = before < 0 or apart.get(before * n + k)
                    if ok or (ok is None and self.stay_apart(before, k)):
                        start, piece = i, k
                        break
            else:
                for i, k in ways:
                    score = total[i - base] + self.scores[k]
                    if best is None or score > best:
                        start, piece, best = i, k, score
            back.append(start)
            what.append(piece)
            total.append(total[start - base] - 1e6 if best is None else best)

    def stream(self, s: str) -> Iterator[list[int]]:
        """Ids of ``s``, committed as soon as all surviving paths share a boundary; what lies before it is forgotten."""
        base, back, what, total = 0, [0], [-1], [0.0]
        at = 0
        while at < len(s):
            to = min(len(s), at + 4 * self.longest)
            self._walk(s, at + 1, to, base, back, what, total)
            at = to
            alive = set(range(max(base, at - self.longest + 1), at + 1)) if at < len(s) else {at}
            while len(alive) > 1:
                top = max(alive)
                alive.remove(top)
                alive.add(back[top - base])
            meet = alive.pop()
            if meet > base:
                yield self._path(s, back, what, base, meet)
                del back[: meet - base], what[: meet - base], total[: meet - base]
                base = meet

    def _path(self, s: str, back: list[int], what: list[int], base: int, end: int) -> list[int]:
        out: list[int] = []
        while end > base:
            start = back[end - base]
            if what[end - base] >= 0:
                out.append(what[end - base])
            else:
                out += [self.byte_id.get(x, self.unknown) for x in reversed(s[start:end].encode())] if self.byte_id else [self.unknown]
            end = start
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, out = self.memo, []
        for part in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            got = memo.get(part)
            if got is None:
                got = tuple(chain.from_iterable(self.stream(part)))
                if len(part) <= SHORT:
                    memo[part] = got
            out += got
        return out

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space or line feed with the word after it; several spaces in a row belong together and go with their text.

        The units are taken in sorted order, and each goes on from the nodes of what it has in common with the one before.
        """
        found: list[list[int] | None] = [None] * len(units)
        last, back, what, total = "", [0], [-1], [0.0]
        for x in sorted(range(len(units)), key=units.__getitem__):
            u = units[x]
            if len(u) < 2 or SPACE in u:
                continue
            s = u.replace(" ", SPACE)
            if len(s) > SHORT or "\n" in s:
                found[x] = [i for part in self.cut.findall(s) for ids in self.stream(part) for i in ids]
                continue
            same = len(commonprefix((last, s)))
            del back[same + 1:], what[same + 1:], total[same + 1:]
            self._walk(s, same + 1, len(s), 0, back, what, total)
            found[x], last = self._path(s, back, what, 0, len(s)), s
        return np.array([-1 if f is None else len(f) for f in found], np.int64), np.array([i for f in found if f for i in f], np.int32)

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text, ids in zip(texts, self.units.encode(texts)):
            yield np.array(self.encode(text), np.int32) if ids is None or not text else ids

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The bytes of all ids in a row; bytes that are no UTF-8 become U+FFFD."""
        x = np.asarray(ids, np.int64)
        size = self.sizes[x]
        first = np.repeat(self.starts[x] - np.cumsum(size) + size, size)
        text = self.said[first + np.arange(len(first))].tobytes().decode("utf-8", "replace")
        return text[text.startswith(SPACE):].replace(SPACE, " ")


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of int). ``model`` is a file present on every machine."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids")
    column = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel.get(model)
        for batch in batches:
            ids = list(m.encode_all([t or "" for t in batch.column(column).to_pylist()]))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield _with(batch, "ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))

    return docs.mapInArrow(work, T.StructType([*docs.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``docs`` with decoded, the text of their ids."""
    small_batches(docs.sparkSession)
    docs = docs.drop("decoded")
    column = docs.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel.get(model)
        for batch in batches:
            yield _with(batch, "decoded", pa.array([m.decode(x or []) for x in batch.column(column).to_pylist()], pa.string()))

    return docs.mapInArrow(work, T.StructType([*docs.schema, T.StructField("decoded", T.StringType())]))


def _checksums(lists: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    return pa.array([len(x) for x in lists], pa.int64()), pa.array([zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in lists], pa.int64())


def digests(docs: DataFrame, ids: str = "ids") -> DataFrame:
    """``docs`` with n_ids and ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    column = docs.columns.index(ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x.values if x.is_valid else [], "<u4") for x in batch.column(column)]
            n, sums = _checksums(lists)
            yield _with(_with(batch, "n_ids", n), "ids_crc32", sums)

    return docs.mapInArrow(work, T.StructType([*docs.schema, T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def coded(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``encode``, ``decode`` and ``digests`` in one pass of one Python worker per task: ids, n_ids, ids_crc32 and round_trip (whether the
    ids decode to the text, null taken as empty) in place of the text. Columns of these names are replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "n_ids", "ids_crc32", "round_trip")
    column = docs.columns.index(text)
    others = [i for i in range(len(docs.columns)) if i != column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel.get(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(column).to_pylist()]
            ids = list(m.encode_all(texts))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            out = batch.select(others)
            for name, values in (("ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))),
                                 *zip(("n_ids", "ids_crc32"), _checksums(ids)), ("round_trip", pa.array([m.decode(x) == t for x, t in zip(ids, texts)], pa.bool_()))):
                out = _with(out, name, values)
            yield out

    kinds = [("ids", T.ArrayType(T.IntegerType())), ("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType())]
    return docs.mapInArrow(work, T.StructType([*[docs.schema[i] for i in others], *[T.StructField(n, k) for n, k in kinds]]))
