"""Vectorised hashing of words, lines and word shingles over Arrow string columns.

Texts are read as the UTF-8 bytes of an Arrow array, without a Python object per word. Work goes block by block, so temporaries
stay near ``BLOCK`` bytes times a small factor however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SHINGLE = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3)]

_plain = np.arange(1, 257, dtype=np.uint64)
_plain[list(_SPACES)] = 0
_folded = _plain.copy()
_folded[65:91] = _plain[97:123]

_pow = _inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        tables = []
        for factor in (_MULT, pow(_MULT, -1, 1 << 64)):
            t = np.full(n, factor, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _pow, _inv = tables
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the bounds of each; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]: bounds[-1]], bounds - bounds[0]


def blocks(data: np.ndarray, bounds: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``BLOCK`` bytes that end where a text ends or at a byte for which ``stop`` (by byte value) holds."""
    lo, end = int(bounds[0]), int(bounds[-1])
    while lo < end:
        hi = min(lo + BLOCK, end)
        while hi < end:
            cut = np.flatnonzero(stop[data[hi: hi + 4096]])
            text = int(bounds[np.searchsorted(bounds, hi)])
            found = min(hi + int(cut[0]) if len(cut) else end, text)
            if found < hi + 4096 or found == end:
                hi = found
                break
            hi += 4096
        yield lo, hi
        lo = hi


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the bounds of each text among them.

    ``fold`` lower-cases A-Z first.
    """
    data, bounds = utf8(column)
    table, stop = (_folded if fold else _plain), _plain == 0
    hashes, starts = [], []
    for lo, hi in blocks(data, bounds, stop):
        codes = table[data[lo:hi]]
        inside = codes != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = bounds[np.searchsorted(bounds, lo): np.searchsorted(bounds, hi)] - lo
        first[edges] = inside[edges]
        at = np.flatnonzero(first)
        if len(at):
            power, inverse = _powers(hi - lo)
            hashes.append(mix(np.add.reduceat(codes * power[: hi - lo], at) * inverse[at]))
            starts.append(at + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles; with fewer words the whole sequence is the one shingle."""
    hashes, bounds = word_hashes(column)
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        rolled += hashes[j: j + len(rolled)] * _SHINGLE[j % 5] + np.uint64(j)
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= n:
            yield np.unique(rolled[a: b - n + 1])
        elif b > a:
            part = hashes[a:b]
            with np.errstate(over="ignore"):
                short = sum((part[j: j + 1] * _SHINGLE[j % 5] + np.uint64(j) for j in range(b - a)), np.full(1, (b - a) << 32, np.uint64))
            yield mix(short)
        else:
            yield hashes[:0]
