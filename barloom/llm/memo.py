"""A bounded memo of token ids for the recurring words of a corpus, looked up by arrays instead of one dictionary access per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .words import _powers, blocks, mix

_CODES = np.arange(1, 257, dtype=np.uint64)
_OPENS = np.zeros(256, bool)
_OPENS[[0x20, 0x0A]] = True


class UnitMemo:
    """Encodes texts unit by unit; a unit is a space or line feed with what follows up to the next one.

    ``fresh`` gives, for units not seen before, how many ids each has and all ids in a row; the number is -1 for a unit that may not be
    encoded by itself, and a text with such a unit is answered with None and must be encoded whole. ``opening`` is the character put before each text. Units are known by a 64-bit hash;
    the memo starts anew when ``capacity`` is exceeded, so its size does not grow with the corpus.
    """

    def __init__(self, fresh: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], opening: str, capacity: int = 1_500_000):
        self.fresh, self.opening, self.capacity = fresh, opening.encode(), capacity
        self.mask = np.uint64((1 << (2 * capacity - 1).bit_length()) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.slots = np.zeros(int(self.mask) + 1, np.int32)
        self.at, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.int32)
        self.units = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Positions of the units, -1 where unknown."""
        out = np.full(len(h), -1, np.int64)
        i = h & self.mask
        left = np.arange(len(h))
        while len(left):
            k = self.keys[i]
            hit = k == h[left]
            out[left[hit]] = self.slots[i[hit]]
            on = ~hit & (k != 0)
            left, i = left[on], (i[on] + np.uint64(1)) & self.mask
        return out

    def _add(self, h: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        n, total = self.units + len(h), self.used + len(flat)
        while len(self.at) < n:
            self.at, self.size = np.concatenate([self.at, self.at]), np.concatenate([self.size, self.size])
        while len(self.pool) < total:
            self.pool = np.concatenate([self.pool, self.pool])
        self.size[self.units: n] = sizes
        self.at[self.units: n] = self.used + np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]])
        self.pool[self.used: total] = flat
        slot = np.arange(self.units, n, dtype=np.int32)
        self.units, self.used = n, total
        i = h & self.mask
        while len(h):
            free = self.keys[i] == 0
            self.keys[i[free]] = h[free]
            won = free & (self.keys[i] == h)
            self.slots[i[won]] = slot[won]
            h, slot, i = h[~won], slot[~won], (i[~won] + np.uint64(1)) & self.mask

    def encode(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        parts = [self.opening + t.encode() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        raw = b"".join(parts)
        data = np.frombuffer(raw, np.uint8)
        hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi in blocks(data, bounds, _OPENS):
            part = data[lo:hi]
            first = _OPENS[part]
            at = np.flatnonzero(first)
            power, inverse = _powers(hi - lo)
            hashes.append(mix(np.add.reduceat(_CODES[part] * power[: hi - lo], at) * inverse[at]))
            starts.append(at + lo)
        h, start = np.concatenate(hashes), np.concatenate(starts)
        h[h == 0] = 1
        if self.units > self.capacity:
            self.clear()
        where = self._find(h)
        new = np.flatnonzero(where < 0)
        if len(new):
            fresh, first = np.unique(h[new], return_index=True)
            ends = np.append(start[1:], len(raw))
            for a in range(0, len(fresh), self.capacity // 2):
                some = new[first[a: a + self.capacity // 2]]
                self._grow(fresh[a: a + self.capacity // 2], [raw[start[x]: ends[x]].decode() for x in some])
            where[new] = self._find(h[new])
        size, at = self.size[where], self.at[where]
        whole = size < 0
        size = np.maximum(size, 0)
        stops = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(at - stops[:-1], size) + np.arange(stops[-1])]
        edges = np.searchsorted(start, bounds)
        odd = np.concatenate([[0], np.cumsum(whole)])
        for a, b in zip(edges[:-1], edges[1:]):
            yield None if odd[b] > odd[a] else ids[stops[a]: stops[b]]

    def _grow(self, h: np.ndarray, units: list[str]) -> None:
        while self.units + len(h) > (int(self.mask) + 1) * 3 // 4:
            keys, slots = self.keys, self.slots
            self.mask = np.uint64(2 * int(self.mask) + 1)
            self.keys, self.slots = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)
            there = keys != 0
            k, s, i = keys[there], slots[there], keys[there] & self.mask
            while len(k):
                free = self.keys[i] == 0
                self.keys[i[free]] = k[free]
                won = free & (self.keys[i] == k)
                self.slots[i[won]] = s[won]
                k, s, i = k[~won], s[~won], (i[~won] + np.uint64(1)) & self.mask
        self._add(h, *self.fresh(units))
