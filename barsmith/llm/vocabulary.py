"""Encoding by distinct words: each different word of a worker's texts is encoded once, then gathered by index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .common import gathered


class HashIndex:
    """Numbers of 64-bit keys, in arrays: open addressing with linear probing, at most half full."""

    def __init__(self, bits: int = 14):
        self.count = 0
        self._room(bits)

    def _room(self, bits: int) -> None:
        self.bits = bits
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if it has none."""
        mask = (1 << self.bits) - 1
        slot = self._slot(keys)
        out = self.numbers[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & mask
            got = self.numbers[slot]
            out[todo] = got
            more = (got >= 0) & (self.keys[slot] != keys[todo])
            todo, slot = todo[more], slot[more]
        return out

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = self._slot(keys)
        while len(keys):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = numbers[free]  # of several at one place the last one stays
            self.keys[slot[free]] = keys[free]
            lost = self.numbers[slot] != numbers
            keys, numbers, slot = keys[lost], numbers[lost], (slot[lost] + 1) & mask

    def add(self, keys: np.ndarray) -> None:
        """Number new, different keys on from `count`."""
        numbers = np.arange(self.count, self.count + len(keys), dtype=np.int32)
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            held = self.numbers >= 0
            old, old_numbers = self.keys[held], self.numbers[held]
            self._room((2 * self.count).bit_length())
            self._put(old, old_numbers)
        self._put(keys, numbers)


class WordCodes:
    """Ids of words by their 64-bit hash.

    encode: (bytes, starts, ends) of different words to (all ids, ids per word), ids of `kind`.
    The arrays held stay below about `limit` bytes; beyond that it starts afresh.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], kind: type = np.uint16, limit: int = 64 << 20):
        self.encode, self.kind, self.limit = encode, kind, limit
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex()
        self.pool, self.start, self.size, self.used = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), 0

    def held(self) -> int:
        return sum(x.nbytes for x in (self.pool, self.start, self.size, self.index.keys, self.index.numbers))

    def _grown(self, x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x) // 2), x.dtype)])

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words concatenated, ids per word); keys: 64-bit, equal for words to be encoded alike."""
        if not len(keys):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        if self.held() > self.limit:
            self.clear()
        at = self.index.find(keys)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            where = missing[first]
            ids, sizes = self.encode(data, start[where], end[where])
            n, m = self.index.count, self.used
            self.pool, self.start, self.size = self._grown(self.pool, m + len(ids)), self._grown(self.start, n + len(new)), self._grown(self.size, n + len(new))
            self.pool[m : m + len(ids)] = ids
            self.size[n : n + len(new)] = sizes
            self.start[n : n + len(new)] = m + np.cumsum(sizes) - sizes
            self.used += len(ids)
            self.index.add(new)
            at[missing] = self.index.find(keys[missing])
        size = self.size[at].astype(np.int64)
        return gathered(self.pool, self.start[at].astype(np.int64), size), size
