"""Distinct-chunk tables: each distinct chunk of text is tokenized once in a worker, and ids are joined back by position."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textkernel

#: Entries after which a worker's table starts anew; results don't depend on it.
ENTRIES = 1 << 20
#: Bytes of the entries' chunks after which it starts anew too.
ENTRY_BYTES = 64 << 20


class ChunkTable:
    """Ids by chunk: entries with the chunk's bytes and the place and length of its ids in a pool, found by sorted hashes in a large and a small index.

    ``encode``: the ids of chunks, given with their kinds, in a row, and the number of ids of each. A chunk takes the ids of an entry only if their bytes are equal; one that merely shares the hash of another goes on to the next hash of its own.
    """

    def __init__(self, encode: Callable[[list[bytes], list[int]], tuple[np.ndarray, np.ndarray]], entries: int = ENTRIES):
        self.encode, self.entries = encode, entries
        self._clear()

    def _clear(self) -> None:
        #: Sorted hashes and their entries; new ones go to the second index, which is merged into the first when it has grown to a fourth of it.
        self.indexes = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        #: Of each entry: kind, place and length of the bytes, place and length of the ids.
        self.facts, self.n = np.zeros((5, 1 << 12), np.int64), 0
        self.bytes, self.used_bytes = np.zeros(1 << 16, np.uint8), 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    @staticmethod
    def _put(pool: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
        """The pool with more at its end, and eight places to spare."""
        need = used + len(more)
        if need + 8 > len(pool):
            pool = np.concatenate((pool, np.zeros(max(need + 8, 2 * len(pool)) - len(pool), pool.dtype)))
        pool[used:need] = more
        return pool, need

    def _add(self, keys: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray, kind: np.ndarray) -> None:
        text = data.tobytes()
        chunks = [text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        ids, length = self.encode(chunks, kind.tolist())
        size = e - s
        facts = np.stack((kind.astype(np.int64), self.used_bytes + np.cumsum(size) - size, size, self.used + np.cumsum(length) - length, length))
        self.pool, self.used = self._put(self.pool, self.used, ids)
        self.bytes, self.used_bytes = self._put(self.bytes, self.used_bytes, np.frombuffer(b"".join(chunks), np.uint8))
        if self.n + len(keys) > self.facts.shape[1]:
            self.facts = np.concatenate((self.facts, np.zeros((5, max(len(keys), self.facts.shape[1])), np.int64)), axis=1)
        self.facts[:, self.n : self.n + len(keys)] = facts
        large, small = self.indexes
        small = self._merged(small, keys, np.arange(self.n, self.n + len(keys)))
        if 4 * len(small[0]) > len(large[0]):
            large, small = self._merged(large, *small), (small[0][:0], small[1][:0])
        self.indexes, self.n = [large, small], self.n + len(keys)

    @staticmethod
    def _merged(index: tuple[np.ndarray, np.ndarray], keys: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(index[0], keys)
        return np.insert(index[0], at, keys), np.insert(index[1], at, entries)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each hash; -1 where there is none."""
        out = np.full(len(keys), -1)
        for known, entries in self.indexes:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit] = entries[at[hit]]
        return out

    def ids(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and the number of ids of each. ``kind``: passed to the encoder; chunks of different kinds are different."""
        place, length = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if self.n > self.entries or self.used_bytes > ENTRY_BYTES:
            self._clear()
        todo = np.arange(len(h))
        while len(todo):
            keys, first, inverse = np.unique(h[todo], return_index=True, return_inverse=True)
            entry = self._find(keys)
            if (entry < 0).any():
                missing = np.flatnonzero(entry < 0)
                new = todo[first[missing]]
                entry[missing] = np.arange(self.n, self.n + len(missing))
                self._add(keys[missing], data, s[new], e[new], kind[new])
            entry = entry[inverse]
            size = e[todo] - s[todo]
            good = (self.facts[0, entry] == kind[todo]) & (self.facts[2, entry] == size)
            some = np.flatnonzero(good)
            good[some] = textkernel.same(data, s[todo[some]], size[some], self.bytes, self.facts[1, entry[some]])
            place[todo[good]], length[todo[good]] = self.facts[3, entry[good]], self.facts[4, entry[good]]
            todo = todo[~good]
            if len(todo):
                h = h.copy()
                h[todo] = textkernel.mix(h[todo] + np.uint64(1))
        end = np.cumsum(length)
        where = np.repeat(place - (end - length), length) + np.arange(end[-1] if len(end) else 0)
        return self.pool[where], length


def cuts(data: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks that begin where ``first`` is true or a document does: starts, ends, and those before each document."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    first[at[at < len(data)]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, at)


