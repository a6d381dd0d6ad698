"""Ranked merges of byte pairs, folded over many words at a time."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np

#: Longer words are merged one by one with a heap: their number of rounds would grow with the longest.
LOCKSTEP_BYTES = 48
NONE = np.int32(2**31 - 1)


class Table:
    """Finds the place of 32-bit keys among those given, by open addressing; 2^32 - 1 can't be a key."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint32)
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 8))))
        size = 1 << self.bits
        self.key, self.place = np.full(size, 2**32 - 1, np.uint32), np.full(size, -1, np.int32)
        at, left, self.tries = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.tries += 1
            free = self.place[at] < 0
            slots, firsts = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[firsts]
            self.key[slots], self.place[slots] = keys[left[chosen]], left[chosen]
            stays = np.ones(len(left), bool)
            stays[chosen] = False
            left, at = left[stays], (at[stays] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self._slot(key)
        out = np.where(self.key[at] == key, self.place[at], -1)
        left = np.flatnonzero((out < 0) & (self.place[at] >= 0))
        at, key, mask = at[left], key[left], len(self.key) - 1
        for _ in range(self.tries):
            if not len(left):
                break
            at = (at + 1) & mask
            hit = self.key[at] == key
            out[left[hit]] = self.place[at[hit]]
            on = ~hit & (self.place[at] >= 0)
            left, at, key = left[on], at[on], key[on]
        return out


class Merges:
    """(left id, right id) -> (rank, id of the whole); ids have 16 bits."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]]):
        rows = np.array(list(pairs), np.int64)
        self.table = Table(rows[:, 0] * 65536 + rows[:, 1])
        self.rank, self.whole = rows[:, 2].astype(np.int32), rows[:, 3].astype(np.int32)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair's merge in ``rank`` and ``whole``, or -1."""
        return self.table.find((a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.find(a, b)
        return np.where(at >= 0, self.rank[at], NONE)

    def fold(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges words of as many symbols each (a matrix of ids): lowest rank first, leftmost first of equals.

        Yields (rows, ids) of the words that are done, by the number of ids left.
        """
        rows = np.arange(len(ids))
        rank = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(rows):
            if not rank.shape[1]:
                yield rows, ids
                return
            at = rank.argmin(1)
            going = rank[np.arange(len(rows)), at] != NONE
            if not going.all():
                yield rows[~going], ids[~going]
                rows, ids, rank, at = rows[going], ids[going], rank[going], at[going]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            ids[each, at] = self.whole[self.find(ids[each, at], ids[each, at + 1])]
            kept = np.ones(ids.shape, bool)
            kept[each, at + 1] = False
            ids = ids[kept].reshape(len(rows), -1)
            kept = np.ones(rank.shape, bool)
            kept[each, at] = False
            rank = rank[kept].reshape(len(rows), -1)
            for near in (at - 1, at):
                here = np.flatnonzero((near >= 0) & (near < rank.shape[1]))
                rank[here, near[here]] = self.ranks(ids[here, near[here]], ids[here, near[here] + 1])

    def one(self, ids: list[int]) -> list[int]:
        """The same for one long word: a heap of pairs over a doubly linked list."""
        n = len(ids)
        ids, after, before = list(ids), [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has gone into another merge
            ids[i] = int(self.whole[self.find(np.array([a]), np.array([b]))[0]])
            ids[j], after[i] = -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := int(self.ranks(np.array([ids[left]]), np.array([ids[after[left]]]))[0])) != NONE:
                    heapq.heappush(heap, (r, left, ids[left], ids[after[left]]))
        return [x for x in ids if x >= 0]

    def encoded(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, inner: np.ndarray, final: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, ids) of all words, some at a time; inner and final: the id of a byte, and of a word's last byte."""
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            if size > LOCKSTEP_BYTES:
                for w in which:
                    word = data[starts[w]: starts[w] + size]
                    yield np.array([w]), np.array([self.one([*inner[word[:-1]].tolist(), int(final[word[-1]])])])
                continue
            byte = data[starts[which][:, None] + np.arange(size)]
            ids = inner[byte]
            ids[:, -1] = final[byte[:, -1]]
            for rows, out in self.fold(ids):
                yield which[rows], out
