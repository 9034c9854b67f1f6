"""Byte-pair merges of many short words at once, in NumPy.

Each round merges in every word its pair of the lowest rank, the leftmost of equal ones, as merging one
word after the other would.  Words stand in columns of like length, so a round is a few passes over rows.
"""

from __future__ import annotations

import numpy as np

WIDTH = 4096  # words merged together
ROW_BITS = 6
LONGEST = (1 << ROW_BITS) - 2
SLOTS = 1 << 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_MISSING = np.int32((1 << 31 - ROW_BITS) - 1)
_FAR = np.int32((1 << 31) - 1)


class Merges:
    """``pairs[r]`` are the two symbols that the merge of rank ``r`` joins to ``product[r]``; ``first`` are the
    symbols of the 256 bytes."""

    def __init__(self, first: np.ndarray, pairs: np.ndarray, product: np.ndarray) -> None:
        self.none = int(max(first.max(), product.max(initial=0))) + 1
        self.first, self.product = first.astype(np.int32), product.astype(np.int32)
        slots = SLOTS
        while slots < 8 * len(pairs):
            slots *= 2
        self.shift, self.mask = np.uint64(64 - (slots.bit_length() - 1)), slots - 1
        self.keys, self.ranks = np.full(slots, -1, np.int64), np.full(slots, _MISSING, np.int32)
        keys, ranks = pairs[:, 0].astype(np.int64) * (self.none + 1) + pairs[:, 1], np.arange(len(pairs), dtype=np.int32)
        slot = self._slots(keys)
        while len(keys):  # the first comer of a free slot takes it, the others go on
            at, one = np.unique(slot, return_index=True)
            one = one[self.keys[at] < 0]
            self.keys[slot[one]], self.ranks[slot[one]] = keys[one], ranks[one]
            left = np.ones(len(keys), bool)
            left[one] = False
            keys, ranks, slot = keys[left], ranks[left], slot[left] + 1 & self.mask
        both = np.repeat(self.first, 256), np.tile(self.first, 256)
        self.of_bytes = self._ranked(*both)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> self.shift).view(np.int64)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of every pair, _MISSING for those that don't merge."""
        keys = a.astype(np.int64)
        keys *= self.none + 1
        keys += b
        slot = self._slots(keys)
        there = self.keys[slot]
        out = self.ranks[slot]
        other = np.flatnonzero(there != keys)
        out[other] = _MISSING
        other = other[there[other] >= 0]
        while len(other):
            slot[other] = slot[other] + 1 & self.mask
            there = self.keys[slot[other]]
            hit = there == keys[other]
            out[other[hit]] = self.ranks[slot[other[hit]]]
            other = other[~hit & (there >= 0)]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of words ``data[start:end]`` of 1 to LONGEST bytes, the first place and the number of each word's."""
        size = ends - starts
        order = np.argsort(size.astype(np.uint8), kind="stable")
        symbols, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(order), WIDTH):
            some = order[at : at + WIDTH]
            one, n = self._merged(data, starts[some], size[some])
            symbols.append(one)
            counts.append(n)
        n = np.concatenate(counts)
        first, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        first[order], count[order] = np.cumsum(n) - n, n
        return np.concatenate(symbols), first, count

    def _merged(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, most = len(size), int(size[-1])
        row = np.arange(most)[:, None]
        inside = row < size
        letters = data[np.minimum(starts + row, len(data) - 1)]
        # a row of nothing at either end
        symbol = np.full((most + 2, n), self.none, np.int32)
        np.copyto(symbol[1:-1], self.first[letters], where=inside)
        key = np.full((most + 2, n), _FAR, np.int32)
        rank = self.of_bytes[letters[:-1].astype(np.int32) << 8 | letters[1:]]
        np.copyto(key[1:-2], rank << ROW_BITS | (row[:-1] + 1).astype(np.int32), where=inside[1:] & (rank < _MISSING))
        keys, symbol = key, symbol.ravel()
        key = key.ravel()
        place = np.arange(len(symbol))
        after, before = place + n, place - n
        while True:
            best = keys.min(0)
            column = np.flatnonzero(best < _FAR)
            if not len(column):
                break
            best = best[column]
            at = (best & (1 << ROW_BITS) - 1) * np.int64(n) + column
            left, gone = before[at], after[at]
            right = after[gone]
            made = self.product[best >> ROW_BITS]
            symbol[at], symbol[gone], key[gone] = made, self.none, _FAR
            after[at], before[right] = right, at
            changed = np.concatenate((left, at))
            rank = self._ranked(np.concatenate((symbol[left], made)), np.concatenate((made, symbol[right])))
            key[changed] = np.where(rank < _MISSING, rank << ROW_BITS | (changed // n).astype(np.int32), _FAR)
        symbol = symbol.reshape(-1, n).T
        kept = symbol != self.none
        return symbol[kept], kept.sum(1)
