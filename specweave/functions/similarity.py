"""String and vector similarity kernels.

The longest common subsequence uses the bit-parallel recurrence of Crochemore et
al. (2001) and Hyyrö (2004): one addition per query character over bit vectors.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 64
WIDE = 512          # places that kinds of letters are dealt to
_PAIRS = 1 << 14


def lcs_length(a: str, b: str) -> int:
    """LCS of two texts of any length (Python integers as bit vectors)."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio_of(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2.0 * lcs_length(a, b) / total if total else 1.0


@F.pandas_udf(T.DoubleType())
def indel_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """2·LCS/(len a + len b) at four decimals; null when a side is null."""
    return pd.Series(
        [
            None if a is None or b is None else round(indel_ratio_of(a, b), 4)
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


class NameBlock:
    """Names ready for LCS against one query at a time.

    Shorter names are padded: a padded position matches nothing and never counts.
    """

    def __init__(self, names: list[str]):
        self.lengths = np.array([len(n) for n in names])
        longest = int(self.lengths.max())
        self.words = max(1, -(-longest // _WORD))
        raw = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.alphabet, place = np.unique(raw, return_inverse=True)
        self.row_of = {int(c): i for i, c in enumerate(self.alphabet)}
        letters, count = len(self.alphabet), len(names)
        starts = self.lengths.cumsum() - self.lengths
        # per letter: how often each name has it, and where (one bit per position)
        self.counts = np.zeros((letters, count), dtype=np.int32)
        self.masks = np.zeros((letters, self.words, count), dtype=np.uint64)
        for at in range(longest):
            column = np.flatnonzero(self.lengths > at)
            letter = place[starts[column] + at]
            self.counts[letter, column] += 1
            self.masks[letter, at // _WORD, column] |= np.uint64(1) << np.uint64(at % _WORD)

    def reachable(self, query: str, cut: float, among: np.ndarray | None = None) -> np.ndarray:
        """Names (of ``among``) that share enough letters to reach ``cut``: the LCS is no
        longer than the overlap of the two letter multisets."""
        if among is None:
            among = np.arange(len(self.lengths))
        shared = np.zeros(len(among), dtype=np.int32)
        for ch, n in Counter(query).items():
            row = self.row_of.get(ord(ch))
            if row is not None:
                shared += np.minimum(self.counts[row][among], n)
        return among[2.0 * shared / (len(query) + self.lengths[among]) >= cut]

    def lcs(self, query: str, among: np.ndarray) -> np.ndarray:
        """LCS length of the query with each of the names ``among``."""
        rows = [self.row_of[ord(ch)] for ch in query if ord(ch) in self.row_of]
        used = sorted(set(rows))
        masks = dict(zip(used, self.masks[used][:, :, among])) if used else {}
        state = [np.full(len(among), ~np.uint64(0)) for _ in range(self.words)]
        for row in rows:
            mask = masks[row]
            carry = None
            for w in range(self.words):
                v = state[w]
                u = v & mask[w]
                total = v + u
                if w + 1 == self.words and carry is None:
                    state[w] = total | (v ^ u)
                    break
                over = total < v
                if carry is not None:
                    total += carry
                    over |= total < carry
                state[w] = total | (v ^ u)
                carry = over.astype(np.uint64)
        # matched positions are zero bits; unused and padded bits stay one
        return sum(np.bitwise_count(~v).astype(np.int64) for v in state)

    def rows(self, queries: list[str]) -> np.ndarray:
        """The letters of each query as rows of the masks; -1 where the names have none, or the query ends."""
        lengths = np.array([len(q) for q in queries])
        raw = np.frombuffer("".join(queries).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, raw), len(self.alphabet) - 1)
        out = np.full((len(queries), int(lengths.max(initial=0))), -1, np.int32)
        out[np.arange(out.shape[1]) < lengths[:, None]] = np.where(self.alphabet[at] == raw, at, -1)
        return out

    def lcs_pairs(self, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """LCS length of the i-th query (of :meth:`rows`) with the j-th name, for each pair."""
        masks = np.concatenate([self.masks, np.zeros_like(self.masks[:1])])  # -1 matches nothing
        out = np.empty(len(i), np.int64)
        for first in range(0, len(i), _PAIRS):
            asked, names = rows[i[first : first + _PAIRS]], j[first : first + _PAIRS]
            state = [np.full(len(names), ~np.uint64(0)) for _ in range(self.words)]
            for t in range(asked.shape[1]):
                carry = None
                for w in range(self.words):
                    v, u = state[w], state[w] & masks[asked[:, t], w, names]
                    total = v + u
                    over = total < v
                    if carry is not None:
                        total += carry
                        over |= total < carry
                    state[w] = total | (v ^ u)
                    carry = over.astype(np.uint64)
            out[first : first + _PAIRS] = sum(np.bitwise_count(~v).astype(np.int64) for v in state)
        return out


class LetterSets:
    """The letters of many names, the k-th of a kind apart from the others."""

    def __init__(self, names: list[str]):
        self.lengths = np.array([len(n) for n in names], np.int64)
        raw = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(names)), self.lengths)
        order = np.lexsort((raw, owner))
        self.owner, letter = owner[order], raw[order]
        new = np.ones(len(letter), bool)
        new[1:] = (letter[1:] != letter[:-1]) | (self.owner[1:] != self.owner[:-1])
        at = np.arange(len(letter))
        self.code = letter << np.uint64(32) | (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        self.kinds = np.unique(self.code)

    def counts(self, kinds: np.ndarray) -> np.ndarray:
        """How many of a name's letters fall on each of at most WIDE places."""
        out = np.zeros((len(self.lengths), min(WIDE, max(1, len(kinds)))), np.float32)
        if len(kinds):
            at = np.minimum(np.searchsorted(kinds, self.code), len(kinds) - 1)
            held = kinds[at] == self.code
            if len(kinds) <= WIDE:
                out[self.owner[held], at[held]] = 1
            else:
                np.add.at(out, (self.owner[held], at[held] % WIDE), 1)
        return out


def common(left: LetterSets, right: LetterSets) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product bounds from above what names share of their letters; it is exact
    for up to WIDE kinds of letters, as min(a, b) is no more than a times b."""
    kinds = np.intersect1d(left.kinds, right.kinds, assume_unique=True)
    return left.counts(kinds), right.counts(kinds).T


def rank_of(values: list) -> np.ndarray:
    """Position of each value in sorted order (ties broken by position)."""
    order = sorted(range(len(values)), key=values.__getitem__)
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.arange(len(values))
    return rank


def best(scores: np.ndarray, ranks: np.ndarray, keep: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best kept entries by (score descending, rank)."""
    idx = np.flatnonzero(keep)
    if len(idx) > k:
        # everything at or above the k-th score, so that ties are settled by rank
        cut = np.partition(scores[idx], len(idx) - k)[len(idx) - k]
        idx = idx[scores[idx] >= cut]
    return idx[np.lexsort((ranks[idx], -scores[idx]))][:k]


def matrix_of(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (float64) and a flag per row: right size, finite, not zero."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    out = np.zeros((n, dim))
    if n == 0:
        return out, np.zeros(0, dtype=bool)
    sizes = arr.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = sizes == dim
    flat = arr.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    out[fits] = flat.astype(np.float64).reshape(-1, dim)
    # scale by the largest part first: squares of tiny or huge parts stay in range
    with np.errstate(all="ignore"):
        top = np.abs(out).max(axis=1, initial=0.0)
        good = fits & np.isfinite(top) & (top > 0)
        out[good] /= top[good, None]
        out[good] /= np.sqrt((out[good] ** 2).sum(axis=1))[:, None]
    out[~good] = 0.0
    return out, good
