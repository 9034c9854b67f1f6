"""Texts of an Arrow batch as NumPy arrays of words, for the Python operators of this package.

A word is a run of bytes of one class; every class used here keeps or drops all bytes of
a non-ASCII letter alike, so UTF-8 need not be decoded.  Working memory is bounded by the
longest text of a batch plus a constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


def byte_class(drop: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[np.frombuffer(drop, np.uint8)] = False
    return table


SPACES = b"\x20" + bytes(range(0x09, 0x0E))
NOT_SPACE = byte_class(SPACES)
LETTERS = byte_class(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, as long as the longest piece so far."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK_BYTES + 4096)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = _powers(_BASE, self.n), _powers(inverse, self.n)
        return self.up, self.down


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole value."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span ``data[start:end]``; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + CHUNK_BYTES, "right")))
        high = ends[to - 1]
        up, down = _POWERS.upto(int(high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        # + 1 so that a leading zero byte counts
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((total[e] - total[s]) * down[s])
        at = to
    return out


def runs_of(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags; a run never goes over one of the breaks."""
    if not len(flags):
        none = np.empty(0, np.int64)
        return none, none
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(flags))]
    first[inner] = flags[inner]
    last = flags.copy()
    last[:-1] &= ~flags[1:]
    last[inner - 1] = flags[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@dataclass
class Words:
    """Words of consecutive texts: ``of[d]:of[d + 1]`` are those of text ``d``."""

    data: np.ndarray  # the bytes that starts and ends refer to
    bounds: np.ndarray  # byte bounds of the texts
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def n(self) -> int:
        return len(self.of) - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(self.n), np.diff(self.of))

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words of all runs of ``k`` words within a text, and the runs' hashes."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        out = hashes[:n].copy()
        for j in range(1, k):
            out *= _BASE
            out += hashes[j : j + n]
        owner = self.text_of()
        at = np.flatnonzero(owner[:n] == owner[k - 1 :])
        return at, mixed(out[at])


def texts_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte bounds) of slices of about CHUNK_BYTES.

    Null counts as empty.  A text is never cut; a longer one is a slice of its own.
    """
    column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, len(column))
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def words_of(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray, lower: bool) -> Words:
    if lower:
        data = LOWER[data]
    starts, ends = runs_of(keep[data], bounds)
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def reduced(how: np.ufunc, values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``how`` over the slices ``of[d]:of[d + 1]`` of ``values``; zero for an empty slice."""
    out = np.zeros((len(of) - 1, *values.shape[1:]), values.dtype)
    some = of[1:] > of[:-1]
    if some.any():
        out[some] = how.reduceat(values[: of[-1]], of[:-1][some], axis=0)
    return out
