"""Words and hashes of whole Arrow text columns, vectorised over their UTF-8 buffers.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}; null counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15))


class _Hasher:
    """Sum of T[b_k] * B**k over a word's bytes, by prefix sums; then mixed with the length."""

    def __init__(self, seed: int):
        self.table = randoms(256, seed)
        self.base = int(randoms(1, seed + 77)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 16)
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                p = np.full(n, b, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, U)
        self._grow(len(data))
        v = self.table[data]
        v *= self.powers[: len(data)]
        c = np.cumsum(v)
        h = c[ends - 1] - c[starts] + v[starts]
        h *= self.inverses[starts]
        return mix(h + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


_HASHERS: dict[int, _Hasher] = {}


def hasher(seed: int = 0) -> _Hasher:
    if seed not in _HASHERS:
        _HASHERS[seed] = _Hasher(seed)
    return _HASHERS[seed]


@dataclass
class Words:
    """Words of consecutive rows: word i is data[starts[i]:ends[i]]; row r has words first[r]:first[r + 1]."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, seed: int = 0) -> np.ndarray:
        return hasher(seed)(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.first) - 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, nulls empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, o, d = column.buffers()
    offsets = np.frombuffer(o, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(column: pa.Array, lower: bool = False, size: int = 1 << 20) -> Iterator[Words]:
    """The words of a column, some MB of rows at a time; a row is never cut."""
    offsets, data = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        lo, hi = offsets[at], offsets[to]
        part = data[lo:hi]
        if lower:
            part = _LOWER[part]
        edges = offsets[at : to + 1] - lo
        word = ~_SPACE[part]
        cut = np.zeros(len(part) + 1, bool)
        cut[edges] = True
        before = np.empty(len(part), bool)
        after = np.empty(len(part), bool)
        if len(part):
            before[0], before[1:] = True, ~word[:-1]
            after[-1], after[:-1] = True, ~word[1:]
        starts = np.flatnonzero(word & (before | cut[:-1]))
        ends = np.flatnonzero(word & (after | cut[1:])) + 1
        yield Words(at, part, starts, ends, np.searchsorted(starts, edges))
        at = to


def distinct_per_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each slice bounds[r]:bounds[r + 1], concatenated, with their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate(([0], np.cumsum(sizes)))
