"""Vectorised views of Arrow text columns, shared by the llm operators.

Everything here works on a *chunk*: consecutive rows of one Arrow batch whose
texts hold about ``CHUNK`` bytes together (a longer text is a chunk of its
own). A chunk bounds the numpy temporaries of a task, whatever the batch size.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

#: Multipliers of the 64-bit finaliser (fixed values, any odd constants do).
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Base of the polynomial hash; odd, so it has an inverse modulo 2**64.
_BASE = 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * _GOLD)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offs


def spans(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``size`` bytes each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def chunks(col: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each chunk."""
    data, offs = utf8(col)
    for i, j in spans(offs, size):
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]


_space = np.zeros(256, bool)
_space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return _lower[b]


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_byte_code = seeds(256, salt=1)


_BLOCK = 1 << 20


def run_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run codes[start:end] of unsigned 64-bit codes: the
    polynomial of the run, from prefix sums. Runs are in order; they are taken
    in blocks, so that the power tables stay small for very long texts."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = len(start) if len(codes) - lo <= _BLOCK else max(i + 1, int(np.searchsorted(end, lo + _BLOCK, "right")))
        s, e = start[i:j] - lo, end[i:j] - lo
        part = codes[lo:end[j - 1]]
        up, down = _powers(1 << max(12, len(part).bit_length()))
        with np.errstate(over="ignore"):
            acc = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[:len(part)], out=acc[1:])
            out[i:j] = mix64((acc[e] - acc[s]) * down[s] + (e - s).astype(np.uint64) * _GOLD)
        i = j
    return out


class HashIndex:
    """Open-addressing map from 64-bit hashes to integers, probed and filled
    by whole arrays."""

    def __init__(self, bits: int = 14):
        self.bits, self.used = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The value of each hash, -1 where it is absent."""
        h = np.where(h == 0, np.uint64(1), h)
        out, at, pos = np.full(len(h), -1, np.int32), np.arange(len(h)), self._slot(h)
        while len(at):
            k = self.keys[pos]
            hit = k == h[at]
            out[at[hit]] = self.vals[pos[hit]]
            go = ~hit & (k != 0)
            at, pos = at[go], (pos[go] + 1) & (len(self.keys) - 1)
        return out

    def add(self, h: np.ndarray, v: np.ndarray) -> None:
        """Hashes that are distinct and absent."""
        if 2 * (self.used + len(h)) > len(self.keys):
            old = self.keys != 0
            keys, vals = self.keys[old], self.vals[old]
            bits = max(self.bits + 1, (4 * (self.used + len(h))).bit_length())
            self.__init__(bits)
            self.add(keys, vals)
        self.used += len(h)
        h = np.where(h == 0, np.uint64(1), h)
        pos = self._slot(h)
        while len(h):
            free = self.keys[pos] == 0
            self.keys[pos[free]] = h[free]
            won = free & (self.keys[pos] == h)
            self.vals[pos[won]] = v[won]
            h, v, pos = h[~won], v[~won], (pos[~won] + 1) & (len(self.keys) - 1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i] + lengths[i] - 1 of all i in a row."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0)
    return out + np.repeat(starts - (ends - lengths), lengths)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk: byte start and end, the row
    each lies in, its 64-bit hash, and per row the first word's index."""

    def __init__(self, b: np.ndarray, offs: np.ndarray):
        n = len(offs) - 1
        word = ~_space[b]
        cut = np.zeros(len(b) + 1, bool)
        cut[offs] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | cut[1:-1]
        last[:-1] &= ~word[1:] | cut[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(n), self.count)
        self.hash = run_hash(_byte_code[b], self.start, self.end)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words; a row with fewer words than k
    gives its whole sequence as one, a row without words none."""
    with np.errstate(over="ignore"):
        n = len(w.hash)
        coef = seeds(k, salt=2) | np.uint64(1)
        h = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            h += w.hash[i:n - k + 1 + i] * coef[i]
        full = w.row[:len(h)] == w.row[k - 1:] if len(h) else np.zeros(0, bool)
        row, h = w.row[:len(h)][full], mix64(h[full])
        short = np.flatnonzero((w.count > 0) & (w.count < k))
        if len(short):
            extra = np.array([functools.reduce(lambda a, x: (a * int(_BASE) + int(x)) & (2**64 - 1), w.hash[w.first[r]:w.first[r + 1]], int(w.count[r])) for r in short], np.uint64)
            row, h = np.concatenate([row, short]), np.concatenate([h, mix64(extra)])
            order = np.argsort(row, kind="stable")
            row, h = row[order], h[order]
    return row, h


def distinct_per_row(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row, then hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]


def run_ends(row: np.ndarray, n: int) -> np.ndarray:
    """First index of each row's run in a sorted row array, n + 1 bounds."""
    return np.searchsorted(row, np.arange(n + 1))
