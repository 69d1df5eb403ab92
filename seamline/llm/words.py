"""Words of whole texts and their 64-bit hashes, computed on Arrow buffers without a Python loop.

A word is a longest run of bytes other than space and 0x09-0x0D. Hashes ignore the case of A-Z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21
SLICE_ROWS = 1024  # rows of a column that are copied at a time
SURE_BYTES = 256  # a polynomial modulo 2^64 tells shorter words apart but by chance

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_EXACT = np.random.default_rng(20_240_601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[ord("A"): ord("Z") + 1] = _FOLDED[ord("a"): ord("z") + 1]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"): ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        size = max(1 << (n - 1).bit_length(), CHUNK_BYTES)  # doubled, so seldom made anew
        tables = []
        for base in (_BASE, inverse):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers


@dataclass
class Words:
    """Words of some consecutive texts: ``data`` holds their bytes, ``offsets`` where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)

    def hashes(self, exact: bool = False) -> np.ndarray:
        """A hash of each word, blind to the case of A-Z unless ``exact``.

        The hash is a polynomial modulo 2^64. Words of about a thousand letters can be made that it does not tell apart;
        ``sure_hashes`` does.
        """
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        up, down = _power_tables(len(self.data))
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((_EXACT if exact else _FOLDED)[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


    def sure_hashes(self, exact: bool = False) -> np.ndarray:
        """``hashes``, with a cryptographic digest for words of more than ``SURE_BYTES``."""
        keys = self.hashes(exact)
        if not len(keys) or (self.ends - self.starts).max() <= SURE_BYTES:
            return keys
        return digests_of_long(self.data if exact else _LOWER[self.data], self.starts, self.ends, keys)


def digests_of_long(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The keys, those of spans of more than ``SURE_BYTES`` replaced by a digest of their bytes."""
    long = np.flatnonzero(ends - starts > SURE_BYTES)
    for i in long.tolist():
        keys[i] = int.from_bytes(hashlib.blake2b(data[starts[i]: ends[i]].tobytes(), digest_size=8).digest(), "little")
    return keys


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8)
    return data, offsets


def words_of(column: pa.Array, chunk_bytes: int = CHUNK_BYTES, separators: np.ndarray = _SPACE) -> Iterator[Words]:
    """The words of all texts of a column, in chunks of whole texts of about ``chunk_bytes``.

    ``separators`` tells for each byte whether it ends a word; white space by default.
    """
    for row in range(0, len(column), SLICE_ROWS):
        part = column.slice(row, SLICE_ROWS)
        data, offsets = text_buffers(part)
        first = 0
        while first < len(part):
            last = int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1
            last = min(max(last, first + 1), len(part))
            yield _spans(row + first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first], separators)
            first = last


def _spans(first: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return Words(first, data, offsets, none, none, none)
    space = separators[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = cut[:-1].copy()
    before[1:] |= space[:-1]
    after = cut[1:].copy()
    after[:-1] |= space[1:]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(after & ~space) + 1
    return Words(first, data, offsets, starts, ends, np.searchsorted(offsets, starts, "right") - 1)


def ngrams(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and the text of each."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    m = len(words) - n + 1
    h = words[:m].copy()
    for k in range(1, n):
        h = h * np.uint64(0xA0761D6478BD642F) + words[k: m + k]
    inside = text[:m] == text[n - 1:]
    return mix(h[inside]), text[:m][inside]


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    out = np.zeros(len(column), dtype=np.int64)
    data, offsets = text_buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        lo, hi = offsets[first], offsets[last]
        if hi > lo:
            space = _SPACE[data[lo:hi]]
            begins = ~space
            begins[1:] &= space[:-1]
            local = offsets[first: last + 1] - lo
            edge = local[:-1][local[:-1] < hi - lo]
            begins[edge] = ~space[edge]
            running = np.r_[0, np.cumsum(begins)]
            out[first:last] = running[local[1:]] - running[local[:-1]]
        first = last
    return out
