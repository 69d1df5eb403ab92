"""A context-mixing range coder for token ids, run on many lanes of a block at once.

A block's ids are cut into lanes of equal length. All lanes step together and share one adaptive model, which is
updated after each step with the ids of all lanes; the decoder sees the same ids and stays in step. A block starts
from a fresh model, so any block decodes alone.

The model mixes three predictions: order 0, adaptive counts of all ids; order 1, the id that last followed the id
before; order 2, the id that last followed the two before. How far orders 1 and 2 are trusted is learned for each pair of
their confidences. The mixture is one distribution over all ids, whose cumulative sums are integers out of 2**30,
and each id takes one step of a carryless range coder with 64-bit state, 16 bits out at a time.
"""

from __future__ import annotations

import numpy as np

LANES = 8192
LANE_IDS = 128

_SCALE = 22  # order-0 sums are out of 2**22
_WEIGHTS = 8  # mixing weights are out of 2**8
_TOTAL = np.uint64(_SCALE + _WEIGHTS)
_ADD = 24
_EVERY = 4  # steps between updates of the order-0 sums and of the mixing weights
_TABLE = 18
_BUCKET = 6  # order-0 sums are looked up by value in buckets of 2**6
_TOP = np.uint64(1 << 48)
_BOTTOM = np.uint64(1 << 40)
_U16, _U48 = np.uint64(16), np.uint64(48)

#: Confidence after a miss (first row) and after a hit, by confidence before; a prediction with 0 or 1 is replaced.
_TRUST = np.array([[1, 1, *(t >> 1 for t in range(2, 16))], [min(t + 1, 15) for t in range(16)]], dtype=np.int64).ravel()
_T1, _T2, _AGREE = np.arange(512) >> 5, (np.arange(512) >> 1) & 15, np.arange(512) & 1


class _Model:
    """Everything encoder and decoder adapt alike.

    Table entries hold a prediction above 4 bits of confidence; those of order 2 also, above 28 bits, the id before.
    """

    def __init__(self, lanes: int, alphabet: int):
        self.alphabet = alphabet
        self.counts = np.ones(alphabet, dtype=np.int64)
        self.one_back = np.zeros(alphabet, dtype=np.int64)
        self.two_back = np.full(1 << _TABLE, -1 << 28, dtype=np.int64)
        # by pair of confidences and agreement: times seen, order-1 hits, order-2 hits
        self.seen = np.full(512, 4, dtype=np.int64)
        self.hits = np.zeros((2, 512), dtype=np.int64)
        self.one = np.zeros(lanes, dtype=np.int64)
        self.two = np.zeros(lanes, dtype=np.int64)
        self.waiting: list[tuple] = []
        self._settle()

    def _settle(self) -> None:
        sums = np.r_[0, np.cumsum(self.counts)]
        self.sums = ((sums << _SCALE) // sums[-1]).astype(np.int32)
        self.shares = np.diff(self.sums)
        within = np.bincount(self.sums[1:-1] >> _BUCKET, minlength=1 << (_SCALE - _BUCKET))
        self.below = np.r_[0, np.cumsum(within)]
        shares = ((1 << _WEIGHTS) - 4) * self.hits // self.seen
        self.share1 = np.where((_T1 > 0) & ~((_AGREE > 0) & (_T2 > 0)), shares[0], 0).astype(np.int32)
        self.share2 = np.where(_T2 > 0, shares[1], 0).astype(np.int32)

    def predict(self) -> None:
        self.slot = ((self.one * 0x9E3779B1 + self.two * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - _TABLE)
        entry = self.one_back.take(self.one)
        self.p1, self.t1 = entry >> 4, entry & 15
        entry = self.two_back.take(self.slot)
        self.p2 = (entry >> 4) & 0xFFFFFF
        self.t2 = (entry & 15) * (entry >> 28 == self.one)
        self.agree = self.p1 == self.p2
        self.case = self.t1 << 5 | self.t2 << 1 | self.agree
        self.w1, self.w2 = self.share1.take(self.case), self.share2.take(self.case)
        self.w0 = (1 << _WEIGHTS) - self.w1 - self.w2

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each lane's id in the mixture."""
        start = self.w0 * self.sums.take(ids) + ((self.w1 * (self.p1 < ids) + self.w2 * (self.p2 < ids)) << _SCALE)
        size = self.w0 * self.shares.take(ids) + ((self.w1 * (self.p1 == ids) + self.w2 * (self.p2 == ids)) << _SCALE)
        return start, size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id whose interval holds each lane's value."""
        full1, full2 = self.w1 << _SCALE, self.w2 << _SCALE
        start1 = self.w0 * self.sums.take(self.p1) + full2 * (self.p2 < self.p1)
        start2 = self.w0 * self.sums.take(self.p2) + full1 * (self.p1 < self.p2)
        past1 = value >= start1 + self.w0 * self.shares.take(self.p1) + full1 + full2 * self.agree
        past2 = value >= start2 + self.w0 * self.shares.take(self.p2) + full2 + full1 * self.agree
        rest = value - full1 * past1 - full2 * past2
        # exact: a quotient is at least 1/256 away from the next integer unless it is one
        ids = self._holding(np.minimum((rest / self.w0).astype(np.int32), (1 << _SCALE) - 1))
        ids = np.where((value >= start1) & ~past1, self.p1, ids)
        return np.where((value >= start2) & ~past2, self.p2, ids)

    def _holding(self, value: np.ndarray) -> np.ndarray:
        """The last id whose order-0 sum is not above each value: by bucket, then by halving within one."""
        bucket = value >> _BUCKET
        low, high = self.below.take(bucket), self.below.take(bucket + 1)
        open_ = np.flatnonzero(low < high)
        lo, hi, v = low[open_], high[open_], value[open_]
        while len(open_):
            middle = (lo + hi) >> 1
            up = self.sums.take(middle + 1) <= v
            lo, hi = np.where(up, middle + 1, lo), np.where(up, hi, middle)
            low[open_] = lo
            on = np.flatnonzero(lo < hi)
            open_, lo, hi, v = open_[on], lo[on], hi[on], v[on]
        return low

    def update(self, ids: np.ndarray) -> None:
        hit1, hit2 = self.p1 == ids, (self.p2 == ids) & (self.t2 > 0)
        self.waiting.append((ids, 3 * self.case + np.maximum(hit1, 2 * hit2)))
        self.one_back[self.one] = np.where(hit1 | (self.t1 > 1), self.p1, ids) << 4 | _TRUST.take(self.t1 + (hit1 << 4))
        self.two_back[self.slot] = (self.one << 28 | np.where(hit2 | (self.t2 > 1), self.p2, ids) << 4
                                    | _TRUST.take(self.t2 + (hit2 << 4)))
        self.one, self.two = ids, self.one
        if len(self.waiting) == _EVERY:
            every, outcome = (np.concatenate(w) for w in zip(*self.waiting))
            self.waiting = []
            if self.counts.sum() + _ADD * len(every) >= 1 << _SCALE:
                self.counts = (self.counts + 1) >> 1
            self.counts += _ADD * np.bincount(every, minlength=self.alphabet)
            outcomes = np.bincount(outcome, minlength=3 * 512).reshape(512, 3)
            self.seen += outcomes.sum(axis=1)
            self.hits += outcomes.T[1:]
            if self.seen.max() > 1 << 20:
                self.seen = (self.seen >> 1) + 4
                self.hits >>= 1
            self._settle()


def shape(n: int) -> tuple[int, int]:
    """(lanes, steps) for ``n`` ids."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


_LARGEST = np.uint64((1 << (_SCALE + _WEIGHTS)) - 1)


def _ready(low: np.ndarray, span: np.ndarray, among: np.ndarray | None) -> np.ndarray:
    """Lanes whose top 16 bits are settled, or get settled by cutting a span that became too short."""
    if among is None:
        some = np.flatnonzero((span < _BOTTOM) | ((low ^ (low + span)) < _TOP))
    else:
        l, s = low[among], span[among]
        some = among[(s < _BOTTOM) | ((l ^ (l + s)) < _TOP)]
    l, s = low[some], span[some]
    cut = some[(l ^ (l + s)) >= _TOP]
    if len(cut):
        span[cut] = (~low[cut] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
    return some


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in ascending order, and the rank of each id among them."""
    if not len(ids):
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int64)
    there = np.bincount(ids) > 0
    return np.flatnonzero(there), (np.cumsum(there) - 1)[ids]


def encode(ids: np.ndarray, alphabet: int) -> tuple[bytes, np.ndarray]:
    """The bytes of all lanes, one after another, and how many each lane has."""
    lanes, steps = shape(len(ids))
    table = np.zeros(lanes * steps, dtype=np.int64)
    table[: len(ids)] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    model = _Model(lanes, alphabet)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    out = np.zeros((lanes, 3 * steps + 8), dtype="<u2")
    at = np.zeros(lanes, dtype=np.int64)
    for row in table:
        model.predict()
        start, size = model.interval(row)
        unit = span >> _TOTAL
        low += unit * start.astype(np.uint64)
        span = unit * size.astype(np.uint64)
        go = _ready(low, span, None)
        while len(go):
            out[go, at[go]] = low[go] >> _U48
            at[go] += 1
            low[go] <<= _U16
            span[go] <<= _U16
            go = _ready(low, span, go)
        model.update(row)
    for _ in range(4):
        out[np.arange(lanes), at] = low >> _U48
        at += 1
        low <<= _U16
    return b"".join(out[i, :k].tobytes() for i, k in enumerate(at)), at * 2


def decode(data: bytes, lengths: np.ndarray, n: int, alphabet: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    lanes, steps = shape(n)
    model = _Model(lanes, alphabet)
    words = np.frombuffer(data, dtype="<u2").astype(np.uint64)
    words = np.r_[words, np.zeros(8, dtype=np.uint64)]
    at = np.r_[0, np.cumsum(lengths // 2)[:-1]].astype(np.int64)
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    code = np.zeros(lanes, dtype=np.uint64)
    for _ in range(4):
        code = code << _U16 | words[at]
        at += 1
    table = np.zeros((steps, lanes), dtype=np.int64)
    for k in range(steps):
        model.predict()
        unit = span >> _TOTAL
        value = np.minimum((code - low) // unit, _LARGEST).astype(np.int32)
        ids = model.find(value)
        start, size = model.interval(ids)
        low += unit * start.astype(np.uint64)
        span = unit * size.astype(np.uint64)
        go = _ready(low, span, None)
        while len(go):
            code[go] = code[go] << _U16 | words[np.minimum(at[go], len(words) - 1)]
            at[go] += 1
            low[go] <<= _U16
            span[go] <<= _U16
            go = _ready(low, span, go)
        table[k] = ids
        model.update(ids)
    return table.T.ravel()[:n]
