"""Suffix arrays by induced sorting, in whole-bucket steps, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

from siltstone.llm.resident import cleaned

_U = np.uint64
WIDEST = 4096  # alphabets up to this size are sorted by buckets


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end counts as smaller than all."""
    n = len(t)
    s = np.zeros(n, np.bool_)
    if n > 1:
        rise = t[:-1] < t[1:]
        differs = np.flatnonzero(t[:-1] != t[1:])
        # In a run of equal symbols all follow the symbol after it.
        at = np.searchsorted(differs, np.arange(n - 1))
        inside = at < len(differs)
        s[:-1][inside] = rise[differs[at[inside]]]
    return s


def _spread(sa: np.ndarray, heads: np.ndarray, pred: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Put ``pred`` at the heads of their symbols' buckets, in order, going by ``step``."""
    if not len(pred):
        return
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(first, len(s)))
    rank = np.arange(len(s)) - np.repeat(first, count)
    sa[heads[s] + step * rank] = pred[order]
    heads[s[first]] += step * count


def _induce(t: np.ndarray, small: np.ndarray, sorted_lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost-smaller suffixes."""
    n = len(t)
    counts = np.bincount(t, minlength=k)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    tails = ends - 1
    _spread(sa, tails, sorted_lms[::-1], t[sorted_lms[::-1]], -1)
    low = tails + 1  # where each bucket's leftmost-smaller suffixes begin
    heads = starts.copy()
    last = n - 1  # the last suffix is larger than the end: it comes first in its bucket
    sa[heads[t[last]]] = last
    heads[t[last]] += 1
    for c in np.flatnonzero(counts):
        at = starts[c]
        while at < heads[c]:
            pred = sa[at : heads[c]] - 1
            at = heads[c]
            pred = pred[pred >= 0]
            pred = pred[~small[pred]]
            if len(pred):
                _spread(sa, heads, pred, t[pred], 1)
        pred = sa[low[c] : ends[c]] - 1
        pred = pred[pred >= 0]
        pred = pred[~small[pred]]
        if len(pred):
            _spread(sa, heads, pred, t[pred], 1)
    tails = ends - 1
    for c in np.flatnonzero(counts)[::-1]:
        at = ends[c]
        while at > tails[c] + 1:
            pred = sa[tails[c] + 1 : at][::-1] - 1
            at = tails[c] + 1
            pred = pred[pred >= 0]
            pred = pred[small[pred]]
            if len(pred):
                _spread(sa, tails, pred, t[pred], -1)
        pred = sa[starts[c] : heads[c]][::-1] - 1
        pred = pred[pred >= 0]
        pred = pred[small[pred]]
        if len(pred):
            _spread(sa, tails, pred, t[pred], -1)
    return sa


def _doubled(t: np.ndarray, most: int | None) -> np.ndarray:
    """Suffix array by rank doubling, for alphabets too wide for bucket steps; to ``most`` symbols if given."""
    rank, width = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    while True:
        top = int(rank.max()) + 2
        after = np.zeros(len(t), np.int64)
        after[: max(len(t) - width, 0)] = rank[width:] + 1
        key = rank * top + after
        order = np.argsort(key, kind="stable")
        moved = key[order]
        steps = np.concatenate([[0], np.cumsum(moved[1:] != moved[:-1])])
        rank = np.empty(len(t), np.int64)
        rank[order] = steps
        width *= 2
        if steps[-1] == len(t) - 1 or (most is not None and width >= most) or width >= 2 * len(t):
            return order


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffix array of symbols >= 0; suffixes are told apart to ``depth`` symbols at least if given, else wholly."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    k = int(t.max()) + 1
    if k > WIDEST:
        return _doubled(t, depth)
    t = t.astype(np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(t, small, lms, k)
    # Sort the leftmost-smaller substrings, from any order of their suffixes within a symbol.
    first = _induce(t, small, lms[np.argsort(t[lms], kind="stable")], k)
    is_lms = np.zeros(n, np.bool_)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    # Name them: equal substrings, by length and hash of symbols, get equal names.
    stop = np.full(n, n, np.int64)
    stop[lms[:-1]] = lms[1:] + 1
    length = stop[ordered] - ordered
    digest = Hashes(t).of(ordered, length)
    new = np.ones(len(ordered), np.bool_)
    new[1:] = (length[1:] != length[:-1]) | (digest[1:] != digest[:-1])
    name = np.empty(n, np.int64)
    name[ordered] = np.cumsum(new) - 1
    reduced = name[lms]
    if int(new.sum()) < len(lms):
        # A leftmost-smaller substring is two symbols long at least.
        ordered = lms[suffix_array(reduced, None if depth is None else depth // 2 + 1)]
    return _induce(t, small, ordered, k)


class Hashes:
    """Hashes of any substring of a symbol string, from running sums."""

    _LUT = np.random.default_rng(5).integers(1, 2**63, 1 << 16, dtype=np.uint64) * _U(2) + _U(1)
    _BASE = 0xD1342543DE82EF95

    _KEPT: list[np.ndarray] = []

    @classmethod
    def _powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if not cls._KEPT or len(cls._KEPT[0]) < n:
            cls._KEPT.clear()
            for base in (cls._BASE, pow(cls._BASE, -1, 2**64)):
                x = np.full(max(n, 1 << 16), base, _U)
                x[0] = 1
                cls._KEPT.append(np.multiply.accumulate(x))
        return cls._KEPT[0], cls._KEPT[1]

    def __init__(self, t: np.ndarray):
        n = len(t) + 1
        up, self.down = self._powers(n)
        if t.dtype == np.uint8:
            values = self._LUT[t]
        else:
            values = self._LUT[t & 0xFFFF] + (t.astype(np.uint64) >> _U(16)) * _U(0x9E3779B97F4A7C15)
        self.sums = np.zeros(n, _U)
        np.cumsum(values * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[np.minimum(start + length, len(self.sums) - 1)] - self.sums[start]) * self.down[start]


cleaned(Hashes._KEPT.clear)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, exact: bool = True) -> np.ndarray:
    """For each place of the string: the length, up to ``most``, that its suffix shares with the one before it in the array.

    With ``exact`` false, lengths below ``most`` are given as 0.
    """
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(before >= 0)
    other, h = before[at], Hashes(t)
    room = len(t) - np.maximum(at, other)
    got = np.zeros(len(at), np.int64)
    step = 1 << most.bit_length()
    if not exact:
        # Equal hashes are followed by a look at the symbols themselves.
        maybe = np.flatnonzero((room >= most) & (h.of(at, most) == h.of(other, most)))
        for lo in range(0, len(maybe), 1 << 16):
            x = maybe[lo : lo + (1 << 16)]
            same = np.ones(len(x), np.bool_)
            for k in range(most):
                same &= t[at[x] + k] == t[other[x] + k]
            got[x[same]] = most
        step = 0
    while step:
        more = got + step
        ok = (more <= room) & (more <= most)
        ok &= h.of(at, np.where(ok, more, 0)) == h.of(other, np.where(ok, more, 0))
        got += step * ok
        step //= 2
    out = np.zeros(len(t), np.int64)
    out[at] = got
    return out
