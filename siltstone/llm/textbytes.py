"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siltstone.llm.resident import cleaned

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LUT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: list[np.ndarray] = []
cleaned(_POWERS.clear)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept for the next call."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(n, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32, count=len(column) + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` each; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Words of all rows of a slice: byte ranges, row numbers and 64-bit hashes.

    A word is a maximal run of bytes for which ``is_word`` holds; it never crosses rows. With
    ``fold``, A-Z count as a-z.
    """

    def __init__(self, column: pa.Array, is_word: np.ndarray, fold: bool = True):
        buf, offsets = flat(column)
        self.n_rows = len(offsets) - 1
        self.starts, self.ends = self._edges(buf, offsets, is_word)
        self.counts = np.diff(np.searchsorted(self.starts, offsets))
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        lut = _LUT
        if fold:
            lut = lut.copy()
            lut[65:91] = lut[97:123]
        power, self._inverse = _powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(lut[buf] * power[: len(buf)], out=sums[1:])
        self._sums, self.buf = sums, buf
        self.hashes = self._hash(self.starts, self.ends)

    @staticmethod
    def _edges(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words start and end."""
        w = np.empty(len(buf) + 1, np.bool_)
        w[:-1] = is_word[buf]
        w[-1] = False
        first = w.copy()
        first[1:] &= ~w[:-1]
        cuts = offsets[1:-1]
        inner = cuts[cuts < len(buf)]
        first[inner] = w[inner]
        after = np.empty_like(w)  # the byte after the word's last
        after[0] = False
        after[1:] = w[:-1] & (~w[1:] | first[1:])
        return np.flatnonzero(first[:-1]), np.flatnonzero(after)

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._sums[b] - self._sums[a]) * self._inverse[a] + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def affixes(self, size: int) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes, or their last for a negative one; of whole words that are shorter."""
        if size > 0:
            return self._hash(self.starts, np.minimum(self.starts + size, self.ends))
        return self._hash(np.maximum(self.ends + size, self.starts), self.ends)


def lut(is_word) -> np.ndarray:
    """A table of 256 booleans from a predicate on byte values."""
    return np.array([bool(is_word(b)) for b in range(256)])


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
