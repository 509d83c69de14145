"""A wavelet matrix over token ids: one self-contained blob of bit-planes with rank directories."""

from __future__ import annotations

import struct

import numpy as np

_MAGIC = b"WVM1"
_BLOCK = 512  # bits between two entries of a plane's rank directory


class WaveletMatrix:
    """Bit-planes from the highest bit down; after each, zeros come before ones, in stable order."""

    def __init__(self, n: int, width: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.width, self.planes, self.ranks, self.zeros = n, width, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> width:
            raise ValueError(f"ids need more than {width} bit-planes")
        cur = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for shift in range(width - 1, -1, -1):
            one = (cur & cur.dtype.type(1 << shift)) != 0
            plane = np.packbits(one, bitorder="little")
            planes.append(plane)
            ranks.append(cls._directory(plane))
            low = cur[~one]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[one]])
        return cls(len(ids), width, planes, ranks, zeros)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        per = np.add.reduceat(np.bitwise_count(plane).astype(np.uint32), np.arange(0, len(plane), _BLOCK // 8)) if len(plane) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sQB", _MAGIC, self.n, self.width) + struct.pack(f"<{self.width}Q", *self.zeros)
        return b"".join([head, *(x.tobytes() for pair in zip(self.planes, self.ranks, strict=True) for x in pair)])

    @classmethod
    def from_bytes(cls, blob: bytes | memoryview) -> WaveletMatrix:
        magic, n, width = struct.unpack_from("<4sQB", blob)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        zeros = list(struct.unpack_from(f"<{width}Q", blob, 13))
        at, size, entries = 13 + 8 * width, (n + 7) // 8, (n + _BLOCK - 1) // _BLOCK + 1
        planes, ranks = [], []
        for _ in range(width):
            planes.append(np.frombuffer(blob, np.uint8, size, at))
            at += size
            ranks.append(np.frombuffer(blob, "<u4", entries, at))
            at += 4 * entries
        return cls(n, width, planes, ranks, zeros)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits."""
        block, plane = i // _BLOCK, self.planes[level]
        a, b = block * _BLOCK // 8, i // 8
        more = int(np.bitwise_count(plane[a:b]).sum())
        if i % 8:
            more += int(plane[b] & ((1 << i % 8) - 1)).bit_count()
        return int(self.ranks[level][block]) + more

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * _BLOCK, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], bitorder="little")[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            bit = int(self.planes[level][i // 8]) >> i % 8 & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.width):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.width - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, i: int | None = None) -> int:
        """How often the token occurs among the first i places (all of them by default)."""
        if token < 0 or token >> self.width:
            return 0
        lo, hi = self._range(token, self.n if i is None else i)
        return hi - lo

    def occurrence(self, token: int, k: int) -> int:
        """The place of the token's k-th (from 0) occurrence."""
        lo, hi = self._range(token, self.n) if 0 <= token < 1 << self.width else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens, from the lowest plane up."""
        cur = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(np.bool_)
            up = np.empty_like(cur)
            up[~one] = cur[: self.zeros[level]]
            up[one] = cur[self.zeros[level] :] | cur.dtype.type(1 << (self.width - 1 - level))
            cur = up
        return cur
