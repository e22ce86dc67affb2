"""Wavelet matrix: a token sequence as bit planes with rank and select.

Plane l holds bit l (from the top) of the tokens in the order in which the
planes above have stably put zeros before ones. Counts of ones before every
BLOCK bits give rank by one partial population count; select is a binary
search over rank.

Defined cases: an empty sequence has one plane and no tokens; a token beyond the
planes' bits occurs 0 times; positions out of range raise IndexError, bytes of
another format ValueError.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 4096
_MAGIC = b"GLWM1\0\0\0"


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        """planes: packed bits; zeros: number of zero bits of each plane; ones: ones before each block."""
        self.n, self.planes, self.zeros, self.ones = n, planes, zeros, ones

    @classmethod
    def build(cls, tokens: np.ndarray) -> WaveletMatrix:
        n = len(tokens)
        depth = max(1, int(tokens.max()).bit_length()) if n else 1
        planes, zeros, ones = [], [], []
        for level in range(depth - 1, -1, -1):
            bit = (tokens >> tokens.dtype.type(level)) & tokens.dtype.type(1) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            ones.append(cls._directory(packed))
            zeros.append(n - int(np.count_nonzero(bit)))
            tokens = np.concatenate([np.compress(~bit, tokens), np.compress(bit, tokens)])  # half the time of indexing by a mask
        return cls(n, planes, zeros, ones)

    @staticmethod
    def _directory(packed: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        full = len(packed) // step
        counts = np.bitwise_count(packed[: full * step].reshape(full, step)).sum(1, dtype=np.uint64) if full else np.zeros(0, np.uint64)
        return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64)

    def to_bytes(self) -> bytes:
        head = _MAGIC + struct.pack("<QQ", self.n, len(self.planes)) + np.array(self.zeros, "<u8").tobytes()
        return head + b"".join(d.astype("<u8").tobytes() for d in self.ones) + b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def from_bytes(cls, raw) -> WaveletMatrix:
        view = memoryview(raw).cast("B")
        if bytes(view[:8]) != _MAGIC:
            raise ValueError("not a wavelet matrix")
        n, depth = struct.unpack("<QQ", view[8:24])
        zeros = np.frombuffer(view, "<u8", depth, 24).tolist()
        size, blocks, at = (n + 7) // 8, (n + 7) // 8 // (BLOCK // 8) + 1, 24 + 8 * depth
        ones = [np.frombuffer(view, "<u8", blocks, at + 8 * blocks * k) for k in range(depth)]
        at += 8 * blocks * depth
        planes = [np.frombuffer(view, np.uint8, size, at + size * k) for k in range(depth)]
        return cls(n, planes, zeros, ones)

    def tokens(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level, (packed, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = np.unpackbits(packed, count=self.n).view(bool)
            before = np.empty_like(out)
            before[np.flatnonzero(~bit)] = out[:zeros]
            before[np.flatnonzero(bit)] = out[zeros:] | kind(1 << level)
            out = before
        return out.astype(np.uint32)

    def rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, packed = i // BLOCK, self.planes[plane]
        start, whole = block * (BLOCK // 8), i // 8
        count = int(self.ones[plane][block]) + int(np.bitwise_count(packed[start:whole]).sum(dtype=np.int64))
        return count + (int(packed[whole] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane, zeros in enumerate(self.zeros):
            bit = self.planes[plane][i // 8] >> (7 - i % 8) & 1
            ones = self.rank1(plane, i)
            i = zeros + ones if bit else i - ones
            value = 2 * value + int(bit)
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi, depth = 0, i, len(self.planes)
        if token >> depth:
            return 0, 0
        for plane, zeros in enumerate(self.zeros):
            a, b = self.rank1(plane, lo), self.rank1(plane, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (depth - 1 - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences of a token among the first i."""
        lo, hi = self._range(token, self.n if i is None else i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for plane in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - plane) & 1
            want = at - self.zeros[plane] if one else at
            a, b = 0, self.n  # the least position with want + 1 such bits up to it
            while a < b:
                m = (a + b) // 2
                ones = self.rank1(plane, m + 1)
                if (ones if one else m + 1 - ones) > want:
                    b = m
                else:
                    a = m + 1
            at = a
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of a token, upwards: its range in the last plane, led back plane by plane."""
        lo, hi = self._range(token, self.n)
        at, depth = np.arange(lo, hi), len(self.planes)
        for plane in range(depth - 1, -1, -1):
            bit = np.unpackbits(self.planes[plane], count=self.n).view(bool)
            one = token >> (depth - 1 - plane) & 1
            at = np.flatnonzero(bit)[at - self.zeros[plane]] if one else np.flatnonzero(~bit)[at]
        return at
