"""A wavelet matrix of token ids: one bit-plane per bit, zeros sorted before ones from plane to plane."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BLOCK = 512  # bits for which the ones before them are counted
_RUN = 1 << 16  # values parted at once, few enough for a processor's cache


def _unpacked(plane: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little").view(bool)


def _parted(bit: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, places of zeros, places of ones) of each run of bits, places from the start."""
    for start in range(0, len(bit), _RUN):
        run = bit[start:start + _RUN]
        yield start, np.flatnonzero(~run), np.flatnonzero(run)


@dataclass
class WaveletMatrix:
    """`planes[l]` holds bit `bits - 1 - l` of each value in the order of level l, `ones[l]` the ones before
    each block of 512 bits, `zeros[l]` the zeros of the plane."""

    n: int
    planes: list[bytes]
    ones: list[bytes]
    zeros: list[int]

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        values = np.ascontiguousarray(values, kind)
        planes, ones, zeros = [], [], []
        for shift in range(bits - 1, -1, -1):
            bit = (values & kind(1 << shift)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros(-(-len(packed) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
            padded[:len(packed)] = packed
            counts = np.bitwise_count(padded.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ones.append((np.cumsum(counts, dtype=np.uint32) - counts).tobytes())
            lows, highs = [values[:0]], []
            for start, low, high in _parted(bit):
                run = values[start:start + _RUN]
                lows.append(run.take(low))
                highs.append(run.take(high))
            values = np.concatenate(lows + highs)
            zeros.append(sum(map(len, lows)))
        return cls(len(values), planes, ones, zeros)

    @property
    def bits(self) -> int:
        return len(self.planes)

    def values(self) -> np.ndarray:
        """All values in their order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            above, mark = np.empty_like(out), kind(1 << (self.bits - 1 - level))
            zero, one = 0, self.zeros[level]
            for start, low, high in _parted(_unpacked(self.planes[level], self.n)):
                run = above[start:start + _RUN]
                run[low] = out[zero:zero + len(low)]
                run[high] = out[one:one + len(high)] | mark
                zero, one = zero + len(low), one + len(high)
            out = above
        return out.astype(np.uint32)

    def _bit(self, level: int, at: int) -> int:
        return self.planes[level][at >> 3] >> (at & 7) & 1

    def _rank(self, level: int, at: int) -> int:
        """Ones of a plane before `at`."""
        plane, block = self.planes[level], at // _BLOCK
        ones = np.frombuffer(self.ones[level], np.uint32)
        before = int(ones[block]) if block < len(ones) else 0
        if block >= len(ones):
            return self.n - self.zeros[level]
        rest = int.from_bytes(plane[block * _BLOCK // 8:(at + 7) >> 3], "little")
        return before + (rest & ((1 << (at - block * _BLOCK)) - 1)).bit_count()

    def _select(self, level: int, one: int, k: int) -> int:
        """Place of the k-th (from 0) one or zero of a plane, by binary search over ranks."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._rank(level, middle + 1)
            if (ones if one else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, at: int) -> int:
        """The value at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, at), self._rank(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            first, last = self._rank(level, start), self._rank(level, end)
            if value >> (self.bits - 1 - level) & 1:
                start, end = self.zeros[level] + first, self.zeros[level] + last
            else:
                start, end = start - first, end - last
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often a value occurs in values[start:end]."""
        if not 0 <= value < 1 << self.bits:
            return 0
        first, last = self._range(value, start, self.n if end is None else end)
        return last - first

    def select(self, value: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        at = self._range(value, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        """All places of a value, ascending."""
        return [self.select(value, k) for k in range(self.count(value))]
