"""Elias-Fano coding of a monotone sequence, with select."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"EFB1"
#: Every how many elements the place of the upper bit is noted.
SAMPLE = 64
_HEAD = struct.Struct("<4sIQBI")


def encode(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing sequence of non-negative integers.

    Per element floor(log2(last / n)) low bits are packed, the rest is a unary bit vector of n ones
    and last >> low zeros: at most 2 + ceil(log2(last / n)) bits an element, plus the samples.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    last = int(values[-1]) if n else 0
    low = max(0, (last // n).bit_length() - 1) if n else 0
    upper = np.zeros(n + (last >> low) + 1, np.uint8)
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper[places] = 1
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    samples = places[::SAMPLE].astype("<u4")
    head = _HEAD.pack(MAGIC, n, last, low, len(upper))
    return head + samples.tobytes() + np.packbits(upper, bitorder="little").tobytes() + np.packbits(bits.ravel(), bitorder="little").tobytes()


class Reader:
    """Random and bulk access to an encoded sequence."""

    def __init__(self, data: bytes):
        magic, self.n, self.last, self.low, self.upper_bits = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano block")
        at = _HEAD.size
        count = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", count, at)
        at += 4 * count
        size = -(-self.upper_bits // 8)
        self.upper = np.frombuffer(data, np.uint8, size, at)
        at += size
        self.lower = np.frombuffer(data, np.uint8, -(-self.n * self.low // 8), at)
        self.size = at + len(self.lower)

    def select(self, i: int) -> int:
        """The i-th element: from the sample before it, over at most a few bytes of the bit vector."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        word = int(self.upper[byte]) >> (place & 7) << (place & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.upper[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return ((place - i) << self.low) | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        first = i * self.low
        part = self.lower[first >> 3:(first + self.low + 7) >> 3].tobytes()
        return (int.from_bytes(part, "little") >> (first & 7)) & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        bits = np.unpackbits(self.upper, bitorder="little", count=self.upper_bits)
        high = (np.flatnonzero(bits) - np.arange(self.n)).astype(np.uint64)
        if not self.low:
            return high.astype(np.int64)
        lows = np.unpackbits(self.lower, bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
        low = (lows.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return ((high << np.uint64(self.low)) | low).astype(np.int64)
