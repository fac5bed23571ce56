"""Elias-Fano lists: increasing numbers in about two bits each plus the bits of their mean distance.

A list of n numbers, the largest u, is split into l = log2(u / n) low bits a number, stored side by
side, and high parts, stored as a bit vector in which the i-th number sets bit (high part + i).
``select`` finds one number by counting ones; nothing else is decoded.
"""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Low width, low bits and high bits of an increasing list of numbers."""
    n = len(values)
    if not n:
        return 0, b"", b""
    v = np.asarray(values, np.int64)
    width = max(0, (int(v[-1]) // n).bit_length() - 1)
    high = np.zeros((int(v[-1]) >> width) + n, bool)
    high[(v >> width) + np.arange(n)] = True
    low = ((v[:, None] >> np.arange(width)) & 1).astype(bool) if width else np.zeros(0, bool)
    return width, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


class EliasFano:
    """Reads an encoded list without decoding it as a whole."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes):
        self.n, self.width, self.low, self.high = n, width, low, np.frombuffer(high, np.uint8)
        self.ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)

    def select(self, i: int) -> int:
        """The i-th number, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte = int(np.searchsorted(self.ones, i + 1))
        left = i - (int(self.ones[byte - 1]) if byte else 0)
        bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1  # forget the lowest one
        place = 8 * byte + (bits & -bits).bit_length() - 1
        at, shift = divmod(i * self.width, 8)
        part = int.from_bytes(self.low[at : at + 9], "little") >> shift & ((1 << self.width) - 1)
        return (place - i) << self.width | part
