"""Elias-Fano coding of a rising sequence of integers, with select.

Of n values below u, the low l = floor(log2(u / n)) bits are stored as they are and the high bits in unary, at most
n + u / 2**l of them: about 2 + log2(u / n) bits a value in all. A sample of the positions of the ones, 32 bits for
each ``STEP`` values, lets select jump near its one and count the rest byte by byte.
"""

from __future__ import annotations

import numpy as np

STEP = 256


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, sample: bytes) -> None:
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = b""
        if low_bits:
            bits = values[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.sample, "<u4", 1, 4 * (i // STEP))[0])
        left, byte = i % STEP, at >> 3
        held = self.high[byte] >> (at & 7) << (at & 7)
        while (ones := held.bit_count()) <= left:
            left -= ones
            byte += 1
            held = self.high[byte]
        for _ in range(left):
            held &= held - 1
        one = 8 * byte + (held & -held).bit_length() - 1
        start = i * self.low_bits
        end = start + self.low_bits
        low = int.from_bytes(self.low[start >> 3 : (end + 7) >> 3], "little") >> (start & 7) & ((1 << self.low_bits) - 1)
        return (one - i) << self.low_bits | low

    def select_all(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            values += bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return values

    def n_bytes(self) -> int:
        return len(self.low) + len(self.high) + len(self.sample)
