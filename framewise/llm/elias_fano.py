"""Elias-Fano coding of ascending integers, with sampled select.

Each of n values below u keeps its low floor(log2(u / n)) bits as they are; the
high parts are unary gaps in a bit vector of at most 2n + 1 bits. That is about
2 + log2(u / n) bits a value, against 64 in a table of offsets. The place of
every `SAMPLE`-th set bit is stored, so any value is found by reading one block.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 512


class EliasFano:
    """An encoded ascending sequence: `EliasFano.encode(values)`, then `[i]`, `block(j)` and `values()`."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        bits[ones] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1) if low_bits else np.zeros(0)
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel()), np.packbits(bits), ones[::SAMPLE].astype("<u4" if len(bits) < 2**32 else "<u8"))

    def block(self, j: int) -> np.ndarray:
        """Values j * SAMPLE and on, SAMPLE of them or as many as there are, unsigned."""
        first = j * SAMPLE
        count = min(SAMPLE, self.n - first)
        start = int(self.samples[j])
        end = int(self.samples[j + 1]) if j + 1 < len(self.samples) else len(self.high) * 8
        found = np.flatnonzero(np.unpackbits(self.high[start // 8 : (end + 7) // 8])) + start // 8 * 8
        ones = found[found >= start][:count]
        value = (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            a, b = first * self.low_bits, (first + count) * self.low_bits
            bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8])[a % 8 : a % 8 + b - a].reshape(count, self.low_bits)
            value = value + bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return value

    def __getitem__(self, i: int) -> int:
        return int(self.block(i // SAMPLE)[i % SAMPLE])

    def values(self) -> np.ndarray:
        return np.concatenate([self.block(j) for j in range(len(self.samples))]) if self.n else np.zeros(0, np.uint64)

    def bits(self) -> int:
        """Bits that the encoded sequence takes."""
        return 8 * (self.low.nbytes + self.high.nbytes + self.samples.nbytes)
