"""Elias-Fano sequences: monotone whole numbers in about 2 + log2(universe / n) bits each.

The low bits of every value stand side by side; the high parts are a bit vector with a one
per value and a zero per step. The number of ones before every block of the vector is
kept, so that access and search take many queries at once with array operations, however
unevenly ones and zeros lie. All parts are flat arrays and can be memory-mapped.
"""

from __future__ import annotations

import numpy as np

#: Words of 64 bits in a block of the bit vector.
_BLOCK = 4


def _select(bits: np.ndarray, before: np.ndarray, rank: np.ndarray, ones: bool) -> np.ndarray:
    """Position of the one (or zero) with the given number, from 0; ``before`` counts those before each block."""
    block = np.searchsorted(before, rank, side="right") - 1
    left = rank - before[block]
    word = block * _BLOCK
    value = bits[word] if ones else ~bits[word]
    count = np.bitwise_count(value).astype(np.int64)
    live = np.flatnonzero(count <= left)
    while len(live):
        left[live] -= count[live]
        word[live] += 1
        value[live] = bits[word[live]] if ones else ~bits[word[live]]
        count[live] = np.bitwise_count(value[live])
        live = live[count[live] <= left[live]]
    place = np.zeros(len(rank), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(value & np.uint64((1 << width) - 1)).astype(np.int64)
        up = low <= left
        left -= np.where(up, low, 0)
        place += np.where(up, width, 0)
        value = np.where(up, value >> np.uint64(width), value)
    return word * 64 + place


class EliasFano:
    """A sorted sequence; ``parts`` are its arrays, as ``build`` makes them."""

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.n, self.low_bits, self.steps = (int(x) for x in parts["shape"])
        self.low, self.high = parts["low"], parts["high"]
        self.ones = parts["ones"].astype(np.int64)
        self.zeros = np.arange(len(self.ones)) * (64 * _BLOCK) - self.ones

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        steps = (int(universe) >> bits) + 1
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            rest = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, rest << shift)
            over = np.flatnonzero(shift + np.uint64(bits) > 64)
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
        one = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        total = n + steps + 1
        flags = np.zeros((total // (64 * _BLOCK) + 1) * 64 * _BLOCK, np.uint8)
        flags[one] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).reshape(-1, _BLOCK).sum(1)
        ones = np.cumsum(count) - count
        return {"shape": np.array([n, bits, steps], np.int64), "low": low, "high": high, "ones": ones.astype(np.uint32)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        over = np.flatnonzero(shift + np.uint64(self.low_bits) > 64)
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return value & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        high = _select(self.high, self.ones, i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1 where it is none of the sequence."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        rest = values & np.uint64((1 << self.low_bits) - 1)
        inside = np.flatnonzero(high < self.steps)
        high, rest = high[inside], rest[inside]
        # Values of one high part stand between two zeros.
        lo = np.zeros(len(high), np.int64)
        some = high > 0
        lo[some] = _select(self.high, self.zeros, high[some] - 1, False) + 1 - high[some]
        hi = _select(self.high, self.zeros, high, False) - high
        live = np.flatnonzero(lo < hi)
        end = hi.copy()
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < rest[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        hit = np.flatnonzero(lo < end)
        hit = hit[self._low(lo[hit]) == rest[hit]]
        out[inside[hit]] = lo[hit]
        return out
