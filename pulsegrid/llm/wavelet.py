"""A wavelet matrix over small symbols: rank and select on whole arrays of positions at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with running counts; `rank` counts ones before a position."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros((self.size // 64 + 1) * 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """One bit vector per bit of the symbols, highest first; zeros go before ones at each level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.bits = len(symbols), bits
        self.levels: list[tuple[Bits, int]] = []
        for level in reversed(range(bits)):
            ones = ((symbols >> level) & 1).astype(bool)
            self.levels.append((Bits(ones), int(self.size - np.count_nonzero(ones))))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often `symbol` stands before each position in `at` (0 .. size)."""
        low, high = np.zeros_like(at), at
        for level, (bits, zeros) in zip(reversed(range(self.bits)), self.levels):
            if symbol >> level & 1:
                low, high = zeros + bits.rank(low), zeros + bits.rank(high)
            else:
                low, high = low - bits.rank(low), high - bits.rank(high)
        return high - low

    def rank_any(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum((self.rank(s, at) for s in symbols), np.zeros_like(at))

    def select_any(self, symbols: tuple[int, ...], k: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first position p in [low, high] before which at least k of `symbols` stand, by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            enough = self.rank_any(symbols, middle) >= k[open_]
            high[open_] = np.where(enough, middle, high[open_])
            low[open_] = np.where(enough, low[open_], middle + 1)
        return low
