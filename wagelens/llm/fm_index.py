"""FM-index over integer symbols with a wavelet matrix; searches many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector packed in 64-bit words, with counts of ones before each word."""

    def __init__(self, bits: np.ndarray):
        size = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(size, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FmIndex:
    """Of ``symbols`` (from 1; 0 ends the text and stands between its parts)."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0).astype(np.int64)
        self.order = suffix_array(text)
        turned = text[self.order - 1]  # the symbol before each suffix
        top = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])
        self.levels = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (turned >> shift) & 1
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            turned = np.concatenate([turned[bit == 0], turned[bit == 1]])
        self.origin = self._down(np.arange(top), np.zeros(top, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in [lo, hi) with ``symbol`` put in front."""
        base = self.first[symbol] - self.origin[symbol]
        return base + self._down(symbol, lo), base + self._down(symbol, hi)

    def search(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns ``symbols[s:s+length]``, by backward search.

        A pattern is given up, with an empty range, as soon as what was read of it stands in one place only.
        """
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        live = np.arange(len(starts))
        for k in range(length - 1, -1, -1):
            if not len(live):
                break
            lo[live], hi[live] = self.step(symbols[starts[live] + k], lo[live], hi[live])
            live = live[hi[live] - lo[live] >= 2]
        done = np.zeros(len(starts), bool)
        done[live] = True
        return np.where(done, lo, 0), np.where(done, hi, 0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling: ranks of the first 1, 2, 4, ... symbols until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        if n == 0 or new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2
