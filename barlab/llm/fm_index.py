"""A full-text index of integer symbols: suffix order, Burrows-Wheeler transform held in
a wavelet matrix, and sampled suffix positions. All queries take arrays of ranges."""

from __future__ import annotations

import numpy as np


class RankBits:
    """Bits with constant-time rank: packed words, and the count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = []
        for level in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bits = (values >> level) & 1
            self.levels.append((level, RankBits(bits), int(len(bits) - bits.sum())))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where boundary i stands among the last level's copies of ``symbol``; the
        difference of two such places counts the symbol between the boundaries."""
        for level, bits, zeros in self.levels:
            ones = bits.rank1(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for level, bits, zeros in self.levels:
            one, ones = bits.get(i).astype(bool), bits.rank1(i)
            out |= one.astype(np.int64) << level
            i = np.where(one, zeros + ones, i - ones)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling: ranks of prefixes of length 1, 2, 4, ... until all differ."""
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            return order


class FMIndex:
    """Index of ``text`` (integers from 1 to n_symbols - 1; 0 may stand between runs)."""

    def __init__(self, text: np.ndarray, n_symbols: int, every: int = 8):
        text = np.concatenate([text.astype(np.int64) + 1, [0]])  # 0: the end, smallest
        order = suffix_order(text)
        self.n_symbols = n_symbols + 1
        self.bwt = WaveletMatrix(text[order - 1], self.n_symbols)
        counts = np.bincount(text, minlength=self.n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.origin = self.bwt.descend(np.arange(self.n_symbols), np.zeros(self.n_symbols, np.int64))
        sampled = (order % every == 0).astype(np.uint8)
        self.sampled, self.samples = RankBits(sampled), order[sampled == 1]

    def _back(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.bwt.descend(symbol, i) - self.origin[symbol]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long phrases (one a row): rows [low, high) of each."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.first[-1])
        for j in reversed(range(phrases.shape[1])):
            symbol = phrases[:, j].astype(np.int64) + 1
            low, high = self._back(symbol, low), self._back(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: step back to a sampled one."""
        rows, found = rows.copy(), np.full(len(rows), -1, np.int64)
        left, steps = np.arange(len(rows)), 0
        while len(left):
            hit = self.sampled.get(rows[left]).astype(bool)
            found[left[hit]] = self.samples[self.sampled.rank1(rows[left[hit]])] + steps
            left, steps = left[~hit], steps + 1
            rows[left] = self._back(self.bwt.symbol(rows[left]), rows[left])
        return found
