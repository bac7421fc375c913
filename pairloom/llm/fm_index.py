"""An FM-index over a sequence of small integers, in numpy (Ferragina and Manzini, 2000),
with a wavelet matrix for rank ("The Wavelet Matrix", 2015). All queries take arrays.
"""

from __future__ import annotations

import numpy as np

#: Every so many text positions one suffix-array entry is kept.
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. ``text`` must end with a symbol smaller than all others."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[order] = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        rank = fresh
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, values: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bits = (values >> shift) & 1
            self.levels.append((shift, Bits(bits), int(len(values) - bits.sum())))
            values = np.r_[values[bits == 0], values[bits == 1]]

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """For each array of places: how often the symbol stands before them."""
        at = [np.zeros(len(symbol), np.int64), *places]
        for shift, bits, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            at = [np.where(one, zeros + r, p - r) for p in at for r in (bits.rank(p),)]
        return [p - at[0] for p in at[1:]]

    def access(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, r = bits.get(i), bits.rank(i)
            value |= one.astype(np.int64) << shift
            i = np.where(one, zeros + r, i - r)
        return value


class FMIndex:
    """``text`` holds symbols 1 to ``symbols - 1`` and separators 0, which no pattern has."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.r_[text, -1].astype(np.int64) + 1  # the end is smaller than a separator
        self.symbols = symbols + 1
        order = suffix_array(text)
        bwt = text[order - 1]
        counts = np.bincount(text, minlength=self.symbols)
        self.first = np.r_[0, np.cumsum(counts)]
        self.tree = WaveletMatrix(bwt, self.symbols)
        sampled = order % SAMPLE == 0
        self.marked = Bits(sampled)
        self.samples = order[sampled]
        self.size = len(text)

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a matrix with one pattern per row: (row, text position) of every occurrence."""
        rows = np.arange(len(patterns))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.size, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[rows, column].astype(np.int64) + 1
            low, high = (self.first[symbol] + r for r in self.tree.rank(symbol, low, high))
            alive = low < high
            rows, low, high = rows[alive], low[alive], high[alive]
        size = high - low
        start = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) if len(size) else np.zeros(0, np.int64)
        return np.repeat(rows, size), self.locate(start + np.arange(len(start)))

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The text positions of suffix-array rows: walk back to the next sampled one."""
        found = np.zeros(len(row), np.int64)
        left = np.arange(len(row))
        steps = 0
        while len(left):
            done = self.marked.get(row)
            found[left[done]] = self.samples[self.marked.rank(row[done])] + steps
            left, row = left[~done], row[~done]
            symbol = self.tree.access(row)
            row = self.first[symbol] + self.tree.rank(symbol, row)[0]
            steps += 1
        return found
