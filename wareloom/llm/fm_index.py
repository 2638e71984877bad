"""A full-text index of one shard of word ids: suffix order, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: one running count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word, low = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank of any symbol and access, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, Bits, int]] = []
        left = symbols
        for shift in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bit = (left >> shift) & 1
            zeros = int(len(left) - bit.sum())
            self.levels.append((shift, Bits(bit.astype(np.uint8)), zeros))
            left = np.concatenate((left[bit == 0], left[bit == 1]))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first ``i`` symbols' copies of ``symbol`` end at the last level."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at ``i``, and their places at the last level."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for shift, bits, zeros in self.levels:
            bit, ones = bits.get(i), bits.rank(i)
            symbol |= bit.astype(np.int64) << shift
            i = np.where(bit, zeros + ones, i - ones)
        return symbol, i


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling; every 0 is a symbol of its own, in text order."""
    n, ends = len(text), text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order, step = np.argsort(rank, kind="stable"), 0
    while True:
        new = np.concatenate(([0], np.cumsum(np.diff(rank[order]) != 0)))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step = step * 2 or 1
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")


class FMIndex:
    """Backward search and location over runs of word ids (1 and more), each run followed by a 0."""

    def __init__(self, text: np.ndarray, largest: int, every: int = 16):
        order = suffix_order(text)
        before = text[order - 1].astype(np.int64)  # the last symbol is a 0, which nobody searches
        self.tree = WaveletMatrix(before, largest)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=largest + 1))))[: largest + 1]
        symbols = np.arange(largest + 1)
        self.base = self.tree.down(symbols, np.zeros(largest + 1, dtype=np.int64))
        starts = np.concatenate(([True], text[:-1] == 0))
        run = np.maximum.accumulate(np.where(starts, np.arange(len(text)), 0))
        sampled = ((np.arange(len(text)) - run) % every == 0)[order]
        self.marks, self.samples, self.n = Bits(sampled.astype(np.uint8)), order[sampled], len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of word ids the ranges of suffixes that begin with them; empty where low >= high."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = phrases[live, k]
            low[live] = self.first[c] + self.tree.down(c, low[live]) - self.base[c]
            high[live] = self.first[c] + self.tree.down(c, high[live]) - self.base[c]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the nearest sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(~self.marks.get(at))
        while len(walking):
            symbol, end = self.tree.access(at[walking])
            at[walking] = self.first[symbol] + end - self.base[symbol]
            steps[walking] += 1
            walking = walking[~self.marks.get(at[walking])]
        return self.samples[self.marks.rank(at)] + steps
