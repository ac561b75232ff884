"""A compressed full-text index of word sequences, searched backwards for many sequences at once.

The index is the Burrows-Wheeler transform of all sequences in a wavelet matrix of packed bits with rank
directories (Claude, Navarro and Ordóñez, "The wavelet matrix", 2015), beside the lengths that neighbours in
suffix order have in common. A sequence is read from its end: a word is put before the current match, and where
the longer match isn't found often enough, the match gives up words at its end until it is (Ohlebusch, Gog and
Kügel, "Computing matching statistics and maximal exact matches on compressed full-text indexes", 2010).
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of any value in a sequence of numbers from 0 to ``most``."""

    def __init__(self, values: np.ndarray, most: int):
        self.depth = max(1, int(most).bit_length())
        self.levels = []
        values = values.astype(np.int64)
        for shift in reversed(range(self.depth)):
            bits = (values >> shift & 1).astype(bool)
            packed = np.zeros((len(values) // 64 + 1) * 8, np.uint8)
            packed[: -(-len(values) // 8)] = np.packbits(bits, bitorder="little")
            words = packed.view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((shift, words, before, int(len(bits) - bits.sum())))
            values = np.concatenate([values[~bits], values[bits]])
        # Where the values of each kind begin in the order of the last level.
        firsts = np.flatnonzero(np.diff(values, prepend=-1))
        self.first = np.zeros(int(most) + 1, np.int64)
        self.first[values[firsts]] = firsts

    def place(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``first[value]`` and the number of that value before place ``at``, added up."""
        for shift, words, before, zeros in self.levels:
            slot = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[slot] + np.bitwise_count(words[slot] & below)
            at = np.where(value >> shift & 1, zeros + ones, at - ones)
        return at


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``ids``, each 0 of which ends a sequence and is unlike any other, and what neighbours share.

    The second array has one more entry than there are suffixes: common words of suffix k - 1 and k in order, and
    -1 at both ends.
    """
    n = len(ids)
    stops = ids == 0
    rank = np.where(stops, np.cumsum(stops) - 1, int(stops.sum()) - 1 + ids.astype(np.int64))
    ranks, step = [], 1
    order = np.argsort(rank, kind="stable")
    while True:
        turns = np.concatenate([[0], np.cumsum(np.diff(rank[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = turns
        ranks.append(rank)
        if turns[-1] == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank)
        step *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(0, n - 1), np.int64)
    for depth in reversed(range(len(ranks))):
        inside = np.maximum(a, b) < n
        same = np.zeros(len(a), bool)
        same[inside] = ranks[depth][a[inside]] == ranks[depth][b[inside]]
        length = same.astype(np.int64) << depth
        a, b, shared = a + length, b + length, shared + length
    return order, np.concatenate([[-1], shared, [-1]])


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before, and after, with a smaller value; ends hold the smallest value, -1."""
    before, after = np.zeros(len(values), np.int64), np.full(len(values), len(values) - 1, np.int64)
    for v in np.unique(values[values >= 0]):
        smaller, here = np.flatnonzero(values < v), np.flatnonzero(values == v)
        slot = np.searchsorted(smaller, here)
        before[here], after[here] = smaller[slot - 1], smaller[slot]
    return before, after


class FmIndex:
    """Index of weighted word sequences: ``ids`` holds word numbers from 1 on and a 0 after each sequence."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray):
        self.ids, self.n = ids.astype(np.int64), len(ids)
        most = int(self.ids.max(initial=0))
        order, self.shared = suffix_order(self.ids)
        self.before, self.after = smaller_neighbours(self.shared)
        self.matrix = WaveletMatrix(self.ids[order - 1], most)
        counts = np.bincount(self.ids, minlength=most + 1)
        self.shift = np.concatenate([[0], np.cumsum(counts)[:-1]]) - self.matrix.first
        owner = np.cumsum(self.ids == 0) - (self.ids == 0)
        self.weight = np.concatenate([[0], np.cumsum(np.asarray(weights, np.int64)[owner[order]])])

    def extended(self, word: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with a word put before them."""
        both = self.matrix.place(np.concatenate([word, word]), np.concatenate([low, high]))
        m = len(word)
        return both[:m] + self.shift[word], both[m:] + self.shift[word]

    def matching_statistics(self, least: int) -> np.ndarray:
        """For each place, the length of the longest match that begins there and weighs at least ``least``.

        All sequences of the index are read side by side, each from its end.
        """
        stops = np.flatnonzero(self.ids == 0)
        starts = np.concatenate([[0], stops[:-1] + 1])
        longest = np.zeros(self.n, np.int64)
        low, high, length = np.zeros(len(stops), np.int64), np.full(len(stops), self.n), np.zeros(len(stops), np.int64)
        at, active = stops - 1, np.arange(len(stops))
        while True:
            active = active[at[active] >= starts[active]]
            if not len(active):
                return longest
            waiting = active
            while len(waiting):
                word = self.ids[at[waiting]]
                first, last = self.extended(word, low[waiting], high[waiting])
                found = self.weight[np.maximum(first, last)] - self.weight[first] >= least
                done = waiting[found]
                low[done], high[done] = first[found], last[found]
                length[done] += 1
                waiting = waiting[~found]
                waiting = waiting[length[waiting] > 0]
                left, right = self.shared[low[waiting]], self.shared[high[waiting]]
                edge = np.where(left >= right, low[waiting], high[waiting])
                length[waiting] = np.maximum(self.shared[edge], 0)
                whole = self.shared[edge] < 0
                low[waiting] = np.where(whole, 0, self.before[edge])
                high[waiting] = np.where(whole, self.n, self.after[edge])
            longest[at[active]] = length[active]
            at[active] -= 1
