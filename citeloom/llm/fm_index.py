"""A compressed FM-index over word sequences: BWT in a wavelet tree, vectorised backward search.

The index keeps the wavelet tree, the counts of smaller symbols and the places in suffix order where a new class of
equal first symbols begins (for parent intervals).  Suffix order and ranks only exist while it is built.
The tree is stored by levels (a wavelet matrix): one packed bit vector per bit of the symbol, each with a running count
every 64 bits, so a rank is one lookup and one population count.  All functions work on arrays of positions at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.ones = int(counts.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletTree:
    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (now >> level & 1).astype(bool)
            self.levels.append(BitVector(bits))
            self.zeros.append(len(now) - self.levels[-1].ones)
            now = np.concatenate((now[~bits], now[bits]))
        # Where each symbol's run starts on the last level.
        self.start = np.full(sigma, 0, np.int64)
        if len(now):
            first = np.flatnonzero(np.concatenate(([True], now[1:] != now[:-1])))
            self.start[now[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        p = at
        last = len(self.levels) - 1
        for i, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = bits.rank1(p)
            p = np.where(symbol >> (last - i) & 1, zeros + ones, p - ones)
        return p - self.start[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling.

    Symbol 0 separates texts; each 0 counts as a symbol of its own, smaller than all others, so that no common prefix
    crosses one and suffixes differ within the longest text.
    """
    n = len(text)
    gaps = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(gaps)
    rank[gaps] = np.arange(len(gaps))
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-width] = rank[width:] + 1 if width < n else 0
        key = rank * (int(ahead.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
        width *= 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


def class_starts(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix, in order, differs from the one before within the first ``depth`` symbols."""
    new = np.ones(len(order), bool)
    same = np.arange(1, len(order))
    for k in range(depth):
        symbol = text[order[same] + k]  # a 0 ends every text, and no suffix is followed beyond it
        same = same[(symbol != 0) & (symbol == text[order[same - 1] + k])]
    new[same] = False
    return new


class FmIndex:
    """Index of texts over symbols 1 .. sigma-1, each text followed by a 0; ``depth``: that of parent intervals."""

    def __init__(self, text: np.ndarray, order: np.ndarray, sigma: int, depth: int) -> None:
        self.tree = WaveletTree(text[order - 1], sigma)  # the last text's 0 stands before the first suffix
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))[:-1]))
        new = class_starts(text, order, depth)
        self.classes = BitVector(new)
        self.starts = np.append(np.flatnonzero(new), len(order))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``symbol`` put before them; empty where low == high."""
        base = self.first[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def widen(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parent intervals: all suffixes that share the first ``depth`` symbols with the one at ``low``."""
        group = self.classes.rank1(low + 1) - 1
        return self.starts[group], self.starts[group + 1]


def window_minima(texts: list[np.ndarray], values: np.ndarray, sigma: int, width: int) -> list[np.ndarray]:
    """For each window of ``width`` symbols of each text, the least value of the texts that hold the same window.

    Matching statistics cut at ``width``: every text streams backwards through the index of all.  After ``width``
    backward steps its interval is that of its last window; for each window before, the interval is widened to the
    suffixes that share ``width - 1`` symbols (the parent at that depth) and one more backward step is taken.  The
    intervals of windows are disjoint or equal, so each one's least value is read once.
    """
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts])
    text = np.concatenate([x for t in texts for x in (t, [0])]).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    order = suffix_order(text)
    owned = values[np.repeat(np.arange(len(texts)), lengths + 1)][order]
    index = FmIndex(text, order, sigma, width - 1)
    del order
    flat_at = np.concatenate(([0], np.cumsum(np.maximum(lengths - width + 1, 0))))
    found_low, found_high = np.zeros(int(flat_at[-1]), np.int64), np.zeros(int(flat_at[-1]), np.int64)
    live = np.flatnonzero(lengths >= width)
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(text), np.int64)
    for step in range(int(lengths.max())):
        more = lengths[live] > step
        live, low, high = live[more], low[more], high[more]
        at = lengths[live] - 1 - step
        if step >= width:
            low, high = index.widen(low)
        low, high = index.extend(text[starts[live] + at], low, high)
        if step >= width - 1:
            found_low[flat_at[live] + at], found_high[flat_at[live] + at] = low, high
    if not len(found_low):
        return [np.zeros(0, np.int64) for _ in texts]
    firsts, first_at, where = np.unique(found_low, return_index=True, return_inverse=True)
    edges = np.stack((firsts, found_high[first_at]), axis=1).ravel()
    least = np.minimum.reduceat(np.append(owned, owned[-1]), edges)[::2][where]
    return [least[flat_at[i] : flat_at[i + 1]] for i in range(len(texts))]
