"""Compressed full-text index of word sequences: Burrows-Wheeler transform in a wavelet tree.

The index holds sequences of word numbers (from 1), each ended by a 0.  The transform is stored as
one bit vector per bit of the alphabet (a wavelet tree with its levels laid out as a matrix) with
counts every 64 bits; the longest common prefixes of neighbouring suffixes fit a byte or two.
``matching_statistics`` runs backward search over many patterns at once.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class WaveletTree:
    """Symbols of a sequence by bits, with constant-time counts per level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        words = len(symbols) // 64 + 1
        self.bits = np.zeros((self.levels, words), np.uint64)
        self.ones = np.zeros((self.levels, words + 1), np.int32)
        self.zeros = np.zeros(self.levels, np.int64)
        now = symbols
        for level in range(self.levels):
            bit = (now >> (self.levels - 1 - level)) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            raw = np.zeros(words * 8, np.uint8)
            raw[: len(packed)] = packed
            self.bits[level] = raw.view("<u8")
            np.cumsum(np.bitwise_count(self.bits[level]), out=self.ones[level, 1:])
            now = np.concatenate([now[~bit], now[bit]])
            self.zeros[level] = len(symbols) - int(self.ones[level, -1])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places reached at the lowest level from ``at``: their differences count the symbol."""
        for level in range(self.levels):
            word = at >> 6
            below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
            ones = self.ones[level].take(word) + np.bitwise_count(self.bits[level].take(word) & below)
            one = (symbol >> (self.levels - 1 - level)) & 1
            at = np.where(one, ones + self.zeros[level], at - ones)
        return at


class FMIndex:
    """Index over ``symbols``: sequences of numbers from 1 to sigma - 1, a 0 after each."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = n = len(symbols)
        place = np.arange(n)
        stops = np.flatnonzero(symbols == 0)
        left = stops[np.searchsorted(stops, place)] - place
        longest = int(left.max(initial=0))
        # Doubling: rank by 1, 2, 4, ... symbols; nothing counts beyond the 0 that ends a sequence.
        # Up to the first sort, pairs of ranks are the ranks: equal if and only if the symbols are.
        rank, ranks, step, top = symbols.astype(np.int64), [symbols.astype(np.int32)], 1, sigma
        while step <= longest:
            ahead = rank[np.minimum(place + step, n - 1)] + 1
            key = rank * (top + 1) + np.where(left >= step, ahead, 0)
            step *= 2
            if step <= longest and (top + 1) ** 4 < 1 << 62:
                rank, top = key, (top + 1) * (top + 1)
                ranks.append(key)
                continue
            order = np.argsort(key)
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            rank, top = fresh, n
            ranks.append(rank.astype(np.int32))
        if top * n < 1 << 62:
            suffixes = np.argsort(rank * n + place)
        else:
            suffixes = np.argsort(rank, kind="stable")
        self.tree = WaveletTree(symbols[suffixes - 1], sigma)
        counts = np.bincount(symbols, minlength=sigma)
        before = np.cumsum(counts) - counts
        every = np.arange(sigma)
        self.base = before - self.tree.descend(every, np.zeros(sigma, np.int64))
        self._common_prefixes(suffixes, ranks, left, longest)

    def _common_prefixes(self, suffixes: np.ndarray, ranks: list, left: np.ndarray, longest: int) -> None:
        """lcp[i] of suffixes i - 1 and i (0 at both ends), and its minima over 2^j neighbours."""
        a, b = suffixes[:-1], suffixes[1:]
        most = np.minimum(left[a], left[b])
        same = np.zeros(len(a), np.int64)
        for j in range(len(ranks) - 1, -1, -1):
            go = same + (1 << j) <= most
            x, y = np.minimum(a + same, self.n - 1), np.minimum(b + same, self.n - 1)
            same += np.where(go & (ranks[j][x] == ranks[j][y]), 1 << j, 0)
        small = np.uint8 if longest < 256 else np.int32
        lcp = np.zeros(self.n + 1, small)
        lcp[1:-1] = same
        self.minima = [lcp]
        while 1 << len(self.minima) <= self.n:
            step = 1 << len(self.minima) - 1
            low = self.minima[-1]
            self.minima.append(np.minimum(low, low[np.minimum(np.arange(self.n + 1) + step, self.n)]))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: suffixes that start with the symbol before those of [lo, hi)."""
        reached = self.tree.descend(np.r_[symbol, symbol], np.r_[lo, hi])
        base = self.base[symbol]
        return base + reached[: len(lo)], base + reached[len(lo) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next larger interval of a shorter prefix, and the length of that prefix."""
        lcp = self.minima[0]
        length = np.maximum(lcp[lo], lcp[hi]).astype(np.int64)
        lo, hi = lo.copy(), hi.copy()
        for j in range(len(self.minima) - 1, -1, -1):
            step = 1 << j
            # Down from lo while all of lcp[lo - step + 1 .. lo] reach the length.
            start = lo - step + 1
            go = (start >= 1) & (self.minima[j][np.maximum(start, 0)] >= length)
            lo -= np.where(go, step, 0)
            # Up from hi while all of lcp[hi .. hi + step - 1] reach it.
            go = (hi + step - 1 < self.n) & (self.minima[j][np.minimum(hi, self.n)] >= length)
            hi += np.where(go, step, 0)
        root = length == 0
        return np.where(root, 0, lo), np.where(root, self.n, hi), length

    def matching_statistics(self, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = 2) -> np.ndarray:
        """For every place of every pattern, the longest run from there that stands ``least`` times in the index.

        A pattern is ``patterns[start : start + length]``; all patterns go one symbol to the left
        at a time.  A run that cannot be extended is cut at its right end to the next shorter
        prefix with more occurrences.
        """
        out = np.zeros(len(patterns), np.int64)
        lo = np.zeros(len(starts), np.int64)
        hi = np.full(len(starts), self.n, np.int64)
        run = np.zeros(len(starts), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = lanes = np.flatnonzero(lengths >= back)
            at = starts + lengths - back
            # A 0 in a pattern stands in no run: the search starts anew before it.
            ended = patterns[at[lanes]] == 0
            lo[lanes[ended]], hi[lanes[ended]], run[lanes[ended]] = 0, self.n, 0
            lanes = lanes[~ended]
            while len(lanes):
                a, b = self.extend(patterns[at[lanes]], lo[lanes], hi[lanes])
                fits = b - a >= least
                done = lanes[fits]
                lo[done], hi[done] = a[fits], b[fits]
                run[done] += 1
                lanes = lanes[~fits]
                lanes = lanes[run[lanes] > 0]
                lo[lanes], hi[lanes], run[lanes] = self.parent(lo[lanes], hi[lanes])
            out[at[live]] = run[live]
        return out
