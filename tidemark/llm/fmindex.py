"""A compressed full-text index over words: suffixes sorted far enough for the window, their BWT in a wavelet matrix."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Bits:
    """A bit vector, eight bits a byte, with counts at each 64th position for rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=_U)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), dtype=np.uint32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def rank(self, p: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = p >> 6
        low = self.words[at] & ((_U(1) << (p & 63).astype(_U)) - _U(1))
        return self.before[at].astype(np.int64) + np.bitwise_count(low)


class WaveletMatrix:
    """Symbols of an array, a bit vector per binary digit, highest first."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.levels: list[tuple[int, Bits, int]] = []
        now = symbols
        for shift in range(max(1, (count - 1).bit_length()) - 1, -1, -1):
            bit = (now >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])
        self.start = self._walk(np.arange(count), np.zeros(count, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, p: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(p)
            p = np.where(symbol >> shift & 1, zeros + ones, p - ones)
        return p

    def rank(self, symbol: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._walk(symbol, p) - self.start[symbol]


class FMIndex:
    """Index of sequences of words for patterns up to ``window`` words.

    ``words`` are 64-bit values, ``first`` the begin of each sequence and the end of the last one. Suffixes are sorted by their
    first 32 words, which is enough for backward search with patterns of up to 31.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, window: int):
        if not 2 <= window <= 31:
            raise ValueError("a window has 2 to 31 words")
        self.window = window
        size = np.diff(first)
        known, symbol = np.unique(words, return_inverse=True)
        # a zero after each sequence; no pattern holds it
        self.begin = first[:-1] + np.arange(len(size))
        self.text = np.zeros(len(words) + len(size), dtype=np.int64)
        self.text[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = symbol + 1
        n, count = len(self.text), len(known) + 1

        def pair(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[:max(0, n - by)] = b[by:]
            return np.unique(a * (int(b.max(initial=0)) + 1) + ahead, return_inverse=True)[1]

        ranks = {1: self.text}
        for k in (1, 2, 4, 8, 16):
            ranks[2 * k] = pair(ranks[k], ranks[k], k)

        def rank_of(length: int) -> np.ndarray:
            k = 1 << (length.bit_length() - 1)
            return ranks[k] if k == length else pair(ranks[k], ranks[k], length - k)

        self.suffixes = np.argsort(ranks[32], kind="stable")
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=count))])
        self.bwt = WaveletMatrix(self.text[self.suffixes - 1], count)
        # rows whose suffixes agree in a whole window, and in one word less
        self.same = self._groups(rank_of(window))
        self.shorter = self._groups(rank_of(window - 1))

    def _groups(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row its group, and where the groups begin (with the end)."""
        r = rank[self.suffixes]
        new = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, bool)
        return np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(r))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pattern with one more word in front (a step of backward search)."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.counts[symbol], 2)
        return both[:len(low)], both[len(low):]

    def windows(self, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the indexed sequences, cut at the window.

        All sequences are read backwards side by side; each step adds a word in front, and a match that is a window long loses
        its last word before. Returns the sequence, the first word and the group of rows of each window.
        """
        n = len(self.text)
        low, high = np.zeros(len(length), np.int64), np.full(len(length), n)
        seqs, starts, groups = [], [], []
        group, edge = self.shorter
        for step in range(int(length.max(initial=0))):
            live = np.flatnonzero(length > step)
            if step >= self.window:
                g = group[low[live]]
                low[live], high[live] = edge[g], edge[g + 1]
            at = length[live] - 1 - step
            low[live], high[live] = self.extend(self.text[self.begin[live] + at], low[live], high[live])
            if step >= self.window - 1:
                seqs.append(live)
                starts.append(at)
                groups.append(self.same[0][low[live]])
        if not seqs:
            return (np.zeros(0, np.int64),) * 3
        return tuple(map(np.concatenate, (seqs, starts, groups)))
