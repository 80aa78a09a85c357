"""A compressed FM-index over integer symbols, searched for many patterns at once.

The Burrows-Wheeler transform lies in a wavelet matrix of packed bit vectors: each level
takes one bit a symbol, and half a bit more for its counts. Searching goes backward, one
symbol of all patterns a step. The suffix order is exact to `depth` symbols, which is
what patterns of up to depth - 1 symbols need."""

from __future__ import annotations

import numpy as np


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Bits:
    """A bit vector with rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())
        self.zeros = len(bits) - self.ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = i >> 6
        word = self.words[at]
        word &= ~(_ALL << (i & 63).astype(np.uint64))
        return self.before[at] + np.bitwise_count(word)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits: list[Bits] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            now = np.concatenate([now[~bit], now[bit]])
        every = np.arange(size)
        #: where the run of each symbol begins once all levels are passed
        self.base = self._descend(every, np.zeros(size, np.int64))

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int32)
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits):
            ones = bits.rank(i)
            i = np.where(symbol >> level & 1, ones + np.int32(bits.zeros), i - ones)
        return i.astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, i) - self.base[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols (doubling); the text's end is smaller than any symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order, length = None, 1
    while length < depth:
        key = rank * (n + 2)
        key[: n - length] += rank[length:]
        order = np.argsort(key)
        of = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(of[1:] != of[:-1])]) if n else of
        length *= 2
    return np.argsort(rank) if order is None else order


class FMIndex:
    """Index of a text of symbols from 1; 0 parts its documents and occurs in no pattern."""

    def __init__(self, text: np.ndarray, depth: int = 16):
        size = int(text.max(initial=0)) + 1
        self.order = suffix_order(text, depth)
        self.bwt = WaveletMatrix(text[self.order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.depth, self.n = depth, len(text)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns with one more symbol in front."""
        return self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)

    def matching(self, stream: np.ndarray, ends: np.ndarray, most: int, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at some ends of a stream: length of the longest match that ends there (at most `most`), and its interval.

        Symbols out of the index are negative. With own the stream is the indexed text itself, and only matches elsewhere in it
        are wanted: one is given up when its interval is a single place, and counts as no longer than that."""
        if most >= self.depth:
            raise ValueError("the index is not that deep")
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        at = np.arange(len(ends))
        if own and len(ends):
            # a word that the text has once makes its windows its own: they need no search
            single = np.concatenate([[0], np.cumsum(np.diff(self.first)[stream] == 1)])
            at = at[single[ends] == single[ends - most]]
        for k in range(most):
            place = ends[at] - 1 - k
            symbol = np.where(place >= 0, stream[np.maximum(place, 0)], 0)
            fits = (symbol > 0) & (symbol < len(self.first) - 1)
            at, symbol = at[fits], symbol[fits]
            if not len(at):
                break
            # the first step's interval is all places of its symbol
            lo, hi = self.step(symbol, low[at], high[at]) if k else (self.first[symbol], self.first[symbol + 1])
            more = hi > lo
            at, lo, hi = at[more], lo[more], hi[more]
            low[at], high[at] = lo, hi
            length[at] = k + 1
            if own:
                at = at[hi - lo > 1]
        return length, low, high
