"""An FM-index over one shard's symbols, with vectorised search of many phrases at once.

Symbols: 0 ends the text (once), 1 stands for any word of no phrase, 2 and up are words.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text ends with its only 0. Sorts by as many symbols as fit a number, then doubles, re-sorting tied suffixes only."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    depth = max(1, 62 // bits)
    padded = np.concatenate((text.astype(np.int64), np.zeros(depth, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    starts = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, at, 0))
    tied = ~starts
    tied[:-1] |= ~starts[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        held = order[slots]
        pair = rank[held] * n + rank[np.minimum(held + depth, n - 1)]
        by = np.argsort(pair, kind="stable")
        held, pair = held[by], pair[by]
        order[slots] = held
        starts = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[held] = np.maximum.accumulate(np.where(starts, slots, 0))
        tied = ~starts
        tied[:-1] |= ~starts[1:]
        slots = slots[tied]
        depth *= 2
    return order


class BitVector:
    """Packed bits with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(8 + -len(packed) % 8, np.uint8))).view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, end: np.ndarray) -> np.ndarray:
        """Ones among the first end bits."""
        word, bit = end >> 6, (end & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        last = text[order - 1]
        self.count = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))))
        self.levels: list[tuple[int, BitVector]] = []
        column = last
        for bit in range(max(1, int(text.max()).bit_length()) - 1, -1, -1):
            on = (column >> bit) & 1 == 1
            self.levels.append((bit, BitVector(on)))
            column = np.concatenate((column[~on], column[on]))
        symbols = np.arange(len(self.count) - 1)
        self.origin = self._down(np.zeros(len(symbols), np.int64), symbols)
        self.last = last
        sampled = order % sample == 0
        self.sampled = BitVector(sampled)
        self.is_sampled = sampled
        self.positions = order[sampled]

    def _down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """at, followed down the wavelet matrix to the leaf of symbol."""
        for bit, vector in self.levels:
            ones = vector.ones(at)
            at = np.where((symbol >> bit) & 1 == 1, vector.zeros + ones, at - ones)
        return at

    def step(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Suffixes that start with symbol and go on below row at."""
        return self.count[symbol] + self._down(at, symbol) - self.origin[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (one in each line, right-aligned), backward symbol by symbol."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.count[-1], np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = phrases[live, -back]
            known = symbol < len(self.origin)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self.step(low[live], symbol), self.step(high[live], symbol)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back through the text to the next sampled position."""
        at, walked, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.is_sampled[at[open_]]
            hit = open_[done]
            found[hit] = self.positions[self.sampled.ones(at[hit])] + walked[hit]
            open_ = open_[~done]
            at[open_] = self.step(at[open_], self.last[at[open_]])
            walked[open_] += 1
        return found
