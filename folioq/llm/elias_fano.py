"""Elias-Fano lists of strictly rising numbers, with vectorised access and search."""

from __future__ import annotations

import numpy as np

_BYTE = np.array([[i for i in range(8) if byte >> i & 1] + [0] * (8 - bin(byte).count("1")) for byte in range(256)], np.uint8)
MAX_LOW = 56


class EliasFano:
    """High bits as unary gaps, low bits packed: about 2 + log2(universe / n) bits a number."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, before: np.ndarray):
        self.n, self.low_bits, self.high, self.low, self.before = n, low_bits, high, low, before
        self.zeros_before = (np.arange(len(before), dtype=np.int64) << 6) - before
        self.fields = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,)) if len(low) else low
        self.mask = np.uint64((1 << low_bits) - 1)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        low_bits = min(MAX_LOW, max(0, (universe // max(1, n)).bit_length() - 1))
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        width = (int(high[-1]) if n else 0) + 2
        words = np.zeros((width + 63) // 64 + 1, np.uint64)
        np.bitwise_or.at(words, high >> 6, np.uint64(1) << (high & 63).astype(np.uint64))
        words[-1] = 0
        low = np.zeros(8, np.uint8)
        if low_bits and n:
            parts = []
            for at in range(0, n, 1 << 18):  # 2^18 fields end on a whole byte
                field = np.ascontiguousarray(values[at : at + (1 << 18)] & np.uint64((1 << low_bits) - 1)).view(np.uint8).reshape(-1, 8)
                parts.append(np.packbits(np.unpackbits(field, axis=1, bitorder="little")[:, :low_bits].ravel(), bitorder="little"))
            low = np.concatenate((*parts, np.zeros(8, np.uint8)))
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        return {"shape": np.array([n, low_bits], np.int64), "high": words, "low": low, "before": before}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
        n, low_bits = arrays[f"{prefix}shape"].tolist()
        return cls(n, low_bits, *(arrays[f"{prefix}{k}"] for k in ("high", "low", "before")))

    def _select(self, words: np.ndarray, inside: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Position of the set bit number rank inside each word."""
        octets = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
        ends = np.cumsum(np.bitwise_count(octets), axis=1, dtype=np.int64)
        octet = (ends <= rank[:, None]).sum(axis=1)
        line = np.arange(len(words))
        left = rank - np.where(octet > 0, ends[line, np.maximum(octet - 1, 0)], 0)
        return (inside << 6) + octet * 8 + _BYTE[octets[line, octet], left]

    def access(self, at: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, at, side="right") - 1
        place = self._select(self.high[word], word, at - self.before[word])
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        return (self.fields[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have fewer high bits than high: where the gap number high - 1 ends."""
        out = np.zeros(len(high), np.int64)
        gap = high - 1
        some = np.flatnonzero((gap >= 0) & (gap < self.zeros_before[-1]))
        out[gap >= self.zeros_before[-1]] = self.n
        word = np.searchsorted(self.zeros_before, gap[some], side="right") - 1
        place = self._select(~self.high[word], word, gap[some] - self.zeros_before[word])
        out[some] = np.minimum(self.n, place - gap[some])
        return out

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first number not below each value: n if there is none."""
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low, goal = self._below(high), values & self.mask
        end = self._below(high + 1)
        while True:
            open_ = np.flatnonzero(low < end)
            if not len(open_):
                return low
            middle = (low[open_] + end[open_]) >> 1
            less = self._low(middle) < goal[open_]
            low[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it isn't in the list."""
        at = self.successor(values)
        inside = np.flatnonzero(at < self.n)
        out = np.full(len(values), -1, np.int64)
        same = self.access(at[inside]) == values[inside]
        out[inside[same]] = at[inside[same]]
        return out
