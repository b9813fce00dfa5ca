"""Elias-Fano coded increasing sequences in flat memory, searched many keys at a time."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each in 64-bit words, with a word to spare."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << bit)
        over = bit + np.uint64(width) > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - bit[over]))
    return out


#: By eight bits of a byte and three of k: place of the byte's k-th one.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.uint8)


def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in 64-bit words."""
    place = np.zeros(len(word), np.uint64)
    for half in (32, 16, 8):
        ones = np.bitwise_count((word >> place) & np.uint64((1 << half) - 1))
        up = k >= ones
        k = k - ones * up
        place += up * np.uint64(half)
    byte = ((word >> place) & np.uint64(255)).astype(np.int64)
    return place.astype(np.int64) + _IN_BYTE[byte << 3 | k & 7]


class EliasFano:
    """n increasing 64-bit keys below a universe: their low bits packed, their high bits as monotone pointers in unary (a one a
    key, a zero after each value of the high bits), with counts of zeros by word to find a pointer."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def build(cls, keys: np.ndarray, universe: int) -> EliasFano:
        n = len(keys)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = _pack(keys & np.uint64((1 << width) - 1), width)
        top = (keys >> np.uint64(width)).astype(np.int64)
        size = n + (max(universe - 1, 0) >> width) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        per_word = 64 - np.bitwise_count(high).astype(np.int64)
        return cls(n, width, low, high, (np.cumsum(per_word) - per_word).astype(np.uint32))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]

    def _after_zero(self, k: np.ndarray) -> np.ndarray:
        """Keys whose high bits are k or less."""
        word = np.searchsorted(self.zeros, k.astype(np.uint32), side="right") - 1
        place = _in_word(~self.high[word], k - self.zeros[word])
        return word * 64 + place - k

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> bit
        value |= (self.low[word + 1] << _ONE) << (np.uint64(63) - bit)  # nothing where bit is 0
        return value & np.uint64((1 << self.width) - 1)

    def _between(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first key with high bits `top` and of the first with more: after the zeros before and behind them. The
        second zero is mostly in the first one's word."""
        k = np.maximum(top - 1, 0)
        word = np.searchsorted(self.zeros, k.astype(np.uint32), side="right") - 1
        empty = ~self.high[word]
        place = _in_word(empty, k - self.zeros[word])
        lo = word * 64 + place - k
        # The zeros above the first one; where there is none before, that one is meant itself.
        above = empty & (~np.uint64(1) << place.astype(np.uint64))
        hi = word * 64 + np.bitwise_count(~above & (above - _ONE)) - top
        none = np.flatnonzero(top == 0)
        hi[none], lo[none] = lo[none], 0
        far = np.flatnonzero((above == 0) & (top > 0))
        hi[far] = self._after_zero(top[far])
        return lo, hi

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first key that is as great, or n: the pointers of the key's high bits bound it, and a search of the low
        bits between them finds it."""
        return self._search(keys)[0]

    def _search(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(successors, places of the first keys with greater high bits)."""
        low = keys & np.uint64((1 << self.width) - 1)
        lo, end = self._between((keys >> np.uint64(self.width)).astype(np.int64))
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self._low(mid) < low[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return lo, end

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 where a key isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if self.n:
            at, end = self._search(keys)
            inside = np.flatnonzero(at < end)
            held = inside[self._low(at[inside]) == keys[inside] & np.uint64((1 << self.width) - 1)]
            out[held] = at[held]
        return out
