"""Elias-Fano sequences: monotone numbers in about two bits and a half beyond their low bits, read in place.

A number's low bits are stored as they are; its high bits are the count of
zeros before its one in a bit vector.  The place of every 64th one and zero is
kept, so reads and searches touch a few words.  All reads take arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_SAMPLE = 64
#: Steps along numbers of one upper part before halving, and numbers asked at once.
_STEPS, _AT_ONCE = 4, 1 << 15
_U = np.uint64


def _set_bits(places: np.ndarray, size: int) -> np.ndarray:
    """Words with ones at the given places."""
    bits = np.zeros((size + 63) // 64 * 64, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits one after another, and a word to read past the end."""
    out = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * _U(width)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        np.bitwise_or.at(out, word, values << shift)
        cut = shift + _U(width) > _U(64)
        np.bitwise_or.at(out, word[cut] + 1, values[cut] >> (_U(64) - shift[cut]))
    return out


def _nth_bit(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the nth (from 0) one of each word, by halves."""
    place = np.zeros(len(word), np.uint64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & _U((1 << width) - 1)
        ones = np.bitwise_count(low).astype(np.uint64)
        up = n >= ones
        n = np.where(up, n - ones, n)
        word = np.where(up, word >> _U(width), low)
        place += np.where(up, _U(width), _U(0))
    return place


class EliasFano:
    """``n`` monotone numbers below 2^64."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        low = _pack_low(values & _U((1 << width) - 1), width)
        upper = (values >> _U(width)).astype(np.int64)
        size = n + (top >> width) + 1
        places = upper + np.arange(n)
        high = _set_bits(places, size)
        free = np.ones(size, bool)
        free[places] = False
        return cls(n, width, low, high, places[::_SAMPLE].astype(np.uint64), np.flatnonzero(free)[::_SAMPLE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        parts = [self.low, self.high, self.ones, self.zeros]
        return np.array([self.n, self.width, *map(len, parts)], np.uint64).tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def view(cls, buffer: memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """A sequence read in place from ``buffer``, and where it ends."""
        n, width, *sizes = (int(x) for x in np.frombuffer(buffer, np.uint64, 6, at))
        at += 48
        parts = []
        for size in sizes:
            parts.append(np.frombuffer(buffer, np.uint64, size, at))
            at += 8 * size
        return cls(n, width, *parts), at

    def _select(self, rank: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the ones (or, flipped, zeros) of these ranks."""
        flipped = _U((1 << 64) - 1 if flip else 0)
        start = (self.zeros if flip else self.ones)[rank // _SAMPLE]
        left = (rank % _SAMPLE).astype(np.uint64)
        at = (start >> _U(6)).astype(np.int64)
        word = (self.high[at] ^ flipped) & ~((_U(1) << (start & _U(63))) - _U(1))
        while True:
            ones = np.bitwise_count(word).astype(np.uint64)
            on = np.flatnonzero(left >= ones)
            if not len(on):
                return (at.astype(np.uint64) << _U(6)) + _nth_bit(word, left)
            left[on] -= ones[on]
            at[on] += 1
            word[on] = self.high[at[on]] ^ flipped

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.uint64)
        at = index.astype(np.uint64) * _U(self.width)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        both = self.low[word] >> shift | np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return both & _U((1 << self.width) - 1)

    def __len__(self) -> int:
        return self.n

    def _bit(self, at: np.ndarray) -> np.ndarray:
        return (self.high[at >> 6] >> (at & 63).astype(np.uint64) & _U(1)).astype(bool)

    def _access(self, index: np.ndarray) -> np.ndarray:
        upper = self._select(index, False) - index.astype(np.uint64)
        return upper << _U(self.width) | self._low(index)

    def access(self, index: np.ndarray) -> np.ndarray:
        return _blocks(self._access, index, np.uint64)

    def _successor(self, values: np.ndarray) -> np.ndarray:
        upper = (values >> _U(self.width)).astype(np.int64)
        first = np.zeros(len(upper), np.int64)
        after = np.flatnonzero(upper > 0)
        first[after] = self._select(upper[after] - 1, True).astype(np.int64) - (upper[after] - 1)
        low = values & _U((1 << self.width) - 1)
        # Numbers of one upper part are few as a rule: a few steps, and by halves where there are more.
        on = np.arange(len(values))
        for _ in range(_STEPS):
            on = on[self._bit(first[on] + upper[on])]
            on = on[self._low(first[on]) < low[on]]
            if not len(on):
                return first
            first[on] += 1
        end = self._select(upper[on], True).astype(np.int64) - upper[on]
        while len(open_ := np.flatnonzero(first[on] < end)):
            middle = (first[on[open_]] + end[open_]) // 2
            below = self._low(middle) < low[on[open_]]
            first[on[open_[below]]] = middle[below] + 1
            end[open_[~below]] = middle[~below]
        return first

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the least number that is not below each value; ``n`` where there is none."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), self.n, np.int64)
        inside = self._inside(values)
        out[inside] = _blocks(self._successor, values[inside], np.int64)
        return out

    def _inside(self, values: np.ndarray) -> np.ndarray:
        return np.flatnonzero(values <= self.access(np.array([self.n - 1]))[0]) if self.n else np.zeros(0, np.int64)

    def _find(self, values: np.ndarray) -> np.ndarray:
        at = self._successor(values)
        same = np.flatnonzero(self._bit(at + (values >> _U(self.width)).astype(np.int64)))
        same = same[self._low(at[same]) == values[same] & _U((1 << self.width) - 1)]
        out = np.full(len(at), -1, np.int64)
        out[same] = at[same]
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value; -1 where it is not among the numbers."""
        values = np.asarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        inside = self._inside(values)
        out[inside] = _blocks(self._find, values[inside], np.int64)
        return out


def _blocks(read: Callable[[np.ndarray], np.ndarray], asked: np.ndarray, kind: type) -> np.ndarray:
    """``read`` by stretches whose intermediate arrays stay in the processor's cache."""
    out = np.empty(len(asked), kind)
    for x in range(0, len(asked), _AT_ONCE):
        out[x : x + _AT_ONCE] = read(asked[x : x + _AT_ONCE])
    return out
