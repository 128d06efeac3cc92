"""Words of many texts at once, as arrays over their UTF-8 bytes.

A word is a longest run of bytes other than space and the controls 9 to 13.
Hashes are polynomials modulo 2^64 taken from prefix sums, then mixed.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n``."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit mixing generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


class Words:
    """Words of consecutive texts.

    ``text``: the text of each word; ``start`` and ``end``: its bytes in
    ``raw``; ``hash``: 64 bits; ``first``: of each text, its first word.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        fresh = np.zeros(len(raw) + 1, dtype=bool)
        fresh[bounds] = True  # a text's first byte opens a word whatever is before it
        inside = ~white
        opens = inside.copy()
        opens[1:] &= white[:-1] | fresh[1:-1]
        closes = inside.copy()
        closes[:-1] &= white[1:] | fresh[1:-1]
        self.raw, self.bounds = raw, bounds
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        up, down = powers(len(raw))
        prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= up[1 : len(raw) + 1]
        np.cumsum(terms, out=prefix[1:])
        self.hash = mix((prefix[self.end] - prefix[self.start]) * down[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with one space after each, and where each begins (one more entry for the end)."""
        sizes = self.end - self.start
        at = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=at[1:])
        out = np.full(int(at[-1]), 32, dtype=np.uint8)
        byte_word = np.repeat(np.arange(len(sizes)), sizes)
        source = np.arange(len(byte_word)) + np.repeat(self.start - (at[:-1] - np.arange(len(sizes))), sizes)
        out[np.arange(len(byte_word)) + byte_word] = self.raw[source]
        return out.tobytes(), at


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive word hashes (fewer entries by ``n - 1``)."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + words[k : k + size]
    return mix(out)
