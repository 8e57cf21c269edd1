"""Word and window hashes in numpy, used inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

POS_BITS = 28  # positions ride in the low bits of a packed hash; no text has more words or bytes
POS_MASK = np.uint64((1 << POS_BITS) - 1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hash per word, remembered for the words of one task up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Polynomial hashes modulo 2^64 of all windows of a sequence of uint64 values."""

    def __init__(self, base: int = BASES[0]):
        self.base = base
        inverse = base
        for _ in range(6):
            inverse = inverse * (2 - base * inverse) % (1 << 64)
        self.inverse, self.size = inverse, 0
        self.grow(4096)

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * self.size)
            with np.errstate(over="ignore"):
                ones = np.ones(self.size, dtype=np.uint64)
                self.up, self.down = ones.copy(), ones.copy()
                self.up[1:] = np.uint64(self.base)
                self.down[1:] = np.uint64(self.inverse)
                np.cumprod(self.up, out=self.up)
                np.cumprod(self.down, out=self.down)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self.grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return sums

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return mix((sums[width:] - sums[:-width]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of the given width."""
    done = 1
    while done < width:
        step = min(done, width - done)
        v = np.minimum(v[:-step], v[step:])
        done += step
    return v


def window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest gram in every run of `width` grams, the leftmost on ties."""
    packed = (grams & ~POS_MASK) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(packed, width) & POS_MASK).astype(np.int64)


def distinct_sorted(v: np.ndarray) -> np.ndarray:
    return v[np.r_[True, v[1:] != v[:-1]]] if len(v) else v


def signed(v: np.ndarray) -> np.ndarray:
    return v.view(np.int64)
