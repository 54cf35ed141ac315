"""Words of whole Arrow batches as numpy arrays: boundaries, 64-bit hashes and word sequences."""

from __future__ import annotations

import numpy as np

_RATE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
#: The powers that are kept grow by whole steps of so many.
POWER_STEP = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in rising order. Sorting is many times faster than the hash table behind ``np.unique``."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return x[first]


def repeats(x: np.ndarray) -> np.ndarray:
    """The distinct values that occur more than once, in rising order."""
    x = np.sort(x)
    return distinct(x[1:][x[1:] == x[:-1]])


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true for the bytes of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash rate and their inverses modulo 2^64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = -(-n // POWER_STEP) * POWER_STEP
        both = []
        for rate in (_RATE, pow(_RATE, -1, 1 << 64)):
            steps = np.full(n, rate, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some rows.

    ``first``/``last`` are byte positions in ``text`` (the lower-cased bytes), ``row`` gives for each row the
    number of its first word (one more entry than rows), ``hash`` one 64-bit number per word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        base = offsets[0]
        text = LOWER[data[base:offsets[-1]]]
        n = len(text)
        self.text, self.inside = text, is_word[text]
        edge = np.zeros(n + 1, bool)
        edge[offsets - base] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = self.inside[:-1]
        self.first = np.flatnonzero(self.inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[n - 1:] = False
        after[:-1] = self.inside[1:]
        self.last = np.flatnonzero(self.inside & (~after | edge[1:])) + 1
        self.row = np.searchsorted(self.first, offsets - base)
        power, inverse = powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[text] * power[:n], out=total[1:])
        self.hash = mix((total[self.last] - total[self.first]) * inverse[self.first])

    def grams(self, k: int) -> np.ndarray:
        """A hash for the ``k`` words from each word on; only those inside one row mean anything."""
        h = self.hash
        out = np.zeros(len(h), np.uint64)
        if len(h) >= k:
            n = len(h) - k + 1
            total = np.zeros(n, np.uint64)
            for t in range(k):
                total = total * np.uint64(0x2545F4914F6CDD1D) + h[t:t + n]
            out[:n] = mix(total + np.uint64(k))
        return out

    def whole(self, k: int) -> np.ndarray:
        """True where ``k`` words from this word on lie in the same row."""
        ok = np.zeros(len(self.hash), bool)
        counts = np.diff(self.row)
        end = np.repeat(self.row[1:], counts)
        ok[:] = np.arange(len(self.hash)) + k <= end
        return ok

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))

    def sequences(self, starts: np.ndarray, k: int) -> list[str]:
        """The ``k`` words from each start, joined by one space."""
        if not len(starts):
            return []
        after = np.empty(len(self.text), bool)
        after[:1] = False
        after[1:] = self.inside[:-1]
        keep = self.inside | after
        flat = np.where(self.inside, self.text, np.uint8(32))[keep].tobytes()
        place = np.cumsum(keep) - 1
        low, high = place[self.first[starts]], place[self.last[starts + k - 1] - 1] + 1
        return [flat[a:b].decode("utf-8") for a, b in zip(low.tolist(), high.tolist())]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of ``w`` numbers from each place on; the last ``w - 1`` places look at what is left."""
    out = x.copy()
    for t in range(1, w):
        np.minimum(out[:-t], x[t:], out=out[:-t])
    return out
