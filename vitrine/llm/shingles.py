"""Hashed word shingles of many texts at once, with numpy.

Words are runs of bytes without ``\\x20 \\x09-\\x0D``; A-Z count as a-z.  A word's
hash is a polynomial over a table of random 64-bit values, a shingle's a mixed
sum over its words.  Two different shingles share a hash with a chance of
about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
GROUP_BYTES = 1 << 20  # texts hashed together; a longer text is a group of its own


def _table() -> np.ndarray:
    t = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    t[65:91] = t[97:123]
    return t


class Hasher:
    """Word and shingle hashes; holds the tables, which grow to the longest text seen."""

    ROOT = 0x9E3779B97F4A7C13  # odd
    MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
    PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)

    def __init__(self, words: int = WORDS):
        self.words = words
        self.table = _table()
        self.white = np.zeros(256, bool)
        self.white[[32, 9, 10, 11, 12, 13]] = True
        self.places = [np.uint64(p + 2 * (i // 5)) for i, p in enumerate(self.PLACES * (words // 5 + 1))][:words]
        self._grow(GROUP_BYTES * 2)

    def _grow(self, n: int) -> None:
        inverse = np.uint64(pow(self.ROOT, -1, 1 << 64))
        self.power = np.ones(n, np.uint64)
        self.power[1:] = np.uint64(self.ROOT)
        np.cumprod(self.power, out=self.power)
        self.back = np.ones(n, np.uint64)
        self.back[1:] = inverse
        np.cumprod(self.back, out=self.back)

    def mix(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(self.MIX[0])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(self.MIX[1])
        return h ^ (h >> np.uint64(31))

    def word_hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of each word."""
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if len(b) > len(self.power):
            self._grow(len(b) * 5 // 4)
        word = np.zeros(len(b) + 2, np.int8)
        word[1:-1] = ~self.white[b]
        edge = np.diff(word)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.table[b] * self.power[:len(b)], out=total[1:])
        return start, self.mix((total[end] - total[start]) * self.back[start])

    def windows(self, h: np.ndarray) -> np.ndarray:
        """A hash for each run of ``words`` words; none where there are fewer."""
        m = len(h) - self.words + 1
        if m < 1:
            return np.zeros(0, np.uint64)
        s = np.zeros(m, np.uint64)
        for i, p in enumerate(self.places):
            s += h[i:i + m] * p
        return self.mix(s)

    def whole(self, h: np.ndarray) -> np.ndarray:
        """The one hash of a text with fewer words than a shingle."""
        s = np.uint64(len(h)) * np.uint64(self.ROOT)
        for x, p in zip(h, self.places):
            s = s + x * p
        return self.mix(np.array([s], np.uint64))

    def runs(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, word hashes in order) of each text; null is empty."""
        group, first, size = [], 0, 0
        for i, t in enumerate(texts):
            data = (t or "").encode("utf-8", "surrogatepass")
            if group and size + len(data) > GROUP_BYTES:
                yield from self._group(group, first)
                group, first, size = [], i, 0
            group.append(data)
            size += len(data) + 1
        if group:
            yield from self._group(group, first)

    def _group(self, group: list[bytes], first: int) -> Iterator[tuple[int, np.ndarray]]:
        with np.errstate(over="ignore"):
            start, h = self.word_hashes(b"\n".join(group))
            edges = np.cumsum([0] + [len(x) + 1 for x in group])
            cut = np.searchsorted(start, edges)
            for k in range(len(group)):
                yield first + k, h[cut[k]:cut[k + 1]]

    def sets(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(row, sorted distinct shingle hashes) of each text."""
        with np.errstate(over="ignore"):
            for i, h in self.runs(texts):
                if not len(h):
                    yield i, h
                elif len(h) < self.words:
                    yield i, self.whole(h)
                else:
                    yield i, np.unique(self.windows(h))
