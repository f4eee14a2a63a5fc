"""Distinct word shingles of many texts at once, hashed with numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of words from running sums of a polynomial; the tables of powers grow with the longest slice."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.place = _powers(0xD6E8FEB86659FD93, WORDS + 1)

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data):
            n = len(data) + len(data) // 4
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts])

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, shingle hash) of every distinct shingle, sorted.

        Words are lower-cased (A-Z) runs of other characters than white space; a text of one to four
        words has one shingle, all its words; a text without words has none.
        """
        raw = [(t or "").encode() for t in texts]
        data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
        text_ends = np.cumsum([len(r) + 1 for r in raw])
        gap = np.concatenate([[True], _SPACE[data]])
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[0::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        words = self._words(data, starts, ends)
        owner = np.searchsorted(text_ends, starts, "right")
        owners, hashes = [], []
        if len(words) >= WORDS:
            n = len(words) - WORDS + 1
            whole = owner[:n] == owner[WORDS - 1 :]
            total = np.zeros(n, np.uint64)
            for k in range(WORDS):
                total += words[k : k + n] * self.place[k + 1]
            owners.append(owner[:n][whole])
            hashes.append(_mixed(total[whole]))
        count = np.bincount(owner, minlength=len(texts))
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            first = np.searchsorted(owner, short)
            total = count[short].astype(np.uint64)
            for k in range(WORDS - 1):
                has = count[short] > k
                total[has] += words[first[has] + k] * self.place[k + 1]
            owners.append(short)
            hashes.append(_mixed(total))
        return distinct(np.concatenate(owners), np.concatenate(hashes))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, value), sorted."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]
