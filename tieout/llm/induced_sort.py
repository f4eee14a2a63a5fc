"""External induced sorting of all suffixes of a shard of strings, with their common-prefix values.

As in induced sorting, a suffix is smaller (S) or larger (L) than its successor. The suffixes that begin
a run of S after an L are sorted first: their stretches up to the next such suffix are named in order,
and names are named again in pairs until all differ. From them, one scan upwards induces the L suffixes
and one scan downwards the S suffixes. Each scan takes tuples (suffix, common prefix with its neighbour)
from a monotone priority queue: one first-in-first-out queue for each first byte, whose blocks go to disk
when the queue holds too much. The tuples of a block are worked on together with numpy.

Common prefixes are carried along as minima over the scan and saturate at ``depth``; beyond it the order
of suffixes is arbitrary. Names therefore stop after ``depth`` bytes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SEPARATOR, PAD = 0xFE, 0xFF
BLOCK = 1 << 18
HELD_BYTES = 64_000_000


class DiskQueues:
    """Queues of (suffix, common prefix) blocks, one for each first byte; blocks beyond ``held`` bytes are on disk."""

    def __init__(self, held: int = HELD_BYTES):
        self.held, self.in_memory = held, 0
        self.blocks: list[list] = [[] for _ in range(256)]
        self.file = None

    def push(self, byte: int, suffix: np.ndarray, common: np.ndarray) -> None:
        for a in range(0, len(suffix), BLOCK):
            s, c = suffix[a : a + BLOCK], common[a : a + BLOCK]
            if self.in_memory + s.nbytes + c.nbytes > self.held:
                self.file = self.file or tempfile.TemporaryFile()
                at = self.file.seek(0, 2)
                self.file.write(s.tobytes() + c.tobytes())
                self.blocks[byte].append((at, len(s)))
            else:
                self.in_memory += s.nbytes + c.nbytes
                self.blocks[byte].append((s, c))

    def _read(self, block) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            return block
        self.file.seek(block[0])
        return np.fromfile(self.file, np.int64, block[1]), np.fromfile(self.file, np.int16, block[1])

    def pop(self, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the front until the queue is empty, those that are pushed meanwhile included; they stay readable.

        Small blocks that wait in memory are joined first.
        """
        n, blocks = 0, self.blocks[byte]
        while n < len(blocks):
            end, size = n, 0
            while end < len(blocks) and isinstance(blocks[end][0], np.ndarray) and size + len(blocks[end][0]) <= BLOCK:
                size += len(blocks[end][0])
                end += 1
            if end > n + 1:
                blocks[n:end] = [tuple(map(np.concatenate, zip(*blocks[n:end])))]
            yield self._read(blocks[n])
            n += 1

    def backwards(self, byte: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in reversed(self.blocks[byte]):
            yield self._read(block)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Scan:
    """Induces from blocks of a scan: finds, per target byte, the minimum of common prefixes since the last push."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int):
        self.text, self.wanted, self.depth = text, wanted, depth
        self.since = np.full(256, -1, np.int16)  # before the first push, so that its common prefix is 0

    def induce(self, suffix: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(byte, suffixes, common prefixes) to push, one step to the left of ``suffix``; ``wanted`` marks their type."""
        m = len(suffix)
        source = np.flatnonzero((suffix > 0) & self.wanted[suffix - 1])
        lows, ends = np.minimum.accumulate(common), np.append(np.minimum.accumulate(common[::-1])[::-1], self.depth).astype(np.int16)
        if not len(source):
            np.minimum(self.since, lows[-1], out=self.since)
            return
        target = self.text[suffix[source] - 1]
        order = np.argsort(target, kind="stable")
        at, target = source[order], target[order]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        begin = np.append(0, at[:-1] + 1)
        begin[first] = 0
        ranges = np.empty(2 * len(at), np.int64)
        ranges[::2], ranges[1::2] = begin, at + 1
        least = np.minimum.reduceat(np.append(common, np.int16(self.depth)), ranges)[::2]
        bytes_ = target[first]
        least[first] = np.minimum(least[first], self.since[bytes_])
        last = np.append(first[1:], len(at)) - 1
        np.minimum(self.since, lows[m - 1], out=self.since)
        self.since[bytes_] = ends[at[last] + 1]
        grown = np.minimum(least + 1, self.depth).astype(np.int16)
        left = suffix[at] - 1
        for byte, a, b in zip(bytes_.tolist(), first.tolist(), (last + 1).tolist()):
            yield byte, left[a:b], grown[a:b]


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that compares like them; ``text`` is padded."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))[at].astype(np.uint64)


def common_prefix(text: np.ndarray, one: np.ndarray, two: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes, ``depth`` at most."""
    out = np.zeros(len(one), np.int64)
    left = np.arange(len(one))
    while len(left):
        differ = words_at(text, one[left] + out[left]) ^ words_at(text, two[left] + out[left])
        zeros = np.zeros(len(left), np.int64)
        for shift in (56, 48, 40, 32, 24, 16, 8, 0):
            zeros += (differ >> np.uint64(shift)) == 0
        out[left] += zeros
        left = left[(zeros == 8) & (out[left] < depth)]
    return np.minimum(out, depth).astype(np.int16)


def refined(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
    """Split the groups of equal ``rank`` among ``rows`` by ``key``; a rank is the place of its group's first member."""
    first = rank[rows]
    if not first.any():
        order = np.argsort(key)
    elif key.dtype == np.int64:  # names, which fit beside a rank
        order = np.argsort(first * (len(rank) + 1) + key + 1)
    else:
        order = np.lexsort((key, first))
    rows, key, old = rows[order], key[order], rank[rows[order]]
    group = np.append(True, old[1:] != old[:-1])
    part = group | np.append(True, key[1:] != key[:-1])
    place = np.arange(len(rows))
    start = place[group][np.cumsum(group) - 1]
    rank[rows] = old + place[part][np.cumsum(part) - 1] - start


def not_alone(rank: np.ndarray, rows: np.ndarray) -> np.ndarray:
    size = np.bincount(rank, minlength=len(rank))
    return rows[size[rank[rows]] > 1]


def sorted_stars(text: np.ndarray, stars: np.ndarray, depth: int) -> np.ndarray:
    """``stars`` in the order of their suffixes, exact up to ``depth`` bytes."""
    size = np.diff(stars, append=stars[-1]) + 1  # up to the next one, that included
    rank, rows, done = np.zeros(len(stars), np.int64), np.arange(len(stars)), 0
    while len(rows):
        word = words_at(text, np.minimum(stars[rows] + done, len(text) - 8))
        keep = np.clip(size[rows] - done, 0, 8).astype(np.uint64)
        fill = np.where(keep == 0, ~np.uint64(0), np.where(keep == 8, np.uint64(0), (~np.uint64(0)) >> (np.minimum(keep, 7) * np.uint64(8))))
        refined(rank, rows, word | fill)
        done += 8
        rows = not_alone(rank, rows)
        longest = np.zeros(len(rank), np.int64)
        np.maximum.at(longest, rank[rows], size[rows])
        rows = rows[longest[rank[rows]] > done]
    rows, step = not_alone(rank, np.arange(len(stars))), 1
    while len(rows) and step <= depth:  # a name covers two bytes at least, ``step`` names are known to differ or not
        after = rows + step
        refined(rank, rows, np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)], -1))
        rows, step = not_alone(rank, rows), step * 2
    return stars[np.argsort(rank, kind="stable")]


def neighbours(text: np.ndarray, depth: int, held: int = HELD_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (suffix, common prefix with one neighbour in sorted order) that cover all neighbouring pairs of first bytes.

    ``text`` is of bytes 1 to SEPARATOR with 0 at its end. The pairs: each L suffix with the next smaller
    one of its first byte, each S suffix with the next larger one, and the largest L with the smallest S of
    a first byte. For each pair, both suffixes are named with its common prefix.
    """
    n = len(text)
    padded = np.concatenate([text, np.full(depth + 16, PAD, np.uint8)])
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    rises = np.append(text[change[:-1] + 1] > text[change[:-1]], True)
    small = np.repeat(rises, np.diff(change, prepend=-1))
    stars = sorted_stars(padded, np.flatnonzero(small[1:] & ~small[:-1]) + 1, depth)
    star_common = np.append(np.int16(0), common_prefix(padded, stars[:-1], stars[1:], depth))
    bounds = np.searchsorted(text[stars], np.arange(257))
    star_common[bounds[:-1][bounds[:-1] < bounds[1:]]] = 0
    larger, smaller = DiskQueues(held), DiskQueues(held)
    last_large: dict[int, int] = {}
    scan = Scan(text, ~small, depth)
    for byte in range(256):
        for suffix, common in larger.pop(byte):
            if len(suffix):
                for push in scan.induce(suffix, common):
                    larger.push(*push)
                last_large[byte] = int(suffix[-1])
        a, b = bounds[byte], bounds[byte + 1]
        if a < b:
            common = star_common[a:b].copy()
            if byte in last_large:
                common[0] = common_prefix(padded, np.array([last_large[byte]]), stars[a : a + 1], depth)[0]
            for push in scan.induce(stars[a:b], common):
                larger.push(*push)
    scan = Scan(text, small, depth)
    for byte in range(255, -1, -1):
        least = None
        for suffix, common in smaller.pop(byte):
            for push in scan.induce(suffix, common):
                smaller.push(*push)
            yield from paired(suffix, common, least)
            least = int(suffix[-1])
        before = None  # the common prefix of the next smaller one belongs to the pair with it
        for suffix, common in larger.backwards(byte):
            suffix, common = suffix[::-1], common[::-1]
            if before is None:
                before = 0 if least is None else common_prefix(padded, np.array([suffix[0]]), np.array([least]), depth)[0]
            with_larger = np.append(np.int16(before), common[:-1]).astype(np.int16)
            before = common[-1]
            for push in scan.induce(suffix, with_larger):
                smaller.push(*push)
            yield from paired(suffix, with_larger, least)
            least = int(suffix[-1])
    larger.close()
    smaller.close()


def paired(suffix: np.ndarray, common: np.ndarray, before: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both members of the pairs (suffix, the one scanned before it)."""
    yield suffix, common
    others = np.append(-1 if before is None else before, suffix[:-1])
    known = others >= 0
    yield others[known], common[known]


def repeated_starts(strings: list[bytes], width: int, held: int = HELD_BYTES) -> list[np.ndarray]:
    """For each string, True where a ``width``-byte substring begins that begins at another place of the strings, too.

    Bytes are those of UTF-8 texts, which never reach 0xFD.
    """
    text = np.frombuffer((b"\xfd".join(strings)) + b"\xfd", np.uint8) + np.uint8(1)
    repeated = np.zeros(len(text) + 1, bool)
    for suffix, common in neighbours(np.append(text, np.uint8(0)), width, held):
        repeated[suffix[common >= width]] = True
    out, at = [], 0
    for s in strings:
        out.append(repeated[at : at + max(0, len(s) - width + 1)])
        at += len(s) + 1
    return out
