"""Periodic runs of words, found by a suffix automaton with link-cut access.

Word by word, the path from the appended prefix's state to the root of the suffix-link tree is accessed:
every state on it gets the new position as its last end. Before, the path falls into segments of one last
end each; the longest suffix of a segment, together with the distance from the previous to the new end,
is a square where the distance is at most its length, and a run of the text that ends at this word.

The tree is finished before the accesses, so nothing has to be rotated: a preferred path is kept as
coloured segments on the tree's heavy paths. An access changes O(log n) heavy paths and recolours an
amortised O(log n) segments, as with splay trees.

Before that, stretches that can't hold a run are left out: a run of 24 words and three periods at least
repeats 16-grams of words at the distance of its period, so only stretches of repeated 16-grams go
through the automaton. This filter loses no run.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_LENGTH, LEAST_EXPONENT = 24, 3
#: Words that a run of LEAST_LENGTH and LEAST_EXPONENT surely repeats at the distance of its period.
GRAM = 16
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class SuffixTree:
    """The suffix-link tree of a sequence, by a suffix automaton, cut into heavy paths."""

    def __init__(self, word: list[int]):
        length, link, following = [0], [-1], [{}]
        ends, last = [], 0
        for c in word:
            here = len(length)
            length.append(length[last] + 1)
            link.append(0)
            following.append({})
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = here
                p = link[p]
            if p >= 0:
                q = following[p][c]
                if length[p] + 1 == length[q]:
                    link[here] = q
                else:
                    clone = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    following.append(dict(following[q]))
                    link[q] = link[here] = clone
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = clone
                        p = link[p]
            ends.append(here)
            last = here
        self.length, self.link, self.ends = length, link, ends
        by_length = np.argsort(np.array(length), kind="stable").tolist()
        size = [1] * len(length)
        for v in reversed(by_length[1:]):
            size[link[v]] += size[v]
        heavy = [-1] * len(length)
        for v in by_length[1:]:
            p = link[v]
            if heavy[p] < 0 or size[v] > size[heavy[p]]:
                heavy[p] = v
        self.top = top = list(range(len(length)))
        for v in by_length[1:]:
            if heavy[link[v]] == v:
                top[v] = top[link[v]]


def runs_of(word: list[int], least_length: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of ``word`` with ``exponent`` >= 3 periods, each with its smallest one.

    A heavy path keeps its coloured segments as a stack of (length of the deepest state, last end), the
    segment next to the root on top; uncoloured states are below all. A segment that spans several heavy
    paths is met first where it is deepest.
    """
    tree, n = SuffixTree(word), len(word)
    length, link, top = tree.length, tree.link, tree.top
    segments: dict[int, list[tuple[int, int]]] = {}
    found = []
    for i, state in enumerate(tree.ends):
        v, deepest = state, {}
        while v > 0:
            head, deep = top[v], length[v]
            stack = segments.setdefault(head, [])
            while stack:
                low, end = stack[-1]
                if low <= deep:
                    stack.pop()
                    reach = low
                else:
                    reach = deep
                d = i - end
                if reach >= (exponent - 1) * d and reach + d >= least_length and (i + 1 == n or word[i + 1] != word[i + 1 - d]):
                    deepest.setdefault(d, reach)
                if low >= deep:
                    break
            stack.append((deep, i))
            v = link[head]
        found += [(i - d - reach + 1, reach + d, d) for d, reach in deepest.items()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_stretches(word: np.ndarray, gram: int = GRAM) -> list[tuple[int, int]]:
    """(start, end) of the stretches that every run lies within, from the nearest repeat of each 16-gram."""
    n = len(word)
    if n < LEAST_LENGTH:
        return []
    with np.errstate(over="ignore"):
        x = word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        width = 1
        while width < gram:  # the hash of 2, 4, 8, 16 words
            x = x[:-width] * np.uint64(0xBF58476D1CE4E5B9) + (x[width:] ^ (x[width:] >> np.uint64(31)))
            x ^= x >> np.uint64(27)
            width *= 2
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    if not same.any():
        return []
    step = np.where(same, np.diff(order), n + 1)
    near = np.full(len(x), n + 1)
    near[order[:-1]] = step
    near[order[1:]] = np.minimum(near[order[1:]], step)
    room = np.full(len(x), n)
    while True:
        kept = near <= room // LEAST_EXPONENT  # a run's period is a third of its stretch at most
        edges = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(kept)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + gram, -1)
        inside = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
        change = np.flatnonzero(inside[1:] != inside[:-1])
        spans = change.reshape(-1, 2)
        spans = spans[spans[:, 1] - spans[:, 0] >= LEAST_LENGTH]
        now = np.zeros(len(x), np.int64)
        for a, b in spans.tolist():
            now[a:b] = b - a
        if (now == room).all():
            return [tuple(s) for s in spans.tolist()]
        room = now


def periodic_runs(words: list[str]) -> list[tuple[int, int, int]]:
    """All runs of a text's words: LEAST_LENGTH words and LEAST_EXPONENT periods at least, by start and period."""
    if len(words) < LEAST_LENGTH:
        return []
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    found = []
    for a, b in repeated_stretches(np.array(ids, np.int64)):
        found += [(s + a, n, q) for s, n, q in runs_of(ids[a:b])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    return [w for w, d in zip(words, np.cumsum(drop[:-1]).tolist()) if not d] if runs else words


def highest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact exponent; ties: smallest start, then smallest period."""
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


def repeating(doc_id: int | None, words: list[str]) -> list[str]:
    """The words with the tail made periodic that one document in ten carries, as the number of the document says."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def find_runs(docs: DataFrame, prepare=None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs, the run of the greatest exponent, digests of runs and kept words.

    ``prepare(doc_id, words)`` may change the words first. NULL and empty texts have no words, no runs and
    the digests of nothing; repeated rows give repeated results; a NULL doc_id stays NULL; ties go to the
    smallest start, then period; further columns are ignored; an empty table gives an empty result. Very
    long texts are one automaton, whose memory grows with the stretches that repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch):
                rows = []
                for doc_id, text in zip(ids, texts):
                    words = WORD.findall(text) if text else []
                    if prepare is not None:
                        words = prepare(doc_id, words)
                    runs = periodic_runs(words)
                    best = highest(runs)
                    start, length, period = best or (None, None, None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    kept = " ".join(collapsed(words, runs))
                    rows.append((doc_id, len(runs), start, length, period, best and 1000 * length // period, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 6 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, SCHEMA)
