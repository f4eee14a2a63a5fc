"""A minimal perfect hash of 64-bit keys, built bucket by bucket, and dense count vectors indexed by it.

Each bucket places its keys over a cascade of bit arrays: a key that is alone in its slot of one level
stays there, the others try the next level. The index of a key is the number of set bits before its own
in the arrays of all buckets one after another, so n keys have the indices 0 to n - 1. An array of the
keys in index order verifies every lookup: a key outside the set is found out and never counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import stored

BUCKET_KEYS = 100_000
CHUNK = 65_536
FAN_IN = 8
LEVEL_SCHEMA = "bucket long, level int, words binary, keys binary"
CHUNK_SCHEMA = "node long, chunk long, counts binary"


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """One bijective mix of unsigned 64-bit keys for each level."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys, 0) % np.uint64(buckets)).astype(np.int64)


def cascade(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words of 64 bits, keys in slot order) of each level of one bucket of distinct keys."""
    level = 0
    while len(keys):
        level += 1
        slots = mixed(keys, level) % np.uint64(max(64, -(-2 * len(keys) // 64) * 64))
        size = max(64, -(-2 * len(keys) // 64) * 64)
        alone = np.bincount(slots.astype(np.int64), minlength=size)[slots.astype(np.int64)] == 1
        placed, at = keys[alone], slots[alone].astype(np.int64)
        order = np.argsort(at)
        bits = np.zeros(size, bool)
        bits[at] = True
        yield np.packbits(bits, bitorder="little").view(np.uint64), placed[order]
        keys = keys[~alone]


class PairHash:
    """Index of each key of a fixed set, verified; made from the levels of its buckets in (bucket, level) order."""

    def __init__(self, buckets: int, levels: list[tuple[int, int, bytes, bytes]]):
        self.buckets = buckets
        self.words = np.concatenate([np.frombuffer(w, np.uint64) for _, _, w, _ in levels] or [np.zeros(0, np.uint64)])
        self.keys = np.concatenate([np.frombuffer(k, np.int64) for _, _, _, k in levels] or [np.zeros(0, np.int64)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        deepest = max((level for _, level, _, _ in levels), default=0)
        self.start = np.zeros((buckets, deepest + 1), np.int64)
        self.size = np.zeros((buckets, deepest + 1), np.int64)
        at = 0
        for bucket, level, words, _ in levels:
            self.start[bucket, level], self.size[bucket, level] = at, len(words) * 8
            at += len(words) * 8

    def __len__(self) -> int:
        return len(self.keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for those outside the set."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        left = np.arange(len(keys))
        bucket = buckets_of(keys, self.buckets)
        for level in range(1, self.size.shape[1]):
            size = self.size[bucket[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            slot = self.start[bucket[left], level] + (mixed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = slot >> 6, (slot & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[word] + np.bitwise_count(below).astype(np.int64)
            out[left[here]] = rank[here]
            left = left[~here]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)


def built(distinct: DataFrame, n_keys: int, block_keys: int) -> tuple[DataFrame, int, int]:
    """(levels of all buckets as a written table, buckets, blocks) of the column ``key`` of distinct keys.

    A block is a run of neighbouring buckets with about ``block_keys`` keys, the most that one task holds.
    """
    buckets = max(1, -(-n_keys // min(BUCKET_KEYS, block_keys)))
    blocks = max(1, -(-n_keys // block_keys))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(buckets_of(keys, buckets)), pa.array(keys)], names=["bucket", "key"])

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        levels = cascade(rows["key"].to_numpy())
        return pd.DataFrame([(key[0], n, w.tobytes(), k.tobytes()) for n, (w, k) in enumerate(levels, 1)], columns=["bucket", "level", "words", "keys"])

    dealt = distinct.select("key").mapInArrow(number, "bucket long, key long")
    return stored(dealt.groupBy("bucket").applyInPandas(place, LEVEL_SCHEMA)), buckets, blocks


def bucket_range(block: int, blocks: int, buckets: int) -> tuple[int, int]:
    return block * buckets // blocks, (block + 1) * buckets // blocks


def loaded(levels: DataFrame, buckets: int, first: int, end: int) -> PairHash:
    """The hash of the buckets ``first`` to ``end`` - 1: at most one block of keys reaches the driver."""
    rows = levels.filter((F.col("bucket") >= first) & (F.col("bucket") < end)).collect()
    return PairHash(buckets, [tuple(r) for r in sorted(rows, key=lambda r: (r.bucket, r.level))])


def summed_counts(partial: DataFrame, hashed: PairHash) -> np.ndarray:
    """Counts of all keys of ``hashed`` as a dense vector, from rows (key, n) of which keys outside are skipped.

    Each task adds its rows into one dense vector; the vectors are then added in a tree, chunk by chunk
    and ``FAN_IN`` at a time.
    """
    held = partial.sparkSession.sparkContext.broadcast(hashed)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vector = np.zeros(len(held.value), np.int64)
        for batch in batches:
            index = held.value.index(batch.column(0).to_numpy())
            known = index >= 0
            vector += np.bincount(index[known], weights=batch.column(1).to_numpy()[known], minlength=len(vector)).astype(np.int64)
        starts = [a for a in range(0, len(vector), CHUNK) if vector[a : a + CHUNK].any()]
        node = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([node] * len(starts), pa.int64()),
                pa.array([a // CHUNK for a in starts], pa.int64()),
                pa.array([vector[a : a + CHUNK].tobytes() for a in starts], pa.binary()),
            ],
            names=["node", "chunk", "counts"],
        )

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in rows["counts"])
        return pd.DataFrame([(key[0], key[1], total.tobytes())], columns=["node", "chunk", "counts"])

    nodes = stored(partial.select("key", "n").mapInArrow(local, CHUNK_SCHEMA))
    most = nodes.agg(F.max("node")).first()[0] or 0
    while most:
        nodes = nodes.withColumn("node", F.expr(f"node div {FAN_IN}")).groupBy("node", "chunk").applyInPandas(add, CHUNK_SCHEMA)
        most //= FAN_IN
    out = np.zeros(len(hashed), np.int64)
    for row in nodes.collect():  # one block of counts at most
        part = np.frombuffer(row.counts, np.int64)
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(part)] = part
    held.unpersist()
    return out
