"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) are sorted by size; each enters the bin with the least remaining capacity that
still holds it, found in a balanced search tree of remaining capacities. At scale this happens in
two steps. Tasks pack small groups, cell by cell, into packets of a fraction of a shard, again until
their number is bounded; large groups (a bounded number by their size) stay as they are. The driver
packs packets and large groups into shards, with the least capacity that needs no more than the
given number of shards. A group larger than a fair share has a shard of its own.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm.common import placed_rows, spread_rank, stored, text_key, utf8_size

UNITS = 2048
CELL_ITEMS = 50_000


class Tree:
    """A treap of (room, bin): a search tree kept balanced by random priorities."""

    __slots__ = ("root", "rng")

    def __init__(self):
        self.root, self.rng = None, random.Random(1)

    def add(self, key: tuple[int, int]) -> None:
        left, right = _split(self.root, key)
        self.root = _merge(_merge(left, [key, self.rng.random(), None, None]), right)

    def take_least(self, room: int) -> tuple[int, int] | None:
        """Remove and return the least entry with at least ``room``."""
        left, right = _split(self.root, (room, -1))
        if right is None:
            return None
        parent, node = None, right
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self.root = _merge(left, right)
        return node[0]


def _split(node, key):
    """(entries below ``key``, the others)."""
    if node is None:
        return None, None
    if node[0] < key:
        low, high = _split(node[3], key)
        node[3] = low
        return node, high
    low, high = _split(node[2], key)
    node[2] = high
    return low, node


def _merge(left, right):
    if left is None or right is None:
        return right if left is None else left
    if left[1] > right[1]:
        left[3] = _merge(left[3], right)
        return left
    right[2] = _merge(left, right[2])
    return right


def best_fit_decreasing(sizes: Iterable[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each size (given in decreasing order); None once more than ``most`` bins are needed.

    A size above ``capacity`` gets a bin of its own.
    """
    tree, out, bins = Tree(), [], 0
    for size in sizes:
        found = tree.take_least(size)
        if found is None:
            if most is not None and bins == most:
                return None
            room, number, bins = capacity, bins, bins + 1
        else:
            room, number = found
        if room > size:
            tree.add((room - size, number))
        out.append(number)
    return out


def pack_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each size (in decreasing order), sizes of shards near equal."""
    alone = 0
    rest = sum(sizes)
    while alone < shards - 1 and alone < len(sizes) and sizes[alone] * (shards - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    left, bins = sizes[alone:], shards - alone
    low = max(-(-rest // bins), left[0] if left else 0)
    high, best = low, best_fit_decreasing(left, low, bins)
    while best is None:
        low, high = high + 1, high + max(1, high // 64)
        best = best_fit_decreasing(left, high, bins)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(left, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return [*range(alone), *(alone + b for b in best)]


def _pack_cells(items: DataFrame, n: int, capacity: int) -> DataFrame:
    """(item, bytes, packet): items packed cell by cell into packets of ``capacity``."""
    cells = max(1, -(-n // CELL_ITEMS))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "item"], ascending=[False, True], kind="stable")
        bins = best_fit_decreasing(frame["bytes"].tolist(), capacity)
        cell = frame["cell"].iloc[0]
        return pd.DataFrame({"item": frame["item"], "bytes": frame["bytes"], "packet": [f"{cell}/{b}" for b in bins]})

    dealt = items.select("item", "bytes", F.pmod(F.xxhash64("item"), F.lit(cells)).alias("cell"))
    return dealt.groupBy("cell").applyInPandas(pack, "item string, bytes long, packet string")


def assign_groups(spark: SparkSession, groups: DataFrame, shards: int, units: int = UNITS, most_items: int = 100_000) -> DataFrame:
    """(item, shard) of every group of ``groups`` (item string unique, bytes long).

    What reaches the driver: sizes of groups above half a unit (at most 2 x units x shards) and of
    packets, which are packed again while they are more than ``most_items``.
    """
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    unit = max(1, total // (units * shards))
    large = groups.filter(F.col("bytes") * 2 > unit).select("item", "bytes", F.concat(F.lit("g"), F.col("item")).alias("packet"))
    small = groups.filter(F.col("bytes") * 2 <= unit)
    level = stored(_pack_cells(small, n, unit).withColumn("packet", F.concat(F.lit("p0:"), "packet")).unionByName(large))
    assigned, sizes, depth = level.select("item", "packet"), None, 0
    while True:
        sizes = level.groupBy("packet").agg(F.sum("bytes").alias("bytes"))
        count = sizes.count()
        if count <= most_items:
            break
        depth += 1
        level = stored(_pack_cells(sizes.filter(F.col("bytes") * 2 <= unit).withColumnRenamed("packet", "item"), count, unit).withColumn("packet", F.concat(F.lit(f"p{depth}:"), "packet")).unionByName(sizes.filter(F.col("bytes") * 2 > unit).selectExpr("packet AS item", "bytes", "packet")))
        assigned = assigned.join(level.select(F.col("item").alias("packet"), F.col("packet").alias("next")), "packet").select("item", F.col("next").alias("packet"))
        if level.select("packet").distinct().count() >= count:
            break
    rows = sorted(((r["bytes"], r["packet"]) for r in sizes.toLocalIterator()), key=lambda x: (-x[0], x[1]))
    bins = pack_shards([b for b, _ in rows], shards) if rows else []
    final = spark.createDataFrame(pd.DataFrame({"packet": [p for _, p in rows], "shard": bins}).astype({"packet": "string", "shard": "int32"}), "packet string, shard int")
    return assigned.join(F.broadcast(final), "packet").select("item", "shard")


def shard(docs: DataFrame, shards: int = 8, keep: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``; with ``keep``, its columns, shard and slot.

    size is the text's UTF-8 bytes plus 1 (NULL: none). Rows of equal text share a shard, NULL and
    empty text being equal; slots count from 0 without gaps in each shard, with ``keep`` in the order
    in which the rows were written. Repeated rows each get a slot; a NULL doc_id stays NULL; an empty
    table gives an empty result; further columns are ignored, or kept unless they are named shard or
    slot.
    """
    if keep:
        rows = placed_rows(docs.drop("shard", "slot"), "__")
        part = F.lpad(F.regexp_extract("__file", r"^part-(\d+)", 1), 12, "0")  # file names sort as text, part numbers as numbers
        cell, order = F.concat(part, F.lit("#"), "__file", F.lit("#"), F.lpad(F.expr("__row div 1024").cast("string"), 12, "0")), [F.col("__row")]
    else:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        cell, order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**20)), [F.col("__key"), F.col("doc_id")]
    rows = rows.select("*", (utf8_size(F.col("text")) + 1).alias("__size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("__crc"), text_key(F.col("text")).alias("__key"), cell.alias("__deal"))
    if not keep:
        rows = stored(rows.drop("text"))
    groups = stored(rows.groupBy(F.col("__key").alias("item")).agg(F.sum("__size").alias("bytes")))
    where = assign_groups(docs.sparkSession, groups, shards)
    placed = rows.join(where.withColumnRenamed("item", "__key"), "__key")
    placed = placed if keep else stored(placed)
    dealt = F.col("__deal")
    if not keep:  # as many cells as the square root of the number of rows
        dealt = F.pmod(dealt, F.lit(max(1, int(placed.count() ** 0.5))))
    slotted = spread_rank(placed, ["shard"], order, dealt, "slot")
    if keep:
        return slotted.drop("__size", "__crc", "__key", "__deal", "__file", "__row")
    return slotted.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), "shard", "slot")
