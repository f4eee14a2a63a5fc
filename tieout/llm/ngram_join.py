"""N-gram Jaccard join as a blocked sparse matrix product, and the groups that its links make.

Rows of the incidence matrix are documents, columns are word shingles. The product of the matrix with
its transpose holds the overlap of every pair; only overlaps of at least 3/7 of both sizes together
(a Jaccard similarity of 0.75) are links. What cannot reach that bound is discarded early:

1. Row blocks (slices of documents) send their entries to column blocks (ranges of shingle hashes). A
   column block finds the entries whose column holds another document and sends these back with the
   column's frequency. Columns of a fiftieth of all documents or more are known from a first pass;
   their entries stay with the row block, so no column gathers in one task.
2. A document whose shared entries s do not reach three quarters of its size has no link; the others
   go on, one of each set of shingles (a class).
3. Classes are blocked by size band and by the rarest of their shared columns, only as many as the
   bound leaves open: two linked classes meet in at least one block. In each block one class, that
   with the least share of columns of its own, is the centre; its overlaps with the others are
   accumulated exactly. Blocks thus cost as many products as members.
4. Two members x, y of a centre's blocks have at most min(i_x, i_y) + min(s_x - i_x, s_y - i_y) columns
   in common, i being overlaps with the centre. Pairs below the bound, and pairs that links
   already connect, are discarded; the overlaps of the rest are accumulated exactly.
5. Links give components; a document's component is the smallest doc_id in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import slices, stored
from tieout.llm.components import connected
from tieout.llm.shingles import Hasher

#: Similarity 0.75 in whole numbers: overlap / union >= NUM / DEN.
NUM, DEN = 3, 4
#: Entries of a column block.
BLOCK_ENTRIES = 1_000_000
#: Columns in at least this share of the documents stay with their row blocks.
FREQUENT = 0.02
#: In a slice, columns with fewer documents are not reported as frequent.
LEAST_LOCAL = 4
#: Ratio of neighbouring size bands.
BAND = 1.25
LOW_BITS = 40
#: Frequencies order columns; from here on they count alike.
MOST_DF = 2**16 - 1


def need(sizes):
    """The least overlap of a link of two sets whose sizes add up to ``sizes``."""
    return -(-NUM * sizes // (NUM + DEN))


def band_starts(longest: int = 2**31) -> np.ndarray:
    """The smallest size of each band."""
    starts, at = [1], 1.0
    while starts[-1] < longest:
        at *= BAND
        if int(np.ceil(at)) > starts[-1]:
            starts.append(int(np.ceil(at)))
    return np.array(starts, np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        for ids, texts in slices(batch):
            for a in range(0, len(ids), 60_000):  # row numbers within a slice take two bytes
                yield ids[a : a + 60_000], texts[a : a + 60_000]


def _cuts(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def set_keys(docs: DataFrame) -> DataFrame:
    """Per document: doc_id (of any type), n_shingles, key (of its set, NULL if empty); per slice a row with n_shingles -1 and its frequent columns."""

    narrow = docs.select("doc_id", F.col("text").cast("string"))
    kind, spark_kind = (pa.string(), "string") if narrow.schema["doc_id"].dataType.typeName() == "string" else (pa.int64(), "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for ids, texts in _slices(batches):
            owner, value = hasher.sets(texts)
            cuts = _cuts(owner, len(texts))
            keys = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cuts, cuts[1:])]
            columns, counts = np.unique(value, return_counts=True)
            often = counts >= max(LEAST_LOCAL, FREQUENT / 4 * len(ids))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids, None], kind), pa.array([*np.diff(cuts).tolist(), -1], pa.int64()), pa.array([*keys, None], pa.binary()),
                    pa.array([None] * n + [columns[often].view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([None] * n + [counts[often].tolist()], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "key", "columns", "counts"],
            )

    return narrow.mapInArrow(run, f"doc_id {spark_kind}, n_shingles long, key binary, columns array<long>, counts array<long>")


ENTRIES = "block long, row_block long, high binary, low binary, owner binary, df binary, sizes binary, names binary"


def _entries(docs: DataFrame, column_blocks: int, frequent: np.ndarray) -> DataFrame:
    """The incidence matrix in pieces: a row per row block and column block, and a row per row block with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, task = Hasher(), TaskContext.get().partitionId()
        for count, (_, texts) in enumerate(_slices(batches)):
            name = task * 2**32 + count
            owner, value = hasher.sets(texts)
            cuts = _cuts(owner, len(texts))
            names = b"".join(hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts, cuts[1:]))
            stays = np.isin(value, frequent) if len(frequent) else np.zeros(len(value), bool)
            kept, kept_owner = value[stays], owner[stays]
            block, low = _placed(kept, column_blocks)
            rows = [(-name - 1, name, *_planes(block << LOW_BITS | low), kept_owner.astype("<u2").tobytes(), np.full(len(kept), MOST_DF, "<u2").tobytes(), np.diff(cuts).astype("<u4").tobytes(), names)]
            value, owner = value[~stays], owner[~stays]
            order = np.argsort(value)
            value, owner = value[order], owner[order]
            block, low = _placed(value, column_blocks)
            edges = np.flatnonzero(np.diff(block, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(block)]):
                high, rest = _planes(low[a:b])
                rows.append((int(block[a]), name, high, rest, owner[a:b].astype("<u2").tobytes(), None, None, None))
            yield _batch(rows)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, ENTRIES)


def _placed(value: np.ndarray, column_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(column block, hash within the block) of hashes; increasing with the hash."""
    top = (value >> np.uint64(32)).astype(np.int64)
    block = top * column_blocks >> 32
    low = value & np.uint64(2**LOW_BITS - 1)
    return block, low.astype(np.int64)


def _planes(column: np.ndarray) -> tuple[bytes, bytes]:
    """Column numbers as a plane of high bits and one of the low 32 bits."""
    return (column >> 32).astype("<u4").tobytes() if len(column) and column.max() >> LOW_BITS else (column >> 32).astype("u1").tobytes(), column.astype("<u4").tobytes()


def _joined(high: bytes, low: bytes) -> np.ndarray:
    rest = np.frombuffer(low, "<u4").astype(np.int64)
    top = np.frombuffer(high, "u1" if len(high) == len(rest) else "<u4").astype(np.int64)
    return top << 32 | rest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 8
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
    names = ["block", "row_block", "high", "low", "owner", "df", "sizes", "names"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _shared_in_block(table: pa.Table) -> pa.Table:
    """Of a column block, the entries whose column has several; the row of a row block passes."""
    rows = table.to_pylist()
    if rows[0]["block"] < 0:
        return table
    values = [_joined(r["high"], r["low"]) for r in rows]
    value = np.concatenate(values)
    _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
    df = count[inverse]
    out, at = [], 0
    for r, own in zip(rows, values):
        mine = df[at : at + len(own)]
        at += len(own)
        keep = mine > 1
        if keep.any():
            df_bytes = np.minimum(mine[keep], MOST_DF).astype("<u2").tobytes()
            out.append((r["block"], r["row_block"], *_planes(own[keep]), np.frombuffer(r["owner"], "<u2")[keep].tobytes(), df_bytes, None, None))
    return pa.Table.from_batches([_batch(out)])


def _survivors(table: pa.Table) -> pa.Table:
    """Of a row block, the documents that can have a link: key, n, s and shared columns, rarest first."""
    parts = table.to_pylist()
    about = next(r for r in parts if r["sizes"] is not None)
    sizes = np.frombuffer(about["sizes"], "<u4").astype(np.int64)
    # the row block's own entries name their columns in full, the others within their column block
    column = np.concatenate([_joined(r["high"], r["low"]) | (max(r["block"], 0) << LOW_BITS) for r in parts])
    owner = np.concatenate([np.frombuffer(r["owner"], "<u2") for r in parts]).astype(np.int64)
    df = np.concatenate([np.frombuffer(r["df"], "<u2") for r in parts])
    shared = np.bincount(owner, minlength=len(sizes))
    able = (sizes > 0) & (shared * DEN >= sizes * NUM)
    use = able[owner]
    order = np.lexsort((column[use], df[use], owner[use]))
    column, owner = column[use][order], owner[use][order]
    cuts = _cuts(owner, len(sizes))
    found = np.flatnonzero(able)
    return pa.table(
        {
            "key": pa.array([about["names"][16 * i : 16 * i + 16] for i in found], pa.binary()),
            "n": pa.array(sizes[found]), "s": pa.array(shared[found]),
            "shared": pa.array([column[cuts[i] : cuts[i + 1]] for i in found], pa.list_(pa.int64())),
        }
    )


CLASSES = "key binary, n long, s long, shared array<long>"
POSTINGS = "column long, bands long, id long"
#: Bits of a class id below those that order classes by their share of columns of their own.
ID_BITS = 57


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks (column, pair of size bands) of every class."""
    starts = band_starts()
    for batch in batches:
        columns, bands, ids = [], [], []
        for identifier, n, s, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            shared = np.asarray(shared.values)
            own = int(np.searchsorted(starts, n, "right")) - 1
            least, most = -(-NUM * n // DEN), n * DEN // NUM
            for other in range(int(np.searchsorted(starts, least, "right")) - 1, int(np.searchsorted(starts, most, "right"))):
                smallest = max(least, int(starts[other]))
                open_columns = shared[: max(0, s - need(n + smallest) + 1)] if smallest <= most else shared[:0]
                columns.append(open_columns)
                for out, value in ((bands, min(own, other) * 1000 + max(own, other)), (ids, identifier)):
                    out.append(np.full(len(open_columns), value, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (columns, bands, ids)], names=["column", "bands", "id"])


def _overlaps(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b, further columns) with the exact overlap of both classes."""
    left = classes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a"))
    right = classes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"), F.col("shared").alias("shared_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.withColumn("overlap", F.size(F.array_intersect("shared_a", "shared_b")).cast("long")).drop("shared_a", "shared_b")


def _linked(overlap: str, n_a: str, n_b: str):
    return F.expr(f"{overlap} * {NUM + DEN} >= {NUM} * ({n_a} + {n_b})")


def link_classes(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id, label): the classes that may have links and the label of their component."""
    total, rows = keys.filter("n_shingles >= 0").agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).first()
    often = keys.filter("n_shingles < 0").select(F.explode(F.arrays_zip("columns", "counts")).alias("x")).groupBy("x.columns").agg(F.sum("x.counts").alias("n"))
    # at most 1 / FREQUENT times the mean size of a set, whatever the number of documents
    frequent = np.array(sorted(r[0] for r in often.filter(F.col("n") >= FREQUENT * rows).select("columns").toLocalIterator()), np.int64).view(np.uint64)
    column_blocks = max(1, -(-total // BLOCK_ENTRIES))
    returned = _entries(docs, column_blocks, frequent).groupBy("block").applyInArrow(_shared_in_block, ENTRIES)
    found = returned.groupBy("row_block").applyInArrow(_survivors, CLASSES)
    # the smallest id of a block is that of the class with the least share of columns of its own
    number = F.expr(f"shiftleft((n - s) * 63 div n, {ID_BITS}) + shiftrightunsigned(cast(conv(substr(hex(key), 1, 15), 16, 10) AS bigint), {60 - ID_BITS})")
    classes = stored(found.dropDuplicates(["key"]).withColumn("id", number))

    posted = classes.select("id", "n", "s", "shared").mapInArrow(_postings, POSTINGS)
    centres = posted.groupBy("column", "bands").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    pairs = posted.join(centres, ["column", "bands"]).filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    star = stored(_overlaps(pairs, classes))
    links = star.filter(_linked("overlap", "n_a", "n_b")).select("a", "b")
    labels = connected(links)

    # pairs of members of one centre that may be linked and are not connected yet; at least one is not linked to the centre
    placed = star.join(labels.withColumnRenamed("node", "b"), "b", "left").select(
        "a", "b", F.col("n_b").alias("n"), F.col("s_b").alias("s"), F.col("overlap").alias("i"), F.coalesce("label", F.col("b")).alias("label"), _linked("overlap", "n_a", "n_b").alias("near")
    )
    placed = stored(placed)
    x, y = placed.filter("NOT near").alias("x"), placed.alias("y")
    bound = F.expr(f"{NUM + DEN} * (least(x.i, y.i) + least(x.s - x.i, y.s - y.i)) >= {NUM} * (x.n + y.n)")
    sizes = F.expr(f"least(x.n, y.n) * {DEN} >= greatest(x.n, y.n) * {NUM}")
    rest = x.join(y, F.expr("x.a = y.a AND x.label <> y.label AND (y.near OR x.b < y.b)") & bound & sizes)
    rest = rest.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()
    more = _overlaps(rest, classes).filter(_linked("overlap", "n_a", "n_b")).select("a", "b")
    final = connected(links.union(stored(more)))
    return classes.select("key", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id (whole number or string), n_shingles, key (of the set of shingles) and component_id of every row of ``docs``.

    A document's set holds its distinct five-word shingles (all words as one, of fewer). component_id
    is the smallest doc_id among the documents that links reach; NULL doc_ids are ignored in it. A
    NULL or empty text, or one of white space, has an empty set, is linked with nothing and is its
    own component. Repeated rows share a set. An empty table gives an empty result; further columns
    are ignored.
    """
    keys = stored(set_keys(docs))
    own = keys.filter("n_shingles >= 0").select("doc_id", "n_shingles", "key")
    classes = own.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"))
    labelled = stored(classes.join(link_classes(docs, keys), "key", "left"))
    linked = labelled.filter(F.col("label").isNotNull())
    group = linked.groupBy("label").agg(F.min("least").alias("component"))
    alone = labelled.filter(F.col("label").isNull()).select("key", F.col("least").alias("component"))
    named = linked.join(group, "label").select("key", "component").unionByName(alone)
    return own.join(named, "key", "left").select("doc_id", "n_shingles", "key", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
