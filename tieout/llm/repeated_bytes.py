"""Removal of byte strings of a fixed width that begin at more than one place of the corpus.

Windows that are equal hold the same anchor, their leftmost smallest 24-byte gram by hash. Neighbouring
windows with one anchor make a piece of at most 376 bytes. Pieces of an anchor that occurs once are unique;
where all pieces of an anchor are one string, all their windows repeat. What is left, one copy of each
different piece, is dealt by anchor into shards whose suffixes ``induced_sort`` puts in order with their
common prefixes: a window repeats if its suffix shares ``width`` bytes with a neighbour. Anchors with more
than ``split`` different pieces (the edges of a passage that very many documents share) would fill a shard
of their own: such pieces are cut into parts of 16 windows, counted from the anchor, and dealt by a hash of
the bytes that all windows of a part share. Parts of which more than ``split`` share these bytes, too, differ
in 15 bytes at most; their windows are counted by a 128-bit hash of all their bytes instead.

Positions flow back to the documents, never texts to the driver: two shuffles of the texts, the others of
pieces by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import placed_rows, slices, stored
from tieout.llm.induced_sort import repeated_starts

GRAM = 24
STRETCH = 8_000_000
SHARD_BYTES = 4_000_000
SPLIT = 2_000
PART = 16
TABLE = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64((1 << 24) - 1)
BITS = "anchor long, content long, bits binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 24-byte gram."""
    with np.errstate(over="ignore"):

        def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            x = left * np.uint64(0xBF58476D1CE4E5B9) + (right ^ (right >> np.uint64(31)))
            return x ^ (x >> np.uint64(29))

        x = TABLE[data]
        for width in (1, 2, 4):
            x = joined(x[:-width], x[width:])
        return joined(joined(x[:-8], x[8:])[:-8], x[16:]) * np.uint64(0x94D049BB133111EB)


def pieces(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows and place of the anchor, anchor) of the pieces of texts that lie one after another in ``data``.

    The number of windows is in the lowest byte, the anchor's distance from the first window in the next one.
    """
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, span = gram_hashes(data), width - GRAM + 1
    key = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    rows = np.append(key, np.full(-len(key) % span, ~np.uint64(0))).reshape(-1, span)
    before, after = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    anchor = np.minimum(after[:n], before[span - 1 : span - 1 + n]) & PLACE
    whole = np.zeros(n + 1, np.int64)  # windows that cross no end of a text
    for end, size in zip(ends.tolist(), np.diff(ends, prepend=0).tolist()):
        if size >= width:
            whole[end - size] += 1
            whole[end - width + 1] -= 1
    at = np.flatnonzero(np.cumsum(whole[:-1]))
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]]))) if len(at) else at
    start, place = at[first], anchor[at[first]].astype(np.int64)
    return start, np.diff(first, append=len(at)) | (place - start) << 8, hashes[place]


def stretches(texts: list[str | None], width: int) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first text, offset in it, bytes, ends) of texts one after another; a very long text comes in overlapping stretches."""
    coded = [t.encode() if t else b"" for t in texts]
    if sum(map(len, coded)) <= STRETCH:
        yield 0, 0, b"".join(coded), np.cumsum([len(c) for c in coded])
        return
    for n, c in enumerate(coded):
        for a in range(0, max(1, len(c) - width + 1), STRETCH):
            part = c[a : a + STRETCH + width - 1]
            yield n, a, part, np.array([len(part)])


def found_pieces(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for files, texts in slices(batch, 2):
                places = batch.column(1)[done : done + len(texts)].to_numpy()
                done += len(texts)
                for n, offset, data, ends in stretches(texts, width):
                    at, windows, anchor = pieces(np.frombuffer(data, np.uint8), ends, width)
                    owner = np.searchsorted(ends, at, "right")
                    content = [xxhash.xxh3_64_intdigest(data[a : a + w]) for a, w in zip(at.tolist(), ((windows & 0xFF) + width - 1).tolist())]
                    starts = np.append(0, ends[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.array(files, np.int64)[owner + n]),
                            pa.array(places[owner + n]),
                            pa.array(((at - starts[owner] + offset) << 16) | windows),
                            pa.array(anchor.view(np.int64)),
                            pa.array(np.array(content, np.uint64).view(np.int64)),
                        ],
                        names=["file", "row", "at", "anchor", "content"],
                    )

    return run


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way through a shuffle."""
    squeeze = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        done = 0
        for _, texts in slices(batch, 3):
            rest = [batch.column(k)[done : done + len(texts)] for k in range(3)]
            done += len(texts)
            yield pa.RecordBatch.from_arrays([*rest, pa.array([squeeze(t.encode()) if t else b"" for t in texts], pa.binary())], names=["file", "row", "doc_id", "packed"])


def unpacked(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value) if value else b""


CUT = "anchor long, content long, window int, string binary, h1 long, h2 long"


def _halves(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(data)
    return (h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=[f.split()[0] for f in CUT.split(", ")])


def cut_out(width: int):
    """Wanted pieces as strings, dealt by anchor; where the anchor is ``hot``, their parts, dealt by what their windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data, rows = unpacked(text.as_py()), []
                for w in wanted.as_py():
                    start, place, size = w["at"] >> 16, w["at"] >> 8 & 0xFF, w["at"] & 0xFF
                    if not w["hot"]:
                        rows.append((w["anchor"], w["content"], 0, data[start : start + size + width - 1], w["anchor"], None))
                        continue
                    # windows are counted back from the anchor, so that parts of equal strings are cut alike
                    first = 0
                    while first < size:
                        end = min(size, place - (place - first) // PART * PART + 1)
                        shared = data[start + place - (place - first) // PART * PART : start + place - (place - first) // PART * PART + width - PART + 1]
                        rows.append((w["anchor"], w["content"], first, data[start + first : start + end + width - 1], *_halves(shared)))
                        first = end
                yield _cut_batch(rows)

    return run


def single_windows(width: int):
    """The windows of parts, one row each with a hash of all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, window, string in zip(*(c.to_pylist() for c in batch.columns)):
                yield _cut_batch([(anchor, content, window + k, None, *_halves(string[k : k + width])) for k in range(len(string) - width + 1)])

    return run


def sort_shard(width: int):
    def run(table: pa.Table) -> pa.Table:
        flags = repeated_starts(table["string"].to_pylist(), width)
        bits = pa.array([np.packbits(f, bitorder="little").tobytes() if f.any() else None for f in flags], pa.binary())
        return pa.table({"anchor": table["anchor"], "content": table["content"], "window": table["window"], "bits": bits}).filter(bits.is_valid())

    return run


def as_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of each piece as one row of bits, from lists of (first window, bits); NULL bits are that window."""
    for batch in batches:
        out = []
        for parts in batch.column(2).to_pylist():
            flags = np.zeros(256, bool)
            for p in parts:
                own = np.array([True]) if p["bits"] is None else np.unpackbits(np.frombuffer(p["bits"], np.uint8), bitorder="little").astype(bool)
                at = p["window"] + np.flatnonzero(own)
                flags[at] = True
            out.append(np.packbits(flags, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["anchor", "content", "bits"])


def repeated_windows(narrow: DataFrame, width: int, shard_bytes: int, split: int) -> DataFrame:
    """(file, row, spans): per text that holds any, its pieces with repeated windows as (at, bits); NULL bits are all of them."""
    found = narrow.select("file", "row", "text").mapInArrow(found_pieces(width), "file long, row long, at long, anchor long, content long")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("least"), F.max("content").alias("most"))
    # written first: only a join of two plain shuffles is split where an anchor is hot
    shared = stored(shared.filter("n > 1").select("anchor", F.expr("least <> most").alias("mixed")))
    shared = stored(found.join(shared, "anchor"))
    kinds = shared.filter("mixed").groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "row", "at")).alias("sample"))
    kinds = stored(kinds)
    crowded = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > split).select("anchor", F.lit(True).alias("hot"))
    wanted = kinds.join(crowded, "anchor", "left").select("sample.*", "anchor", "content", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = wanted.groupBy("file", "row").agg(F.collect_list(F.struct("at", "anchor", "content", "hot")).alias("wanted"))
    texts = narrow.select("file", "row", "doc_id", "text").mapInArrow(packed, "file long, row long, doc_id long, packed binary")
    cut = texts.join(wanted, ["file", "row"]).select("packed", "wanted")
    cut = stored(cut.mapInArrow(cut_out(width), CUT))

    full = cut.filter("h2 IS NOT NULL").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split).select("h1", "h2", F.lit(True).alias("full"))
    parts = stored(cut.join(full, ["h1", "h2"], "left").withColumn("full", F.coalesce("full", F.lit(False))))
    total = parts.filter("NOT full").agg(F.sum(F.length("string"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = parts.filter("NOT full").select(F.pmod(F.xxhash64("h1", "h2"), F.lit(shards)).alias("shard"), "anchor", "content", "window", "string")
    by_sort = dealt.groupBy("shard").applyInArrow(sort_shard(width), "anchor long, content long, window int, bits binary")
    windows = parts.filter("full").select("anchor", "content", "window", "string").mapInArrow(single_windows(width), CUT).drop("string")
    windows = stored(windows)
    twice = stored(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"))
    by_hash = windows.join(twice, ["h1", "h2"]).select("anchor", "content", "window", F.lit(None).cast("binary").alias("bits"))
    found_bits = by_sort.unionByName(by_hash).groupBy("anchor", "content").agg(F.collect_list(F.struct("window", "bits")).alias("parts")).mapInArrow(as_bits, BITS)
    known = kinds.select("anchor", "content", "n").join(found_bits, ["anchor", "content"], "left")
    known = stored(known.filter("n > 1 OR bits IS NOT NULL").select("anchor", "content", F.expr("CASE WHEN n = 1 THEN bits END").alias("bits")))
    mixed = shared.filter("mixed").join(known, ["anchor", "content"]).select("file", "row", "at", "bits")
    plain = shared.filter("NOT mixed").select("file", "row", "at", F.lit(None).cast("binary").alias("bits"))
    return texts.join(mixed.unionByName(plain).groupBy("file", "row").agg(F.collect_list(F.struct("at", "bits")).alias("spans")), ["file", "row"], "left")


def removed(data: bytes, spans: list[dict], width: int) -> np.ndarray:
    """True for each byte that a repeated window covers."""
    edges = np.zeros(len(data) + 1, np.int64)
    for s in spans:
        start, size = s["at"] >> 16, s["at"] & 0xFF
        if s["bits"] is None:  # all of them
            edges[start] += 1
            edges[start + size + width - 1] -= 1
        else:
            at = start + np.flatnonzero(np.unpackbits(np.frombuffer(s["bits"], np.uint8), bitorder="little"))
            edges[at] += 1  # the windows of one piece differ
            edges[at + width] -= 1
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, width: int = 200, shard_bytes: int = SHARD_BYTES, split: int = SPLIT, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if ``texts``).

    A byte is removed if a ``width``-byte string that begins at another place of the corpus, too, covers it; all
    strings are judged on the input. NULL counts as empty; texts shorter than ``width`` stay whole; repeated
    rows are places of their own, so both copies go; a NULL doc_id stays NULL; ties don't arise; further
    columns are ignored; an empty table gives an empty result. Very long texts are taken in stretches that
    overlap by a window, whose cuts change no result. ``width`` is 40 to 270.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    narrow = placed_rows(docs, "__").select(
        F.xxhash64("__file").alias("file"), F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*batch.columns):
                data, held = unpacked(text.as_py()), spans.as_py()
                gone = removed(data, held, width) if held else np.zeros(len(data), bool)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if held else data
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[:1].sum())
                rows.append((doc_id.as_py(), len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    marked = repeated_windows(narrow, width, shard_bytes, split)
    return marked.select("doc_id", "packed", "spans").mapInArrow(run, schema)
