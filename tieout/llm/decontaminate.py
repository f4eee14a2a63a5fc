"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with every run of other characters than letters and digits as one
space. A test item of m characters may occur with k = m // ``rate`` edits. Cut into k + 1 pieces, at
least one piece occurs unchanged (k edits spoil k pieces at most). An automaton finds every piece
hit in one pass over a document; the hits of an item give windows. Of twice as many, half as long
pieces at least k + 2 must occur in the window, which drops most chance hits; Myers' bit-parallel
distance decides the other windows, with one machine word as wide as the item.

The test items are a stated query set: they are taken in blocks of bounded size, each block sent to
the tasks and held against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import slices

RATE = 12
BLOCK_CHARS = 1_000_000
_GAPS = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, edits int, item_chars int, match_end long"

Item = tuple[int | None, str]


def normal(text: str | None) -> str:
    """Words in lower case, one space around each."""
    return _GAPS.sub(" ", f" {text or ''} ".lower())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 near-equal pieces of an item."""
    n = k + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, masks: dict[str, int], text: str, start: int, stop: int, k: int) -> tuple[int, int] | None:
    """(least edits, end of the first such match) of the item in text[start:stop], if at most ``k``."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    get = masks.get
    for at in range(start, stop):
        eq = get(text[at], 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return (best, end) if best <= k else None


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item], rate: int = RATE):
        self.items, self.masks, self.halves = [], [], []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            item = normal(raw)
            if not item.strip():
                continue
            k = len(item) // rate
            at = len(self.items)
            self.items.append((item_id, item, k))
            masks: dict[str, int] = {}
            for i, c in enumerate(item):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks.append(masks)
            self.halves.append([piece for _, piece in pieces(item, 2 * k + 1)])
            for offset, piece in pieces(item, k):
                places.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Merged windows of the normalised text by item."""
        out: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for item, offset in where:
                _, content, k = self.items[item]
                start = last - size + 1 - offset
                low, high = max(0, start - k), min(len(text), start + len(content) + k)
                held = out.setdefault(item, [])
                if held and low <= held[-1][1]:
                    held[-1][0], held[-1][1] = min(held[-1][0], low), max(held[-1][1], high)
                else:
                    held.append([low, high])
        return out

    def find(self, raw: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, edits, item length, end of the match) of every item in the text, with its least edits."""
        if self.empty or not raw:
            return []
        text, out = normal(raw), []
        for item, spans in self.windows(text).items():
            item_id, content, k = self.items[item]
            best = None
            for low, high in spans:
                if sum(text.find(half, low, high) >= 0 for half in self.halves[item]) < k + 2:
                    continue
                exact = text.find(content, low, high)  # a hit without edits needs no table
                found = (0, exact + len(content)) if exact >= 0 else myers(content, self.masks[item], text, low, high, k)
                if found and (best is None or found < best):
                    best = found
            if best:
                out.append((item_id, best[0], len(content), best[1]))
        return out

    def any(self, raw: str | None) -> bool:
        return bool(self.find(raw))


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The items, streamed, in blocks of at most ``block_chars`` characters (or one item)."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        size = len(row[1] or "")
        if block and held + size > block_chars:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += size
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: int = RATE) -> DataFrame:
    """doc_id, item_id, edits, item_chars and match_end (in the normalised text) for each document and item it holds.

    Each item counts once per row of ``docs``, with its least number of edits and the first end
    of such a match. NULL and empty texts and items (also those without letters or digits) match
    nothing. Repeated rows and items give repeated results; NULL ids stay NULL; an empty table on
    either side gives an empty result; further columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for n, block in enumerate(item_blocks(benchmark)):
        found = narrow.mapInArrow(_finder(block, rate), SCHEMA)
        out = found if n == 0 else out.unionByName(found)
    return out


def _finder(block: list[Item], rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for batch in batches:
            for ids, texts in slices(batch):
                rows = [(doc_id, *hit) for doc_id, text in zip(ids, texts) for hit in matcher.find(text)]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                names = ["doc_id", "item_id", "edits", "item_chars", "match_end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def is_contaminated(text: Column, block: list[Item], rate: int = RATE) -> Column:
    @F.pandas_udf("boolean")
    def flag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block, rate)
        for texts in batches:
            yield texts.map(matcher.any, na_action=None).astype(bool)

    return flag(text.cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: int = RATE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows without text stay."""
    for block in item_blocks(benchmark):
        docs = docs.filter(~is_contaminated(F.col("text"), block, rate))
    return docs
