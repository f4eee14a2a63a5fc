"""Cross-tokenizer alignment: token groups of two tokenizers and corpus-wide counts of linked id pairs.

Tokenizer A is byte-level, B marks words; both begin a new token at a space between two characters that
are no white space. A text is cut there into words that are encoded and aligned alone, each once while a
bounded table holds it. The first pass aligns all documents and writes, per task, the distinct pairs with
the number of documents that hold them. Over the distinct pairs of the corpus a minimal perfect hash is
built (``pair_hash``), dense count vectors indexed by it are added in a tree, and the second pass aligns
the documents again and looks the counts up, verifying every key. Where the pairs are more than a block,
the second pass runs once for each block and the sums meet per row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import placed_rows, slices, stored
from tieout.llm.pair_hash import PairHash, bucket_range, built, loaded, summed_counts

BLOCK_KEYS = 2_000_000
HELD_WORDS, HELD_BYTES = 300_000, 16_000_000
HELD_PAIRS = 2_000_000
CUT = re.compile(r"(?<=\S) (?=\S)")
SPACES = re.compile(r"\s ?\s|^\s|\s$|[^\S ]")
RESULT = "file long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Tokenizers:
    """The two vocabularies: ids and byte strings of tokens."""

    def __init__(self, ranks: bytes, pattern: str, model: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = {i: t for t, i in table.items()}
        self.size_a = np.zeros(max(table.values()) + 1, np.int64)
        for t, i in table.items():
            self.size_a[i] = len(t)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_b = np.array([len(p) for p in self.bytes_b], np.int64)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, words: list[str]) -> tuple[list[int], list[int], bool]:
        """(A ids, B ids, whether both join to the words, each behind a space); B slows down on long texts."""
        text = " ".join(words)
        ids_a = self.a.encode_ordinary(" " + text)
        ids_b = list(chain.from_iterable(self.b.encode([" ".join(words[i : i + 300]) for i in range(0, len(words), 300)], num_threads=1)))
        want = (" " + text).encode()
        exact = b"".join(map(self.bytes_a.__getitem__, ids_a)) == want and b"".join(map(self.bytes_b.__getitem__, ids_b)) == want
        return ids_a, ids_b, exact


def words_of(text: str) -> list[str]:
    """Words that both tokenizers encode independently; joined by one space they are the text."""
    return CUT.split(text) if SPACES.search(text) else text.split(" ")


class WordTable:
    """Aligned words: numbers per word, pairs of all words in one row of arrays; emptied when it holds too much.

    The groups are written out only if ``spelled``.
    """

    def __init__(self, tokenizers: Tokenizers, held: int = HELD_WORDS, spelled: bool = True):
        self.tokenizers, self.held, self.spelled = tokenizers, held, spelled
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.groups: list[str] = []
        self.bytes = 0
        self.counts = [np.zeros((0, 4), np.int64)]  # n_a, n_b, n_groups, n_links
        self.pairs = [np.zeros(0, np.int64)]
        self.inexact: set[int] = set()

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        self.counts, self.pairs = [np.concatenate(self.counts)], [np.concatenate(self.pairs)]
        return self.counts[0], self.pairs[0]

    def learn(self, words: set[str]) -> None:
        new = sorted(words - self.ids.keys())
        if not new:
            return
        if self.ids and (len(self.ids) + len(new) > self.held or self.bytes > HELD_BYTES):
            self.clear()
            new = sorted(words)
        plain = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        if plain:
            ids_a, ids_b, exact = self.tokenizers.encode(plain)
            if exact:
                self._align(plain, ids_a, ids_b)
        for w in new:
            if w not in self.ids:
                ids_a, ids_b, exact = self.tokenizers.encode([w])
                if not exact:
                    self.inexact.add(len(self.ids))
                    ids_a, ids_b = [], []
                self._align([w], ids_a, ids_b)

    def _align(self, words: list[str], ids_a: list[int], ids_b: list[int]) -> None:
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.tokenizers.size_a[a]), np.cumsum(self.tokenizers.size_b[b])
        sizes = [len(w.encode()) + 1 for w in words]
        end_w = np.cumsum(sizes)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        start_a = np.concatenate([[0], end_a[:-1]]) if len(a) else end_a
        first, last = np.searchsorted(end_b, start_a, "right"), np.searchsorted(end_b, end_a, "left")
        n = last - first + 1
        base = np.cumsum(n) - n
        partner = np.repeat(first - base, n) + np.arange(n.sum()) if len(a) else np.zeros(0, np.int64)
        links = (np.repeat(a, n) << 32) | b[partner]
        group_a, group_b, group_w = np.searchsorted(end_a, cuts) + 1, np.searchsorted(end_b, cuts) + 1, np.searchsorted(cuts, end_w, "right")
        words_a, words_b = np.searchsorted(end_a, end_w, "right"), np.searchsorted(end_b, end_w, "right")
        words_n = np.concatenate([[0], np.cumsum(n)])[words_a]
        tall = np.stack([words_a, words_b, group_w, words_n], 1)
        self.counts.append(np.diff(tall, axis=0, prepend=np.zeros((1, 4), np.int64)))
        self.pairs.append(links)
        if not self.spelled:
            self.ids.update(zip(words, range(len(self.groups), len(self.groups) + len(words))))
            self.groups += [""] * len(words)
            self.bytes += int(end_w[-1])
            return
        text_a, text_b = list(map(str, ids_a)), list(map(str, ids_b))
        texts, i, j = [], 0, 0
        for x, y in zip(group_a.tolist(), group_b.tolist()):
            texts.append((text_a[i] if x == i + 1 else ",".join(text_a[i:x])) + "|" + (text_b[j] if y == j + 1 else ",".join(text_b[j:y])))
            i, j = x, y
        start = 0
        for w, g, size in zip(words, group_w.tolist(), sizes):
            self.ids[w] = len(self.groups)
            self.groups.append(texts[start] if g == start + 1 else ";".join(texts[start:g]))
            self.bytes += size + len(self.groups[-1])
            start = g


class Slice:
    """The words of some texts as numbers of a word table; texts without tokens have no words."""

    def __init__(self, table: WordTable, texts: list[str | None]):
        split = [words_of(t) if t else [] for t in texts]
        table.learn({w for words in split for w in words})
        ids = [list(map(table.ids.__getitem__, words)) for words in split]
        if table.inexact:
            ids = [[] if not table.inexact.isdisjoint(x) else x for x in ids]
        self.ids = ids
        self.words = np.fromiter(chain.from_iterable(ids), np.int64)
        self.doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        self.size = len(ids)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` (one whole number a word of the table) over the words of each text."""
        total = np.concatenate([[0], np.cumsum(values[self.words])])
        ends = np.searchsorted(self.doc, np.arange(self.size + 1))
        return total[ends[1:]] - total[ends[:-1]]


def word_pairs(counts: np.ndarray, pairs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``words``, pair) for all links of ``words``."""
    ends = np.cumsum(counts[:, 3])
    n = counts[words, 3]
    base = np.cumsum(n) - n
    at = np.repeat(ends[words] - n - base, n) + np.arange(n.sum())
    return np.repeat(np.arange(len(words)), n), pairs[at]


class PairCounts:
    """Documents per pair seen by one task: parts are added together, and given out when they are many."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        both, inverse = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.n = np.bincount(inverse, weights=np.concatenate([self.n, n]), minlength=len(both)).astype(np.int64)
        self.keys = both


def pairs_per_document(part: Slice, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(pair, documents that hold it) of some texts."""
    counts, pairs = table.arrays()
    most = len(table.groups) + 1
    once = np.unique(part.doc * most + part.words)
    which, keys = word_pairs(counts, pairs, once % most)
    distinct, inverse = np.unique(keys, return_inverse=True)
    held = np.unique((once // most)[which] * max(1, len(distinct)) + inverse)
    return distinct, np.bincount(held % max(1, len(distinct)), minlength=len(distinct))


def align(docs: DataFrame, ranks_path: str, pattern: str, model_path: str, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    NULL and empty texts, and texts whose tokens don't join to a space and the text (those with a word mark
    of B as a character), have zeros and an empty digest and count in no pair. Repeated rows are documents of
    their own; a NULL doc_id stays NULL; ties of the highest count are all best; further columns are
    ignored; an empty table gives an empty result. Very long texts are aligned whole, also without spaces.
    """
    with open(ranks_path, "rb") as f, open(model_path, "rb") as g:
        vocabularies = f.read(), pattern, g.read()
    sent = docs.sparkSession.sparkContext.broadcast(vocabularies)
    narrow = placed_rows(docs, "__").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("__file").alias("file"), F.col("__row").alias("row")
    )

    def collect_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, waiting, size = shared_table(sent.value, False), PairCounts(), [], 0
        for batch in batches:
            for _, texts in slices(batch):
                found = pairs_per_document(Slice(table, texts), table)
                waiting.append(found)
                size += len(found[0])
                if size > HELD_PAIRS:
                    seen.add(*map(np.concatenate, zip(*waiting)))
                    waiting, size = [], 0
                if len(seen.keys) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys), pa.array(seen.n)], names=["key", "n"])
                    seen = PairCounts()
        if waiting:
            seen.add(*map(np.concatenate, zip(*waiting)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys), pa.array(seen.n)], names=["key", "n"])

    partial = stored(narrow.select("doc_id", "text").mapInArrow(collect_pairs, "key long, n long"))
    distinct = stored(partial.select("key").distinct())
    levels, buckets, blocks = built(distinct, distinct.count(), block_keys)
    spark = docs.sparkSession
    highest = np.zeros(len(Tokenizers(*vocabularies).size_a), np.int64)

    def counted(block: int) -> tuple[PairHash, np.ndarray]:
        hashed = loaded(levels, buckets, *bucket_range(block, blocks, buckets))
        counts = summed_counts(partial, hashed)
        np.maximum.at(highest, hashed.keys >> 32, counts)
        return hashed, counts

    if blocks == 1:
        return looked_up(narrow, sent, spark.sparkContext.broadcast((*counted(0), highest)), True).drop("file", "row")
    for block in range(blocks):  # the highest count of each A id over all blocks; the driver holds one block at a time
        counted(block)
    every = None
    for block in range(blocks):
        held = spark.sparkContext.broadcast((*counted(block), highest))
        one = stored(looked_up(narrow, sent, held, block == 0))
        held.destroy()
        every = one if every is None else every.unionByName(one)
    whole = [F.max(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    return every.groupBy("file", "row").agg(*whole, *sums, F.max("groups_sha256").alias("groups_sha256")).drop("file", "row")


_TABLES: dict[tuple[int, bool], WordTable] = {}


def shared_table(vocabularies: tuple[bytes, str, bytes], spelled: bool) -> WordTable:
    """The word table of this worker process, kept from task to task."""
    key = hash(vocabularies), spelled
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = WordTable(Tokenizers(*vocabularies), spelled=spelled)
    return _TABLES[key]


def looked_up(narrow: DataFrame, sent, counted, first: bool) -> DataFrame:
    """The documents aligned again: counts of the pairs of one block, everything else if it is the ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, counts, highest = counted.value
        table = shared_table(sent.value, True)
        scored, best, total, filled = None, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            at = 0
            for ids, texts in slices(batch):
                part = Slice(table, texts)
                sizes, pairs = table.arrays()
                if scored is not table.ids:
                    scored, best, total, filled = table.ids, best[:0], total[:0], 0
                if filled < len(sizes):  # words that came since
                    which, keys = word_pairs(sizes, pairs, np.arange(filled, len(sizes)))
                    index = hashed.index(keys)
                    n = np.where(index >= 0, counts[np.maximum(index, 0)] if len(counts) else 0, 0)
                    top = (n == highest[keys >> 32]) & (index >= 0)
                    more = len(sizes) - filled
                    best = np.concatenate([best, np.bincount(which, weights=top, minlength=more).astype(np.int64)])
                    total = np.concatenate([total, np.bincount(which, weights=n, minlength=more).astype(np.int64)])
                    filled = len(sizes)
                rest: list = [part.sums(sizes[:, k]) for k in range(4)] if first else [pa.nulls(part.size, pa.int64())] * 4
                digests = [hashlib.sha256(";".join(map(table.groups.__getitem__, x)).encode()).hexdigest() if x else "" for x in part.ids] if first else [None] * part.size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2)[at : at + part.size], batch.column(3)[at : at + part.size], pa.array(ids, pa.int64()),
                        *[pa.array(x, pa.int64()) for x in rest], pa.array(part.sums(best)), pa.array(part.sums(total)), pa.array(digests, pa.string()),
                    ],
                    names=["file", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )
                at += part.size

    return narrow.mapInArrow(run, RESULT)
