"""Token counts by the whole-token shortcut.

The vocabulary has no piece with a word mark after another character, so no merge crosses the place
where a new word mark begins. A text therefore splits at spaces into pre-tokens that are encoded
independently. Before any text is read, every vocabulary string that starts with a word mark is
encoded alone; those that come back as exactly one token are proven whole tokens and are counted by
lookup. Only the other pre-tokens are merged, once for each distinct one held in a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import slices

MARK = "▁"
#: Characters of the longest pre-token that is kept from slice to slice.
LONGEST = 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_whole long"


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_marks(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """True if no piece holds a word mark after another character, the premise of splitting at spaces."""
    return all(MARK not in processor.id_to_piece(i).lstrip(MARK) for i in range(processor.get_piece_size()))


def whole_tokens(processor: sentencepiece.SentencePieceProcessor) -> frozenset[str]:
    """Words (without their leading mark) that are proven to encode as one token."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    words = [(i, p[1:]) for i, p in enumerate(pieces) if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    encoded = processor.encode([w for _, w in words])
    return frozenset(w for (i, w), ids in zip(words, encoded) if ids == [i])


class TokenCounter:
    """Counts tokens; ``held`` bounds the table of merged pre-tokens, which is emptied when full.

    Pre-tokens of more than LONGEST characters (texts without spaces) are kept for one slice only, so the table
    is bounded in bytes, too.
    """

    def __init__(self, processor, whole: frozenset[str], held: int = 400_000):
        self.processor, self.whole, self.held = processor, whole, held
        self.merged: dict[str, int] = {}
        self.long: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        long = [w for w in words if len(w) > LONGEST]
        self.long = dict(zip(long, map(len, self.processor.encode(long, num_threads=1)))) if long else {}
        if len(self.merged) + len(words) > self.held:
            self.merged = {}
        new = [w for w in words if w not in self.merged and len(w) <= LONGEST]
        self.merged.update(zip(new, map(len, self.processor.encode(new, num_threads=1))))

    def _size(self, word: str) -> int:
        return self.long[word] if len(word) > LONGEST else self.merged[word]

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(tokens, of these whole tokens) of each text."""
        split = [pre_tokens(t) for t in texts]
        rest = [[w for w in words if w not in self.whole] for words, _ in split]
        self._learn({w for words in rest for w in words})
        size = self._size if self.long else self.merged.__getitem__
        return [
            (len(words) - len(r) + sum(map(size, r)) + (len(self.processor.encode(" " * (tail - 1))) if tail > 1 else tail), len(words) - len(r))
            for (words, tail), r in zip(split, rest)
        ]


def pre_tokens(text: str | None) -> tuple[list[str], int]:
    """Pre-tokens without their last leading mark (earlier marks as spaces), and the number of marks at the end."""
    if not text:
        return [], 0
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words, 0
    out, marks = [], 0
    for w in words:
        if w:
            out.append(" " * marks + w)
            marks = 0
        else:
            marks += 1
    return out, marks


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, n_whole, over_limit (n_tokens > ``limit``).

    NULL and empty texts have no tokens. Repeated rows give repeated results; a NULL doc_id stays NULL;
    further columns of ``docs`` are ignored; an empty table gives an empty result. The model file is
    read on the driver and sent to the tasks as bytes.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    processor = load(model)
    if not splits_at_marks(processor):
        raise ValueError("this vocabulary has pieces that span words")
    whole = whole_tokens(processor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(load(model), whole)
        for batch in batches:
            for ids, texts in slices(batch):
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                        pa.array([a for a, _ in n], pa.int64()),
                        pa.array([b for _, b in n], pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "n_whole"],
                )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
