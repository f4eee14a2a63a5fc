"""A byte-level convolutional network in numpy that scores whole documents.

Bytes have learned vectors; learned filters slide over them. Positions are pooled by their largest
activation over chunks of two half-chunks, each half shared by two chunks, so that chunks overlap and
cover the whole document. Mean, largest and smallest chunk activations feed one hidden layer and one
probability. Training uses a bounded sample of labelled rows and plain gradient steps (Adam).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import slices

WIDTH = 8
STRIDE = 2
HALF = 256  # bytes of a half-chunk
VECTOR = 8
FILTERS = 32
HIDDEN = 16
FOLDS = 5
#: Half-chunks whose activations are held at once.
SEGMENT = 128
SCHEMA = "doc_id long, score double"


class Network(NamedTuple):
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 3 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def start(seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *size: rng.standard_normal(size).astype(np.float32)
    return Network(
        draw(256, VECTOR) * 0.5, draw(WIDTH * VECTOR, FILTERS) / np.sqrt(WIDTH * VECTOR), np.zeros(FILTERS, np.float32),
        draw(3 * FILTERS, HIDDEN) / np.sqrt(3 * FILTERS), np.zeros(HIDDEN, np.float32), draw(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1, np.float32),
    )


def layout(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """(bytes of all texts, each padded to half-chunks and closed by one of zeros; half-chunks of each, two at least)."""
    halves = [max(2, -(-len(t) // HALF)) for t in texts]
    data = b"".join(t.ljust((n + 1) * HALF, b"\0") for t, n in zip(texts, halves))
    return np.frombuffer(data, np.uint8), halves


def _windows(vectors: np.ndarray) -> np.ndarray:
    """Windows of WIDTH vectors, STRIDE apart, that start in all but the last half-chunk."""
    n = (len(vectors) - HALF) // STRIDE
    step = vectors.strides[0]
    return np.ascontiguousarray(as_strided(vectors, (n, WIDTH * VECTOR), (STRIDE * step, vectors.strides[1])))


def half_peaks(net: Network, data: np.ndarray) -> np.ndarray:
    """The largest activation of each filter in each half-chunk but the last; none is below zero."""
    total = len(data) // HALF - 1
    out = np.empty((total, FILTERS), np.float32)
    for a in range(0, total, SEGMENT):
        b = min(total, a + SEGMENT)
        active = _windows(net.vectors[data[a * HALF : (b + 1) * HALF]]) @ net.filters
        out[a:b] = active.reshape(b - a, HALF // STRIDE, FILTERS).max(1)
    return np.maximum(out + net.bias, 0)


def summary(peaks: np.ndarray, halves: list[int]) -> np.ndarray:
    """Mean, largest and smallest chunk activation of each document."""
    chunks = np.maximum(peaks[:-1], peaks[1:])
    starts = np.cumsum([0] + [n + 1 for n in halves[:-1]])
    # a document's n half-chunks make n - 1 chunks; the two after them reach into the closing zeros
    keep = np.concatenate([np.arange(s, s + n - 1) for s, n in zip(starts, halves)])
    own = chunks[keep]
    at = np.cumsum([0] + [n - 1 for n in halves[:-1]])
    count = np.array([n - 1 for n in halves], np.float32)[:, None]
    return np.concatenate([np.add.reduceat(own, at) / count, np.maximum.reduceat(own, at), np.minimum.reduceat(own, at)], axis=1)


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    data, halves = layout(texts)
    inner = np.tanh(summary(half_peaks(net, data), halves) @ net.hidden + net.hidden_bias)
    return 1 / (1 + np.exp(-(inner @ net.out + net.out_bias[0]).astype(np.float64)))


def _gradient(net: Network, texts: list[bytes], wanted: np.ndarray, weight: np.ndarray) -> tuple[float, Network]:
    data, halves = layout(texts)
    total = len(data) // HALF - 1
    windows = _windows(net.vectors[data])
    active = (windows @ net.filters).reshape(total, HALF // STRIDE, FILTERS)
    where = active.argmax(1)
    peaks = np.maximum(np.take_along_axis(active, where[:, None, :], 1)[:, 0] + net.bias, 0)
    del active
    starts = np.cumsum([0] + [n + 1 for n in halves[:-1]])
    pooled, picks = np.empty((len(texts), 3 * FILTERS), np.float32), []
    for d, (s, n) in enumerate(zip(starts, halves)):
        first, second = peaks[s : s + n - 1], peaks[s + 1 : s + n]
        chunks = np.maximum(first, second)
        high, low = chunks.argmax(0), chunks.argmin(0)
        picks.append((first >= second, high, low))
        f = np.arange(FILTERS)
        pooled[d] = np.concatenate([chunks.mean(0), chunks[high, f], chunks[low, f]])
    inner = np.tanh(pooled @ net.hidden + net.hidden_bias)
    p = 1 / (1 + np.exp(-(inner @ net.out + net.out_bias[0])))
    loss = float(-(weight * np.log(np.where(wanted > 0, p, 1 - p) + 1e-9)).sum())
    d_out = (weight * (p - wanted)).astype(np.float32)
    d_inner = d_out[:, None] * net.out * (1 - inner**2)
    d_pooled = d_inner @ net.hidden.T
    d_peaks = np.zeros_like(peaks)
    f = np.arange(FILTERS)
    for d, (s, n) in enumerate(zip(starts, halves)):
        left, high, low = picks[d]
        d_chunks = np.repeat(d_pooled[d, None, :FILTERS] / (n - 1), n - 1, 0)
        d_chunks[high, f] += d_pooled[d, FILTERS : 2 * FILTERS]
        d_chunks[low, f] += d_pooled[d, 2 * FILTERS :]
        d_peaks[s : s + n - 1] += np.where(left, d_chunks, 0)
        d_peaks[s + 1 : s + n] += np.where(left, 0, d_chunks)
    d_peaks[peaks <= 0] = 0
    rows = (np.arange(total)[:, None] * (HALF // STRIDE) + where).reshape(-1)
    grads, filt = d_peaks.reshape(-1), np.tile(f, total)
    used = np.flatnonzero(grads)
    rows, grads, filt = rows[used], grads[used], filt[used]
    d_filters = np.zeros((FILTERS, WIDTH * VECTOR), np.float32)
    d_vectors = np.zeros((256, VECTOR), np.float32)
    for k in range(FILTERS):
        own = filt == k
        at, g = rows[own], grads[own]
        d_filters[k] = g @ windows[at]
        letters = data[(at * STRIDE)[:, None] + np.arange(WIDTH)]
        for j in range(WIDTH):
            d_vectors += np.bincount(letters[:, j], g, 256).astype(np.float32)[:, None] * net.filters[j * VECTOR : (j + 1) * VECTOR, k]
    return loss, Network(d_vectors, d_filters.T, d_peaks.sum(0), pooled.T @ d_inner, d_inner.sum(0), inner.T @ d_out, d_out.sum(keepdims=True))


def train(texts: list[bytes], labels: list[int], epochs: int = 10, batch: int = 64, rate: float = 0.008, longest: int = 16 * HALF, seed: int = 1) -> Network:
    """Adam on class-balanced log loss; in each epoch a long text takes part with a random stretch of ``longest`` bytes."""
    rng, net = np.random.default_rng(seed), start(seed)
    if not texts or len(set(labels)) < 2:
        return net
    wanted = np.array(labels, np.float32)
    share = np.where(wanted > 0, wanted.mean(), 1 - wanted.mean())
    steps, moment, square = 0, [np.zeros_like(x) for x in net], [np.zeros_like(x) for x in net]
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            mine = order[a : a + batch]
            parts = []
            for i in mine:
                at = int(rng.integers(0, max(1, len(texts[i]) - longest + 1)))
                parts.append(texts[i][at : at + longest])
            _, gradient = _gradient(net, parts, wanted[mine], (0.5 / share[mine] / len(mine)).astype(np.float32))
            steps += 1
            now = rate * (1 - steps / (total + 1))
            for k, g in enumerate(gradient):
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
            net = Network(*((x - now * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-8)).astype(np.float32) for x, m, s in zip(net, moment, square)))
    return net


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, longest: int = 200_000) -> Network:
    """A network learned from about ``sample_rows`` labelled rows outside fold 0, spread by hash of doc_id.

    Rows with a NULL id, text or label and texts of more than ``longest`` characters are not used; of rows with one doc_id each counts.
    """
    known = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    n = max(1, known.count())
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < sample_rows).limit(2 * sample_rows)
    ids = {r[0]: r[1] for r in chosen.toLocalIterator()}
    listed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter((F.length("text") <= longest) & F.col("doc_id").isin(list(ids)))
    rows = sorted((r[0], r[1]) for r in listed.limit(4 * sample_rows).toLocalIterator())
    return train([t.encode() for _, t in rows], [ids[d] for d, _ in rows])


def score(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    The score comes from the text alone; NULL and empty texts score as a chunk of zero bytes. It is
    rounded to six places, so that it does not depend on which rows share a batch. Repeated rows give
    repeated results; a NULL doc_id stays NULL and is not held out; further columns are ignored; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch):
                p = probabilities(net, [(t or "").encode() for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.round(p, 6), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def text_scores(text: Column, net: Network) -> Column:
    """The score as a column, for filters that keep all columns."""

    @F.pandas_udf("double")
    def one(texts):
        values = texts.tolist()
        out, part, held = [], [], 0
        for t in values:
            raw = (t or "").encode()
            if part and held + len(raw) > 2_000_000:
                out.append(probabilities(net, part))
                part, held = [], 0
            part.append(raw)
            held += len(raw)
        if part:
            out.append(probabilities(net, part))
        return pd.Series(np.round(np.concatenate(out), 6) if out else [], dtype="float64")

    return one(text.cast("string"))
