"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly.

A word, with a blank at either side, gives its byte n-grams of three to five
bytes, hashed to rows of an embedding. A passage of eight words is the mean of its
rows; a softmax over two classes scores it. Misspelt and derived words share
n-gram rows with known ones. A text's score is that of its highest passage, so
a long text isn't thinned out; training follows suit: after a first pass over
all passages, a toxic text teaches by its highest passages alone.

A word that repeats the one before counts once. Labels are read from a bounded
sample of rows outside the held-out fold, which one task fits; the driver gets
the weights. Rows of a null id or label teach nothing, and of repeated rows in
``labels`` the highest label holds. Null and empty texts, and those without
words, score as a passage without n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.spark_io import bounded_sample, doc_bucket, with_fields

SIZES = (3, 4, 5)
BUCKET_BITS = 18
DIMENSIONS = 8
PASSAGE = 8
#: Subwords a passage's mean is taken over at least, so that a lone word weighs as it does in a passage.
LEAST_SUBWORDS = 60
#: Bounds of the training sample: rows of each label, and code points of a row.
SAMPLE_ROWS = 3000
SAMPLE_LENGTH = 6_000
THRESHOLD = 0.3
#: Passages worked on at a time in training.
STRETCH = 10_000

_KEYS = (kernels.mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, index of the word) of n-grams, a pair of arrays for each size."""
    sizes = ends - starts + 2
    base = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    at = np.arange(len(word)) - base[word]
    padded = np.full(len(word), 0x20, dtype=np.uint8)
    inner = (at > 0) & (at < sizes[word] - 1)
    padded[inner] = kernels._LOWER[data[(starts[word] + at - 1)[inner]]]
    keys = _KEYS[padded]
    left = sizes[word] - at
    for n in SIZES:
        if len(keys) < n:
            return
        h = np.full(len(keys) - n + 1, n * 0x3C6EF372 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h += keys[k : k + len(h)] * _PLACES[k]
            h ^= h >> np.uint32(15)
        whole = left[: len(h)] >= n
        yield (h[whole] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS), word[: len(h)][whole]


def changing_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as ``kernels.word_spans`` has them, without those that repeat the word just before."""
    starts, ends, first = kernels.word_spans(data, offsets)
    if len(starts) < 2:
        return starts, ends, first
    same = np.zeros(len(starts), dtype=bool)
    hashes = kernels.span_hashes(data, starts, ends)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][np.diff(first) > 0]] = False
    kept = np.concatenate([[0], np.cumsum(~same)])
    return starts[~same], ends[~same], kept[first]


@dataclass
class ToxicityModel:
    weights: np.ndarray  # of each bucket: its embedding times the difference of the softmax's rows
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text."""
        starts, ends, first = changing_words(data, offsets)
        out = np.full(len(offsets) - 1, self.bias)
        if len(starts):
            total, count = np.zeros(len(starts)), np.zeros(len(starts))
            for bucket, word in subwords(data, starts, ends):
                total += np.bincount(word, weights=self.weights[bucket], minlength=len(starts))
                count += np.bincount(word, minlength=len(starts))
            heads, owner = passages(first)
            logits = self.bias + np.add.reduceat(total, heads) / np.maximum(np.add.reduceat(count, heads), LEAST_SUBWORDS)
            full = np.flatnonzero(np.diff(first) > 0)
            out[full] = np.maximum.reduceat(logits, np.searchsorted(owner, full))
        return 1 / (1 + np.exp(-out))


def passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of passages and the text of each; first holds the first word of each text."""
    words = np.diff(first)
    counts = -(-words // PASSAGE)
    owner = np.repeat(np.arange(len(words)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][owner] + nth * PASSAGE, owner


def fit(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, batch: int = 64, rate: float = 4.0, seed: int = 7) -> ToxicityModel:
    """Stochastic gradient descent over passages; embedding and softmax learn together."""
    rng = np.random.default_rng(seed)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends, first = changing_words(data, offsets)
    positive = float(np.mean(labels)) if len(labels) else 0.0
    if not len(starts) or positive in (0.0, 1.0):
        return ToxicityModel(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 4.0 * (positive - 0.5))
    heads, owner = passages(first)
    stops = np.append(heads[1:], len(starts))
    buckets, sizes = [], np.zeros(len(heads), dtype=np.int64)
    for lo in range(0, len(heads), STRETCH):  # passage by passage; only the buckets are held for all of them
        at, to = heads[lo], stops[min(lo + STRETCH, len(heads)) - 1]
        pairs = list(subwords(data, starts[at:to], ends[at:to]))
        own = np.concatenate([w for _, w in pairs])
        order = np.argsort(own, kind="stable")
        buckets.append(np.concatenate([b for b, _ in pairs])[order].astype(np.int32))
        sizes[lo : lo + STRETCH] = np.diff(np.append(np.searchsorted(own[order], heads[lo : lo + STRETCH] - at), len(own)))
    bucket = np.concatenate(buckets)
    del buckets
    edges = np.concatenate([[0], np.cumsum(sizes)])
    parts = np.maximum(sizes, LEAST_SUBWORDS)
    y = labels[owner].astype(np.float64)
    # few toxic texts weigh more, so that their words are learnt in the same number of rounds
    weight = np.where(y == 1, np.clip(500 / max(1.0, labels.sum()), 1.0, 6.0), 1.0)
    embedding = rng.normal(0, 0.02, (1 << BUCKET_BITS, DIMENSIONS))
    softmax = rng.normal(0, 0.5, (2, DIMENSIONS))
    bias = np.zeros(2)
    live = np.flatnonzero(sizes > 0)
    epochs = epochs or int(np.clip(500_000 // max(1, len(live)), 6, 40))
    for epoch in range(epochs):
        if epoch:  # of a toxic text, the highest passage and those as good as sure
            logit = _logits(embedding, softmax, bias, bucket, edges, sizes, parts)
            top = np.zeros(len(heads), dtype=bool)
            lift = np.lexsort((-logit, owner))
            top[lift[np.concatenate([[True], owner[lift][1:] != owner[lift][:-1]])]] = True
            live = np.flatnonzero((sizes > 0) & ((y == 0) | top | (logit > 4)))
        step = rate * (1 - epoch / epochs)
        rng.shuffle(live)
        for at in range(0, len(live), batch):
            rows = np.sort(live[at : at + batch])
            size = sizes[rows]
            cut = np.cumsum(size) - size
            ids = bucket[np.repeat(edges[rows] - cut, size) + np.arange(size.sum())]
            direction = softmax[1] - softmax[0]
            used, inverse = np.unique(ids, return_inverse=True)
            z = (embedding[used] @ direction)[inverse]
            p = 1 / (1 + np.exp(-(np.add.reduceat(z, cut) / parts[rows] + bias[1] - bias[0])))
            delta = (p - y[rows]) * weight[rows]
            pull = np.bincount(inverse, weights=np.repeat(delta / parts[rows], size), minlength=len(used))
            grad_w = pull @ embedding[used]
            embedding[used] -= step * pull[:, None] * direction
            softmax -= 0.01 * np.clip(np.stack([-grad_w, grad_w]), -1, 1)
            push = delta.sum()
            bias -= 0.002 * step * np.array([-push, push])
    return ToxicityModel((embedding @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0]))


def _logits(embedding, softmax, bias, bucket, edges, sizes, parts) -> np.ndarray:
    lift = (embedding @ (softmax[1] - softmax[0])).astype(np.float32)
    out = np.full(len(sizes), bias[1] - bias[0])
    for lo in range(0, len(sizes), STRETCH):
        own = sizes[lo : lo + STRETCH]
        full = lo + np.flatnonzero(own > 0)
        if len(full):
            run = lift[bucket[edges[lo] : edges[lo + len(own)]]]
            out[full] += np.add.reduceat(run, edges[full] - edges[lo], dtype=np.float64) / parts[full]
    return out


def fit_on_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS, length: int = SAMPLE_LENGTH) -> ToxicityModel:
    """A model of labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & (doc_bucket("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # twice the rows wanted are picked by id and broadcast, so that no text is shuffled but the sample's
    picked = F.broadcast(bounded_sample(known, "toxic", "doc_id", 2 * rows))
    rows_ = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= length)).join(picked, "doc_id")
    sample = bounded_sample(rows_, "toxic", "doc_id", rows).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    # the bounded sample is one task's work, so the driver holds the weights alone
    told = sample.repartition(1).mapInArrow(kernels.tidy(_fit_batches), "weights binary, bias double").collect()
    return ToxicityModel(np.frombuffer(told[0].weights, dtype=np.float32), told[0].bias) if told else fit([], np.zeros(0))


def _fit_batches(batches) -> Iterator[pa.RecordBatch]:
    found = sorted((i, t.encode(), y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns)))
    if found:
        model = fit([t for _, t, _ in found], np.array([y for _, _, y in found]))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs with ``score``; a column by that name is replaced."""
    kept = docs.drop("score")
    at, names = kept.columns.index(text_col), [*kept.columns, "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = kernels.utf8(batch.column(at))
            scores = np.zeros(batch.num_rows)
            for lo, hi in kernels.chunks(offsets):
                part = offsets[lo : hi + 1]
                scores[lo:hi] = own.score(data[part[0] : part[-1]], part - part[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=names)

    return kept.mapInArrow(kernels.tidy(run), with_fields(kept.schema, score="double"))
