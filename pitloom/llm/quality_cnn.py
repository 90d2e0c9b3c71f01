"""Operator 9: a byte-level convolutional network in numpy as quality classifier.

Bytes are embedded, filters of ``WIDTH`` bytes run over the whole document at every ``STRIDE``-th byte, and their
rectified responses are max-pooled over overlapping chunks of ``CHUNK`` bytes (each begins half a chunk after the one
before). The mean of all chunks' pooled vectors goes through one hidden layer to one probability. Every byte counts,
however long the text.

Training is numpy too, on a bounded sample: the ``SAMPLE`` labelled rows of lowest hash of either class,
``SAMPLE_CHUNKS`` chunks of each, spread evenly over the text. The log-odds are then calibrated on rows set aside,
weighted as if both classes were equally common. Scores come from the text alone.

Defined results: a null text scores as an empty one (one chunk of padding); without two classes among the labels the
score is the labelled share of class 1, or 0.5 without labels; several labels of one id count as their lowest; null
ids or labels are no labels; rows, their order and their other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitloom.llm.common import ship

CHUNK, STRIDE, WIDTH = 256, 2, 8
EMBEDDING, FILTERS, HIDDEN = 4, 56, 24
PAD = 256
#: The bound of the training sample: documents of each class, and chunks of each.
SAMPLE, SAMPLE_CHUNKS = 2500, 4
EPOCHS, BATCH, RATE, SEED = 10, 64, 5e-3, 2
THRESHOLD = 0.3
#: Share of pooled filters that a training step leaves out: else filters learn the sample's own words.
DROPOUT = 0.4
#: One sampled document in so many takes no part in training and sets the scale of the log-odds.
CALIBRATION = 5

_BLOCK = CHUNK // 2
_STEPS = _BLOCK // STRIDE
_TAIL = WIDTH // STRIDE
#: Bytes of text in one matrix product; its temporary arrays take some 300 times as much.
_SLICE = 1 << 16


class Network:
    """Weights, and the passes over padded bytes."""

    def __init__(self, base_rate: float | None = None, rng: np.random.Generator | None = None):
        self.base_rate = base_rate
        self.scale, self.shift = 1.0, 0.0
        if rng is not None:
            f = np.float32
            self.embedding = rng.normal(0, 0.5, (PAD + 1, EMBEDDING)).astype(f)
            self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * EMBEDDING), (WIDTH * EMBEDDING, FILTERS)).astype(f)
            self.offset = np.zeros(FILTERS, f)
            self.hidden = rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(f)
            self.hidden_offset = np.zeros(HIDDEN, f)
            self.out = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(f)
            self.out_offset = np.zeros(1, f)

    NAMES = ("embedding", "filters", "offset", "hidden", "hidden_offset", "out", "out_offset")

    def responses(self, padded: np.ndarray) -> np.ndarray:
        """Filter responses at every ``STRIDE``-th byte; ``padded`` ends in WIDTH bytes of padding."""
        emb = self.embedding[padded]
        step = emb.strides[0]
        n = (len(padded) - WIDTH) // STRIDE
        patches = np.lib.stride_tricks.as_strided(
            emb, (n, WIDTH * EMBEDDING), (step * STRIDE, emb.strides[1]), writeable=False
        )
        return np.ascontiguousarray(patches) @ self.filters + self.offset

    def block_maxima(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rectified maxima over every half chunk of every text, and each text's number of half chunks."""
        # WIDTH bytes of padding at least end a text, so no filter sees two texts.
        blocks = np.array([(len(x) + WIDTH + _BLOCK - 1) // _BLOCK for x in raw], np.int64)
        flat = np.full(int(blocks.sum()) * _BLOCK + WIDTH, PAD, np.int16)
        at = np.cumsum(blocks) - blocks
        for x, a in zip(raw, at.tolist(), strict=True):
            flat[a * _BLOCK : a * _BLOCK + len(x)] = np.frombuffer(x, np.uint8)
        maxima = np.empty((int(blocks.sum()), FILTERS), np.float32)
        per = _SLICE // _BLOCK
        last = np.zeros(len(maxima), bool)
        last[at + blocks - 1] = True
        for a in range(0, len(maxima), per):
            b = min(len(maxima), a + per)
            y = self.responses(flat[a * _BLOCK : b * _BLOCK + WIDTH]).reshape(b - a, _STEPS, FILTERS)
            y[last[a:b], -_TAIL:] = 0
            maxima[a:b] = y.max(axis=1)
        return np.maximum(maxima, 0), blocks

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.base_rate is not None:
            return np.full(len(texts), self.base_rate)
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        maxima, blocks = self.block_maxima(raw)
        ends = np.cumsum(blocks)
        # A chunk is two neighbouring half chunks; a text of one half chunk is one chunk.
        pairs = np.maximum(maxima, np.vstack([maxima[1:], maxima[-1:]]))
        single = blocks == 1
        pairs[ends - 1] = np.where(single[:, None], maxima[ends - 1], 0)
        sums = np.add.reduceat(pairs.astype(np.float64), ends - blocks, axis=0)
        pooled = (sums / np.maximum(blocks - 1, 1)[:, None]).astype(np.float32)
        return self.probability(pooled)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum(pooled @ self.hidden + self.hidden_offset, 0)
        logit = (h @ self.out + self.out_offset[0]).astype(np.float64)
        return 1 / (1 + np.exp(-(self.scale * logit + self.shift)))

    def calibrate(self, texts: list[list[bytes]], labels: np.ndarray) -> None:
        """Scale and shift of the log-odds (Platt) by Newton steps, with a small ridge towards no change.

        Both classes weigh the same, so a score below 0.3 says that the text is over twice as likely in class 0.
        """
        if len(labels) == 0 or labels.min() == labels.max():
            return
        maxima, blocks = self.block_maxima([c for doc in texts for c in doc])
        starts = np.cumsum(blocks) - blocks
        chunk = np.maximum.reduceat(maxima, starts, axis=0)
        n = np.array([len(doc) for doc in texts])
        pooled = np.add.reduceat(chunk, np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
        p = np.clip(self.probability(pooled), 1e-9, 1 - 1e-9)
        x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], axis=1)
        w = np.array([1.0, 0.0])
        weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
        for _ in range(30):
            q = 1 / (1 + np.exp(-x @ w))
            gradient = x.T @ (weight * (q - labels)) + 0.1 * (w - [1.0, 0.0])
            hessian = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(2)
            w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        self.scale, self.shift = float(w[0]), float(w[1])


def train(samples: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted to documents' chunks by Adam on the log loss; deterministic for given rows in given order."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Network(base_rate=float(labels.mean()) if len(labels) else 0.5)
    aside = np.arange(len(labels)) % CALIBRATION == CALIBRATION - 1
    kept_aside, aside_labels = [d for d, x in zip(samples, aside, strict=True) if x], labels[aside]
    samples, labels = [d for d, x in zip(samples, aside, strict=True) if not x], labels[~aside]
    rng = np.random.default_rng(seed)
    net = Network(rng=rng)
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in net.NAMES}
    bytes_of = [
        [np.concatenate([np.frombuffer(c, np.uint8).astype(np.int16), np.full(CHUNK - len(c), PAD, np.int16)]) for c in doc]
        for doc in samples
    ]
    steps, total = 0, epochs * -(-len(labels) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            rows = order[start : start + BATCH]
            chunks = [c for r in rows for c in bytes_of[r]]
            owner = np.repeat(np.arange(len(rows)), [len(bytes_of[r]) for r in rows])
            part = (1 / np.bincount(owner))[owner].astype(np.float32)
            padded = np.concatenate([np.concatenate([c, np.full(WIDTH, PAD, np.int16)]) for c in chunks])
            size = CHUNK + WIDTH
            y = net.responses(np.concatenate([padded, np.full(WIDTH, PAD, np.int16)]))
            y = y.reshape(len(chunks), size // STRIDE, FILTERS)[:, : CHUNK // STRIDE]
            best = y.argmax(axis=1)
            top = np.take_along_axis(y, best[:, None], axis=1)[:, 0]
            active = np.maximum(top, 0)
            pooled = np.zeros((len(rows), FILTERS), np.float32)
            np.add.at(pooled, owner, active * part[:, None])
            stay = (rng.random(pooled.shape) >= DROPOUT).astype(np.float32) / (1 - DROPOUT)
            pooled *= stay
            z = pooled @ net.hidden + net.hidden_offset
            h = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-(h @ net.out + net.out_offset[0])))
            d_logit = ((p - labels[rows]) / len(rows)).astype(np.float32)
            d_h = np.outer(d_logit, net.out) * (z > 0)
            d_pooled = (d_h @ net.hidden.T) * stay
            d_top = d_pooled[owner] * part[:, None] * (top > 0)
            # Only the winning position of each chunk and filter passes a gradient on.
            where = np.arange(len(chunks))[:, None] * size + best * STRIDE
            index = padded[where[:, :, None] + np.arange(WIDTH)]
            patch = net.embedding[index].reshape(len(chunks), FILTERS, WIDTH * EMBEDDING)
            d_patch = d_top[:, :, None] * net.filters.T[None]
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, index.reshape(-1), d_patch.reshape(-1, EMBEDDING))
            gradients = {
                "embedding": d_embedding,
                "filters": np.einsum("cfw,cf->wf", patch, d_top),
                "offset": d_top.sum(axis=0),
                "hidden": pooled.T @ d_h,
                "hidden_offset": d_h.sum(axis=0),
                "out": h.T @ d_logit,
                "out_offset": d_logit.sum(keepdims=True),
            }
            steps += 1
            rate = RATE * (1 - steps / (total + 1))
            for k, g in gradients.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, k)[...] -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    net.calibrate(kept_aside, aside_labels)
    return net


def sample_chunks(text: str | None, n: int = SAMPLE_CHUNKS) -> list[bytes]:
    """Up to ``n`` chunks, spread evenly from a text's first byte to its last."""
    raw = (text or "").encode("utf-8", "replace")
    starts = np.linspace(0, max(0, len(raw) - CHUNK), n if len(raw) > CHUNK else 1).astype(int)
    return [raw[a : a + CHUNK] for a in dict.fromkeys(starts.tolist())]


def fit(docs: DataFrame, labels: DataFrame, rows: Column | None = None, sample: int = SAMPLE) -> Network:
    """Train on the ``sample`` labelled documents of lowest hash of either class, of those that satisfy ``rows``.

    ``labels`` has doc_id and quality (0 or 1). The bound holds for what reaches the driver: twice ``sample``
    documents of ``SAMPLE_CHUNKS`` chunks.
    """
    ship(docs.sparkSession)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    if rows is not None:
        known = known.filter(rows)
    each = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    lowest = [
        each.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for label in (0, 1)
    ]
    ids = lowest[0].unionAll(lowest[1])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = pa.array([sample_chunks(t) for t in texts], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), out], names=["doc_id", "label", "chunks"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(ids), "doc_id")  # twice ``sample`` rows
    found = picked.select("doc_id", "label", "text").mapInArrow(chunks, "doc_id long, label int, chunks array<binary>")
    # Repeated ids of documents would exceed the bound; ordered, so that training sees the same rows each time.
    taken = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.col("chunks")[0]).limit(2 * sample).collect()
    return train([[bytes(c) for c in r["chunks"]] for r in taken], np.array([r["label"] for r in taken], np.float32))


def score(text: Column, net: Network) -> Column:
    """The probability (0 to 1) of quality label 1 for each text."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        values = [None if t is None or t is pd.NA else t for t in texts.tolist()]
        out = np.empty(len(values))
        start = size = 0
        for i, t in enumerate(values):
            size += len(t or "") + CHUNK
            if size > (2 << 20) or i == len(values) - 1:
                out[start : i + 1] = net.score(values[start : i + 1])
                start, size = i + 1, 0
        return pd.Series(out)

    return scored.asNondeterministic()(text.cast("string"))  # once a row: a filter on it stays above it


def held_out(doc_id: Column) -> Column:
    """The fold that training never sees: crc32 of the id's decimal text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
