"""Operator 5: quality by a byte-level convolutional network in numpy.

Each byte has a learned vector.  Learned filters slide over chunks of CHUNK bytes, STRIDE bytes apart, so that chunks
overlap and cover the whole document; a short last chunk is padded with zero bytes.  Every filter's largest response over
all chunks, squashed, goes into one logistic unit.  Long texts are read in blocks with a running maximum, so memory does
not grow with a text.  Training is by Adam on at most 2 x per_class labelled documents; the gradient of a maximum falls on
the chunk that attains it.

Edge cases: null and empty texts are one chunk of zero bytes and get that chunk's score; rows that repeat score alike;
without labels of both classes every score is the share of label 1, or 0.5; other columns pass through, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftspark.llm.arrow_text import column, utf8
from weftspark.llm.rows import add_columns

PER_CLASS = 2500
CHUNK, STRIDE = 32, 16
WIDTH, FILTERS = 8, 32
EPOCHS, BATCH, RATE = 5, 16, 0.01
THRESHOLD = 0.3
#: Bytes of a text that are convolved at once.
BLOCK = 1 << 19


@dataclass
class Network:
    vectors: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # CHUNK * WIDTH x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS, then the intercept

    def responses(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response over all chunks, and the byte position of the chunk."""
        n = max(CHUNK, -(-len(raw) // STRIDE) * STRIDE)
        top = np.full(FILTERS, -np.inf, np.float32)
        where = np.zeros(FILTERS, np.int64)
        half = STRIDE * WIDTH
        for start in range(0, n - CHUNK + STRIDE, BLOCK):
            part = raw[start : start + BLOCK + CHUNK - STRIDE]
            size = min(n - start, BLOCK + CHUNK - STRIDE)
            if len(part) < size:
                part = np.concatenate([part, np.zeros(size - len(part), np.uint8)])
            steps = self.vectors[part].reshape(-1, half)
            value = steps[: len(steps) - 1] @ self.filters[:half]
            value += steps[1:] @ self.filters[half:]
            at = value.argmax(axis=0)
            best = value[at, np.arange(FILTERS)]
            better = best > top
            top[better], where[better] = best[better], start + at[better] * STRIDE
        return top + self.bias, where

    def score(self, raw: np.ndarray) -> float:
        top, _ = self.responses(raw)
        return float(1 / (1 + np.exp(-np.clip(np.tanh(top) @ self.out[:-1] + self.out[-1], -30, 30))))


def fit(sample: list[tuple[bytes, int]], counts: tuple[int, int] | None = None, seed: int = 7) -> Network:
    """A network from whole texts and labels; counts has the sizes of both classes, for which the score allows."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
        rng.normal(0, 0.15, (CHUNK * WIDTH, FILTERS)).astype(np.float32),
        np.full(FILTERS, -1.0, np.float32),
        np.r_[rng.normal(0, 0.5, FILTERS), 0.0].astype(np.float32),
    )
    total = [sum(y == k for _, y in sample) for k in (0, 1)]
    if not all(total):
        net.out[:] = 0
        net.out[-1] = 0.0 if not sum(total) else (30.0 if total[1] else -30.0)
        return net
    params = [net.vectors, net.filters, net.bias, net.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    raws = [(np.frombuffer(t, np.uint8), y) for t, y in sample]
    weight = [len(sample) / (2 * t) for t in total]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(raws))
        rate = RATE * (1 - epoch / EPOCHS)
        for start in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in params]
            for i in order[start : start + BATCH]:
                raw, y = raws[i]
                top, where = net.responses(raw)
                act = np.tanh(top)
                p = 1 / (1 + np.exp(-np.clip(act @ net.out[:-1] + net.out[-1], -30, 30)))
                error = np.float32(weight[y] * (p - y) / BATCH)
                grads[3][:-1] += error * act
                grads[3][-1] += error
                delta = error * net.out[:-1] * (1 - act * act)
                grads[2] += delta
                at = where[:, None] + np.arange(CHUNK)
                chunk = np.where(at < len(raw), raw[np.minimum(at, len(raw) - 1)], 0) if len(raw) else np.zeros(at.shape, np.uint8)
                grads[1] += (net.vectors[chunk].reshape(FILTERS, -1) * delta[:, None]).T
                np.add.at(grads[0], chunk.ravel(), (net.filters.T * delta[:, None]).reshape(-1, WIDTH))
            step += 1
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    if counts is not None and all(counts):
        net.out[-1] += np.float32(np.log(counts[1] / counts[0]))  # training weighed both classes alike
    return net


def score_quality(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with the private column quality_score behind its own."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            raw, offs = utf8(column(batch, text))
            yield [pa.array([held.value.score(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.float64())]

    return add_columns(docs, {"quality_score": "double"}, compute)
