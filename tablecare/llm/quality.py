"""Quality classifier: random-indexing word vectors, a small network, calibrated probabilities.

* **Random indexing.** Every token has a fixed sparse ternary index vector; a token's vector is
  the sum of the index vectors of its neighbours within two places over the whole corpus. Tokens
  share ``2**BUCKET_BITS`` rows by hash, so the table has a fixed size, whatever the corpus.
* **Pooling.** A document is the mean and the spread of its token vectors, and a few shares
  (upper case, marks, digits, distinct tokens, repeats).
* **Network.** Two layers in numpy, fitted on a bounded number of labelled documents; a
  temperature fitted on documents the weights have not seen calibrates the probabilities.

Null and empty texts pool to zeros and get a score like any other. Other columns pass through
untouched. With fewer than two classes among the labels every score is the share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.llm.frames import append_columns, extended, fresh, labelled_texts
from tablecare.llm.textnum import each_chunk, mix

BUCKET_BITS = 15
DIMENSIONS = 32
SHARES = 9
SAME = np.arange(256, dtype=np.uint8)
SAME[48:58] = 48  # digits count as one
# Kinds of bytes; a token is a run of one kind: 0 blank, 1 letters, 2 digits, 3 marks.
KINDS = np.full(256, 3, np.uint8)
KINDS[65:91] = KINDS[97:123] = KINDS[128:] = 1
KINDS[48:58] = 2
KINDS[[0x20, 9, 10, 11, 12, 13]] = 0


def index_vectors() -> np.ndarray:
    """The fixed random index vectors: a quarter of the entries are +1 or -1."""
    draw = np.random.default_rng(20).integers(0, 8, (1 << BUCKET_BITS, DIMENSIONS))
    return (draw == 0).astype(np.int16) - (draw == 1).astype(np.int16)


def _buckets(words) -> np.ndarray:
    return (words.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _neighbour_sums(text: str):
    """Per task, the sums of the neighbours' index vectors by bucket."""

    def summed(batches):
        index = index_vectors()
        table = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.int64)
        for _, words in each_chunk(batches, text, SAME, KINDS):
            b = _buckets(words)
            if not len(b):
                continue
            row = np.repeat(np.arange(words.rows), np.diff(words.first))
            near = np.zeros((len(b), DIMENSIONS), np.int16)
            for k in (1, 2):
                same = (row[k:] == row[:-k])[:, None]
                near[k:] += index[b[:-k]] * same
                near[:-k] += index[b[k:]] * same
            order = np.argsort(b, kind="stable")
            at, start = np.unique(b[order], return_index=True)
            table[at] += np.add.reduceat(near[order], start, dtype=np.int64)
        at = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(at), *(pa.array(table[at, d]) for d in range(DIMENSIONS))]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", *(f"v{d}" for d in range(DIMENSIONS))])

    return summed


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors per bucket from all texts. The sums are whole numbers, so order does not matter."""
    names = [f"v{d}" for d in range(DIMENSIONS)]
    parts = docs.select(F.col(text).alias("text")).mapInArrow(
        _neighbour_sums("text"), "bucket long, " + ", ".join(f"{n} long" for n in names)
    )
    sums = parts.groupBy("bucket").agg(*(F.sum(n).cast("double").alias(n) for n in names)).toPandas()
    table = np.zeros((1 << BUCKET_BITS, DIMENSIONS), np.float32)
    values = sums[names].to_numpy()
    table[sums["bucket"].to_numpy()] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1)
    return table


def pooled(words, vectors: np.ndarray) -> np.ndarray:
    """One feature row per document of a chunk."""
    n, b = words.rows, _buckets(words)
    out = np.zeros((n, 2 * DIMENSIONS + SHARES))
    raw, kind = words.bytes[: words.size], words.kind
    edges = words.row_start
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    of_kind = [np.concatenate([[0], np.cumsum(kind == k)]) for k in range(4)]
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    for i in range(n):
        lo, hi = edges[i], edges[i + 1]
        size = max(hi - lo, 1)
        letters = of_kind[1][hi] - of_kind[1][lo]
        shares = [np.log1p(hi - lo), (upper[hi] - upper[lo]) / max(letters, 1)]
        shares += [(of_kind[k][hi] - of_kind[k][lo]) / size for k in (2, 3)]
        shares += [10 * (lines[hi] - lines[lo]) / size]
        a, z = words.first[i], words.first[i + 1]
        if z > a:
            own = b[a:z]
            v = vectors[own]
            out[i, :DIMENSIONS] = v.mean(axis=0)
            out[i, DIMENSIONS : 2 * DIMENSIONS] = v.std(axis=0)
            whole = words.hash[a:z]
            _, counts = np.unique(whole, return_counts=True)
            pairs = np.unique(mix(whole[:-1]) + whole[1:])
            shares += [len(counts) / len(own), counts.max() / len(own)]
            shares += [len(pairs) / max(len(own) - 1, 1), words.lengths[a:z].mean() / 10]
        else:
            shares += [0.0] * 4
        out[i, 2 * DIMENSIONS :] = shares
    return out


@dataclass
class QualityModel:
    """Token vectors, scaling of the features, the two layers and the temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2) / self.temperature, -40, 40)))


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, decay: float):
    """Adam on mini-batches; a fixed seed, so a repeated fit gives the same weights."""
    draw = np.random.default_rng(5)
    p = [
        draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)),
        np.zeros(hidden),
        draw.normal(0, 1 / np.sqrt(hidden), hidden),
        np.zeros(1),
    ]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for at in range(0, len(y), 256):
            i = order[at : at + 256]
            h = np.tanh(x[i] @ p[0] + p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (1 - h**2)
            grads = [x[i].T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], e.sum(keepdims=True)]
            t += 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                p[k] -= 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on unseen rows, by a fixed grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    loss = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    max_train_rows: int = 20_000,
    hidden: int = 32,
    epochs: int = 40,
    decay: float = 1e-4,
) -> QualityModel:
    """Token vectors from all ``docs``; the network from at most ``max_train_rows`` labelled ones."""
    vectors = word_vectors(docs, text)

    def rows(batches):
        for batch, words in each_chunk(batches, "text", SAME, KINDS):
            x = pooled(words, vectors)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            part = [batch.column("tie").cast(pa.int64()), batch.column("label"), lists]
            yield pa.RecordBatch.from_arrays(part, names=["tie", "label", "x"])

    joined = labelled_texts(docs, labels, doc_id, text, label, max_train_rows)
    joined = joined.select(F.xxhash64("doc_id", "text").alias("tie"), "text", "label")
    got = joined.mapInArrow(rows, "tie long, label int, x array<double>").toPandas().sort_values("tie")
    y = got["label"].to_numpy(np.float64)
    width = 2 * DIMENSIONS + SHARES
    x = np.stack(got["x"].to_numpy()) if len(y) else np.zeros((0, width))
    if len(y) < 20 or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        bias = float(np.log((rate + 1e-9) / (1 - rate + 1e-9)))
        zero = np.zeros(width)
        return QualityModel(vectors, zero, zero + 1, np.zeros((width, 1)), np.zeros(1), np.zeros(1), bias, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    unseen = np.arange(len(y)) % 5 == 0
    w1, b1, w2, b2 = _train((x[~unseen] - mean) / scale, y[~unseen], hidden, epochs, decay)
    model = QualityModel(vectors, mean, scale, w1, b1, w2, b2, 1.0)
    z = np.tanh(((x[unseen] - mean) / scale) @ w1 + b1) @ w2 + b2
    model.temperature = _temperature(z, y[unseen])
    return model


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability of good quality in ``score`` (``fresh`` on a clash)."""
    score = fresh(docs.columns, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        own = shared.value
        for batch, words in each_chunk(batches, text, SAME, KINDS):
            yield append_columns(batch, **{score: pa.array(own.probability(pooled(words, own.vectors)))})

    return docs.mapInArrow(scored, extended(docs.schema, **{score: T.DoubleType()}))
