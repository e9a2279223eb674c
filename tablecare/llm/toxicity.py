"""Toxicity classifier that is regularised against identity terms.

A logistic regression over the presence of words. Each training text that names a group gets a
counterfactual twin in which the term is swapped for another of its set; the loss adds
``fairness * (z(text) - z(twin))**2`` on the log-odds, so that naming a group as such does not
move the score. Every word of the training texts is a feature, scaled by how much it tells
of the labels, and so are the identity terms; nothing is cut off.

Null and empty texts have no words and get the model's base rate. Repeated rows are scored
alike; other columns pass through untouched. Without any usable label every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.llm.frames import append_columns, extended, fresh, labelled_texts
from tablecare.llm.textnum import byte_table, each_chunk, hashed_words, ranges

# Terms that name a group, in sets whose members may stand for each other.
IDENTITY_SETS = [
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indigenous"],
    ["gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual"],
    ["man", "woman"],
    ["men", "women"],
    ["male", "female"],
    ["boys", "girls"],
    ["old", "young", "elderly", "teenage"],
    ["disabled", "blind", "deaf", "paralyzed"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["american", "mexican", "chinese", "russian", "german", "french", "spanish", "indian"],
]
# Entries (a word of a text) that the fit spreads out at a time; it holds 12 bytes of each throughout, 20 while it sorts.
PIECE = 1 << 18
WORD_TABLE = byte_table(blank="!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class ToxicityModel:
    """Sorted word hashes, their weights and the bias of the log-odds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    bias: float


def _presence(words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a chunk."""
    if not len(vocabulary) or not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    hit = np.flatnonzero(vocabulary[at] == words.hash)
    rows = np.searchsorted(words.first, hit, "right") - 1
    both = np.unique(rows * len(vocabulary) + at[hit])
    return both // len(vocabulary), both % len(vocabulary)


def _distinct_words(text: str):
    """Per labelled text, the hashes of its distinct words."""

    def rows(batches):
        for batch, words in each_chunk(batches, text, WORD_TABLE):
            own = [np.unique(words.hash[a:z]) for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(h) for h in own])])
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(own).view(np.int64)))
            part = [batch.column("tie"), batch.column("label"), lists.cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(part, names=["tie", "label", "words"])

    return rows


def _in_pieces(row, col):
    for at in range(0, len(col), PIECE):
        yield row[at : at + PIECE], col[at : at + PIECE]


def _telling(y, row, col, width: int) -> np.ndarray:
    """Per feature, how far its number of toxic texts lies from the expected one, in variances.

    A word that few texts hold cannot lie far off, so its scale is small and it learns slowly.
    """
    rate = y.mean()
    total, toxic = np.zeros(width), np.zeros(width)
    for r, c in _in_pieces(row, col):
        total += np.bincount(c, minlength=width)
        toxic += np.bincount(c, y[r], width)
    return (toxic - total * rate) ** 2 / (total * rate * (1 - rate) + 1) / 16


def _starts(ascending: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def _summed(values: np.ndarray, index: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The sums of ``values[index]`` from each start to the next."""
    out = np.zeros(len(start))
    edge = np.append(start, len(index))
    for lo, hi in ranges(edge, PIECE):
        out[lo:hi] = np.add.reduceat(values[index[edge[lo] : edge[hi]]], start[lo:hi] - edge[lo])
    return out


def _by_feature(row, col, texts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in the order of their features, the features in use and where each begins."""
    both = col.astype(np.int64)
    both *= texts
    both += row
    both.sort()
    out, total = np.empty(len(both), np.int32), np.zeros(width, np.int64)
    for at in range(0, len(both), PIECE):
        out[at : at + PIECE] = both[at : at + PIECE] % texts
        total += np.bincount(both[at : at + PIECE] // texts, minlength=width)
    used = np.flatnonzero(total)
    return out, used, np.cumsum(total[used]) - total[used]


def _fit(y, row, col, width: int, twins: dict[int, list[int]], fairness: float, ridge: float, steps: int):
    """Weights and bias by full-batch Adam on log loss, ridge and counterfactual penalty.

    Text ``row[k]`` (ascending) holds feature ``col[k]``; ``y`` are the labels. Features are scaled by
    ``_telling``, so the ridge weighs heaviest on words that tell little.
    """
    scale = _telling(y, row, col, width)
    # the swap moves each text by (weight of the other term - weight of its own)
    term = np.zeros(width, bool)
    term[list(twins)] = True
    own = []
    for r, c in _in_pieces(row, col):
        named = np.flatnonzero(term[c])
        own += [(i, f, twins[f][i % len(twins[f])]) for i, f in zip(r[named].tolist(), c[named].tolist(), strict=True)]
    cr, cf, ct = (np.array(v, np.int64) for v in zip(*own, strict=True)) if own else (np.zeros(0, np.int64),) * 3
    by_feature, used, start = _by_feature(row, col, len(y), width)
    first = _starts(row)
    filled = row[first]
    w, b = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    n, grad, z = len(y), np.zeros(width), np.zeros(len(y))
    for t in range(1, steps + 1):
        scaled = w * scale
        z[filled] = _summed(scaled, col, first)
        error = (1 / (1 + np.exp(-np.clip(b + z, -40, 40))) - y) / n
        shift = np.bincount(cr, scaled[ct] - scaled[cf], n)
        pull = 2 * fairness * shift[cr] / n
        grad[:] = np.bincount(ct, pull, width) - np.bincount(cf, pull, width)
        grad[used] += _summed(error, by_feature, start)
        grad = grad * scale + ridge * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w * scale, b


def _word_hashes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _features(batches: list[pa.RecordBatch], sets: list[np.ndarray]):
    """Labels in the order of the ties, rows, features and the vocabulary of ``_distinct_words`` batches, which it uses up."""
    tie = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
    y = np.concatenate([np.zeros(0), *(b.column(1).to_numpy() for b in batches)])
    sizes = np.concatenate([np.zeros(0, np.int64), *(b.column(2).value_lengths().to_numpy() for b in batches)])
    vocabulary = np.unique(np.concatenate(sets))
    for batch in batches:
        hashes = _word_hashes(batch)
        for at in range(0, len(hashes), PIECE):
            vocabulary = np.union1d(vocabulary, hashes[at : at + PIECE])
    order = np.argsort(tie, kind="stable")
    begin = np.zeros(len(order), np.int64)
    begin[order] = np.cumsum(sizes[order]) - sizes[order]
    col, text = np.empty(int(sizes.sum()), np.int32), 0
    batches.reverse()
    while batches:
        batch = batches.pop()
        hashes, at = _word_hashes(batch), 0
        for i in range(text, text + len(batch)):
            col[begin[i] : begin[i] + sizes[i]] = np.searchsorted(vocabulary, hashes[at : at + sizes[i]])
            at += sizes[i]
        text += len(batch)
        del batch, hashes
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes[order])
    return y[order], row, col, vocabulary


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_train_rows: int = 20_000,
    fairness: float = 5.0,
    ridge: float = 3e-4,
    steps: int = 200,
) -> ToxicityModel:
    """Fit on at most ``max_train_rows`` labelled documents, chosen by hash of the id."""
    joined = labelled_texts(docs, labels, doc_id, text, label, max_train_rows)
    joined = joined.select(F.xxhash64("doc_id", "text").alias("tie"), "text", "label")
    # bounded by ``max_train_rows`` texts; the order does not depend on the tasks
    batches = joined.mapInArrow(_distinct_words("text"), "tie long, label int, words array<long>").toArrow().to_batches()
    sets = [hashed_words(s, WORD_TABLE) for s in IDENTITY_SETS]
    y, row, col, vocabulary = _features(batches, sets)
    pa.default_memory_pool().release_unused()
    if not len(y) or y.min() == y.max():
        bias = 30.0 if len(y) and y[0] == 1 else -30.0
        return ToxicityModel(vocabulary, np.zeros(len(vocabulary)), bias)
    place = {int(h): i for h in np.concatenate(sets) for i in [int(np.searchsorted(vocabulary, h))]}
    twins = {place[int(h)]: [place[int(o)] for o in s if o != h] for s in sets for h in s}
    weights, bias = _fit(y, row, col, len(vocabulary), twins, fairness, ridge, steps)
    return ToxicityModel(vocabulary, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic in ``score`` (renamed by ``fresh`` on a clash)."""
    score = fresh(docs.columns, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        own = shared.value
        for batch, words in each_chunk(batches, text, WORD_TABLE):
            r, f = _presence(words, own.vocabulary)
            z = own.bias + np.bincount(r, own.weights[f], words.rows)
            yield append_columns(batch, **{score: pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))})

    return docs.mapInArrow(scored, extended(docs.schema, **{score: T.DoubleType()}))
