"""Hard negatives: for each anchor and positive the best scored rows of other labels inside a score window.

Vectors become integers (``floor(scale * x)``), a score is the integer inner product of two of them.
Scores come from Strassen's recursion on int64 tiles of anchors and candidates, odd sides padded
with zeros: seven products of half size and exact integer additions in place of eight products.
Every task keeps heaps of bounded size per anchor and merges a tile's best into them; the heaps of
all tasks are merged by a ranked window whose input is at most ``slices`` heaps per anchor. The
first pass finds each anchor's positives, the second its negatives, since a window starts from a
positive's score.

Anchors meet all other rows in blocks of at most ``BLOCK_BYTES``; a wave of ``WAVE`` blocks is
broadcast at a time and its heaps are written before the next one, so what is held by the driver
or a task does not grow with the table. The work is anchors times rows: that is the query.

Rows with a null label, a null vector or a null or non-finite component take no part, nor does a
vector whose squared integer length reaches 2**56 (a score could leave the range of a long). Rows
of different length do not meet. Rows that repeat an id, or a whole row, are rows of their own; a
null id is no anchor and comes after all others among equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.frames import durable

LEAF = 32  # smallest side that is halved once more
TILE_ROWS = 4096
ANCHOR_ROWS = 256
BLOCK_BYTES = 16 * 1024 * 1024
WAVE = 8
SQUARE_LIMIT = 2**56
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max
HEAP = "anchor long, slot int, id long, score long"


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product itself; through doubles where no partial sum can leave their integers."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best ``k`` (score, id) of every row, higher scores first, ties by smaller id."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), NONE), np.full((rows, k), NO_ID)

    def merge(self, lo: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take up a tile's scores (overwritten) for rows from ``lo`` on; ``ids`` ascend, ``NONE`` is no entry."""
        hi, k = lo + len(scores), self.score.shape[1]
        row = np.arange(len(scores))
        if not scores.shape[1]:
            return
        best_score, best_id = [self.score[lo:hi]], [self.id[lo:hi]]
        for _ in range(min(k, scores.shape[1])):
            at = scores.argmax(axis=1)
            best = scores[row, at]
            if (best == NONE).all():
                break
            best_score.append(best[:, None])
            best_id.append(np.where(best == NONE, NO_ID, ids[at])[:, None])
            scores[row, at] = NONE
        score, ident = np.concatenate(best_score, axis=1), np.concatenate(best_id, axis=1)
        # ~x runs against x without leaving the range at the smallest number
        order = np.lexsort((ident, ~score), axis=1)[:, :k]
        self.score[lo:hi] = np.take_along_axis(score, order, 1)
        self.id[lo:hi] = np.take_along_axis(ident, order, 1)


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(row, vec_id, label, v) of the rows that take part, written; ``v`` are the integer components."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2**28 / scale))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    kept = kept.where(F.col("label").isNotNull() & F.col("v").isNotNull() & sound).withColumn("v", whole)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return durable(kept.where(square < SQUARE_LIMIT).withColumn("row", F.monotonically_increasing_id()), "integer-vectors")


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, rows, ids, labels, vectors) per vector length, ordered by id."""
    column = batch.column(batch.schema.get_field_index("v"))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    row, label = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("row", "label"))
    ident = batch.column(batch.schema.get_field_index("vec_id")).fill_null(NO_ID).to_numpy()
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        at = at[np.argsort(ident[at], kind="stable")]
        yield int(length), row[at], ident[at], label[at], _matrix(column.take(pa.array(at)), int(length))


def _tiles(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            yield from _by_length(batch.slice(at, TILE_ROWS))


def _packed(anchor: np.ndarray, heaps: list[Heaps]) -> pa.RecordBatch:
    parts = []
    for slot, heap in enumerate(heaps):
        row, place = np.nonzero(heap.score != NONE)
        parts.append((anchor[row], np.full(len(row), slot, np.int32), heap.id[row, place], heap.score[row, place]))
    rows, slots, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
    columns = [pa.array(rows), pa.array(slots), pa.array(ids, mask=ids == NO_ID), pa.array(scores)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "id", "score"])


def _heaps_of(block, k: int, slots: int):
    """A task's heaps of one anchor block: by label alone for positives, by the windows in it for negatives.

    ``block`` holds per vector length (rows, labels, vectors, lows, highs); with ``slots`` 0 the
    heap of an anchor takes other rows of its label, else each slot takes rows of other labels
    with a score from low to high.
    """

    def work(batches):
        groups = block.value
        heaps = {n: [Heaps(len(g[0]), k) for _ in range(slots or 1)] for n, g in groups.items()}
        for length, row, ident, label, vectors in _tiles(batches):
            if length not in groups:
                continue
            a_row, a_label, a_vector, low, high = groups[length]
            columns = np.ascontiguousarray(vectors.T)
            for lo in range(0, len(a_row), ANCHOR_ROWS):
                part = slice(lo, lo + ANCHOR_ROWS)
                scores = strassen(a_vector[part], columns)
                same = a_label[part, None] == label[None, :]
                if not slots:
                    scores[~same] = NONE
                    itself = np.flatnonzero(np.isin(row, a_row[part]))
                    if len(itself):
                        x, y = np.nonzero(a_row[part, None] == row[None, itself])
                        scores[x, itself[y]] = NONE
                    heaps[length][0].merge(lo, scores, ident)
                    continue
                scores[same] = NONE
                for slot in range(slots):
                    inside = (scores >= low[part, slot, None]) & (scores <= high[part, slot, None]) & (scores != NONE)
                    used = np.flatnonzero(inside.any(axis=0))
                    if len(used):
                        heaps[length][slot].merge(lo, np.where(inside[:, used], scores[:, used], NONE), ident[used])
        for length, own in heaps.items():
            yield _packed(groups[length][0], own)

    return work


def _blocks(spark, anchors: DataFrame, n_blocks: int, slots: int):
    """Each block of anchors as {length: (rows, labels, vectors, lows, highs)}; one block at a time reaches the driver."""
    for number in range(n_blocks):
        table = anchors.where(F.col("block") == number).toArrow().combine_chunks()
        groups = {}
        for batch in table.to_batches(max_chunksize=max(1, table.num_rows)):
            for length, row, _, label, vectors in _by_length(batch):
                order = np.argsort(row)
                groups[length] = [row[order], label[order], vectors[order], None, None]
            if slots:
                bounds = {r: (x, y) for r, x, y in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "low", "high")), strict=True)}
                for group in groups.values():
                    low, high = np.full((len(group[0]), slots), 1, np.int64), np.zeros((len(group[0]), slots), np.int64)
                    for i, r in enumerate(group[0].tolist()):
                        x, y = bounds[r]
                        low[i, : len(x)], high[i, : len(y)] = x, y
                    group[3], group[4] = low, high
        yield groups


def _best(table: DataFrame, anchors: DataFrame, n_blocks: int, k: int, slots: int, slices: int) -> DataFrame:
    """(anchor, slot, id, score, rank) of the best ``k`` rows of every anchor and slot."""
    spark = table.sparkSession
    few = table.coalesce(slices)
    written, wave, held = [], [], []

    def flush():
        if wave:
            one = wave[0]
            for other in wave[1:]:
                one = one.union(other)
            written.append(durable(one, "heaps"))
        for broadcast in held:
            broadcast.unpersist()
        wave.clear(), held.clear()

    for groups in _blocks(spark, anchors, n_blocks, slots):
        held.append(spark.sparkContext.broadcast(groups))
        wave.append(few.mapInArrow(_heaps_of(held[-1], k, slots), HEAP))
        if len(wave) == WAVE:
            flush()
    flush()
    heaps = spark.createDataFrame([], HEAP)
    for part in written:
        heaps = heaps.union(part)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    slices: int = 64,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on the column ``vec_id``. An anchor's positives are the first
    ``positives`` other rows of its label; its negatives for a positive are the first
    ``negatives`` rows of other labels whose score is from ``low_percent`` to ``high_percent``
    of the positive's. Other columns of ``vectors`` are not read, whatever their names.
    """
    label = F.col("label") if label is None else label
    table = prepared(vectors, vec_id, vector, label, scale)
    anchors = table.where(F.col("vec_id").isNotNull() & is_anchor)
    held = anchors.agg(F.sum(F.size("v") * 8 + 64).alias("b")).collect()[0]["b"] or 0
    n_blocks = math.ceil(held / BLOCK_BYTES) if held else 0
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, n_blocks)))
    anchors = durable(anchors.withColumn("block", block), "anchors")
    near = durable(_best(table, anchors, n_blocks, positives, 0, slices), "positives")
    # from ceil(low * p / 100) to floor(high * p / 100), in whole numbers
    low = F.expr(f"-((-score * {low_percent} - pmod(-score * {low_percent}, 100)) div 100)")
    high = F.expr(f"(score * {high_percent} - pmod(score * {high_percent}, 100)) div 100")
    bounds = F.array_sort(F.collect_list(F.struct("rank", "low", "high")))
    windows = near.withColumns({"low": low, "high": high}).groupBy(F.col("anchor").alias("row")).agg(bounds.alias("w"))
    windows = windows.select("row", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    bounded = durable(anchors.join(windows, "row"), "windows")
    far = _best(table, bounded, n_blocks, negatives, positives, slices)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    found = found.join(chosen, ["anchor", "slot"]).join(names, "anchor")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

