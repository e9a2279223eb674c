"""Best-fit packing of documents into sequences of fixed length, in bulk-synchronous sweeps.

Pieces of equal length stand for each other, and so do gaps of equal size. Pieces are range-sorted
by length, which gives each its rank among those of its length without one task ever holding a
length; what has to be decided is then how many pieces of each length go to how many gaps of
each size, from a table of at most ``capacity`` counts. A sweep takes the longest lengths first:
the successor of a length is the smallest gap that holds it; where more pieces want a gap than
there are gaps, the pieces of smaller rank get them; gaps are updated and the sweep goes on with
the rest, which opens sequences where no gap is left. The decisions are intervals of ranks. Every
piece finds its interval by a join, so that its sequence and offset come from distributed work.

Null texts are empty and give one piece of the end token. Rows need no unique ids. An empty table
gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecare.llm.encoders import encoder
from tablecare.llm.frames import durable
from tablecare.llm.textnum import text_column

PIECE_SCHEMA = "doc_id {0}, piece int, start long, length long, ids_crc32 long"


def _cut(tokenizer_path: str, capacity: int, end_id: int, id_type: pa.DataType | None):
    def pieces(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            texts = text_column(batch, "text")
            for lo in range(0, len(ids), 500):
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(texts[lo : lo + 500].to_pylist(), lo):
                    tokens = np.array([*own.ids(text), end_id], "<u4")
                    stop = len(tokens) % capacity or capacity
                    at = k = 0
                    while at < len(tokens):
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(stop - at)
                        crc.append(zlib.crc32(tokens[at:stop].tobytes()))
                        at, stop, k = stop, stop + capacity, k + 1
                arrays = [pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *arrays], names=names)

    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, doc_id: str, text: str) -> DataFrame:
    """Every document's ids and the end id, cut from the end into pieces of ``capacity``."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = PIECE_SCHEMA.format(plain.schema["doc_id"].dataType.simpleString())
    return plain.mapInArrow(_cut(tokenizer_path, capacity, end_id, None), schema)


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, end rank, first sequence, offset) for counts of lengths.

    ``gaps[g]`` holds runs (first sequence, number) of sequences with ``g`` tokens free, ``sizes``
    the sorted gap sizes in use.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    opened = 0

    def add(gap: int, first: int, number: int) -> None:
        if gap == 0 or number == 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                number = -(-(end - rank) // (capacity // length))
                add(capacity, opened, number)
                opened += number
                continue
            gap = sizes[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
            taken = min(number, end - rank)
            placed.append((length, rank, rank + taken, first, capacity - gap))
            add(gap, first + taken, number - taken)
            add(gap - length, first, taken)
            rank += taken
    return placed


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = durable(token_pieces(docs, tokenizer_path, capacity, end_id, doc_id, text), "pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartitionByRange(parts, "length", "doc_id", "piece").sortWithinPartitions("length")
    place = F.monotonically_increasing_id()
    ordered = ordered.withColumn("part", F.spark_partition_id()).withColumn("at", place)
    ordered = durable(ordered, "ordered")
    runs = ordered.groupBy("length", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # at most one count per length, so at most ``capacity`` of them
    counts = {r["length"]: r["n"] for r in ordered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placements = spark.createDataFrame(
        sweeps(counts, capacity) or [], "length long, rank_from long, rank_to long, sequence_from long, offset long"
    )
    ranked = ordered.join(runs.select("length", "part", "first", "before"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at") - F.col("first"))
    # lengths are at most ``capacity`` and each has few intervals: the table is bounded by the capacity
    here = F.broadcast(placements.withColumnRenamed("length", "of_length"))
    fits = (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    sequence = F.col("sequence_from") + F.col("rank") - F.col("rank_from")
    return ranked.join(here, fits).select(
        "doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset"
    )
