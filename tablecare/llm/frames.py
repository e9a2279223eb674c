"""Small helpers that the operators share: names, labelled samples, row keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.operators.sizing import durable, scratch_path, shared_dir

__all__ = [
    "append_columns",
    "crc_fold",
    "durable",
    "extended",
    "fresh",
    "labelled_sample",
    "labelled_texts",
    "scratch_path",
    "shared_dir",
]


def fresh(columns: list[str], wanted: str) -> str:
    """``wanted``, or it with underscores in front where a column of that name exists."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(labels: DataFrame, doc_id: str, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most ``max_rows`` labelled documents, the first by hash of the id.

    Rows without id or with a label other than 0 and 1 are left out; where an id has several
    labels the larger counts. The result has a proven bound and may be broadcast.
    """
    one = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    one = one.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, label), one row per id of ``labelled_sample`` that ``docs`` holds, so ``max_rows`` at most.

    Where an id comes with several texts, the one with the smallest hash counts, whatever its
    share of the rows; they are reduced before the shuffle. A null text is empty.
    """
    known = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = known.join(F.broadcast(labelled_sample(labels, doc_id, label, max_rows)), "doc_id")
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    return joined.groupBy("doc_id", "label").agg(first).select("doc_id", "first.text", "label")


def extended(schema: T.StructType, **columns: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in columns.items())])


def append_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    names = [*batch.schema.names, *columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=names)
