"""Token counts through a cache of digests.

A text's key is the SHA-256 of its content together with the digest of the tokenizer file. Keys
are joined to the stored counts; only texts whose key is missing are encoded, each distinct one
once, and their counts are appended to the cache as new files. A cache written by another version
of the tokenizer is never read, as its digest is part of the folder's name.

Null texts count as empty. Counting needs no unique ids; rows with a null id are counted like
others. Two writers that append the same key do no harm, as both store the same count.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm.encoders import encoder
from tablecare.llm.frames import durable
from tablecare.llm.textnum import text_column

CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(tokenizer_path: str) -> str:
    with open(tokenizer_path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()[:32]


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _encoded(tokenizer_path: str):
    def counted(batches):
        own = encoder(tokenizer_path)
        for batch in batches:
            counts = [len(own.ids(t)) for t in text_column(batch, "text").to_pylist()]
            digest = batch.column(batch.schema.get_field_index("digest"))
            yield pa.RecordBatch.from_arrays([digest, pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return counted


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_folder: str,
    limit: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    folder = f"{cache_folder}/version={tokenizer_version(tokenizer_path)}"
    content = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    content = content.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = durable(content.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "contents")
    wanted = rows.groupBy("digest").agg(F.min("doc_id").alias("one"))
    missing = wanted.join(_stored(spark, folder).select("digest"), "digest", "left_anti")
    # one row per missing digest brings its text; its id is part of the key, so that copies spread
    chosen = missing.select(F.col("digest").alias("_digest"), "one")
    picked = content.join(chosen, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("one")), "left_semi")
    fresh_counts = picked.select("digest", "text").mapInArrow(_encoded(tokenizer_path), CACHE_SCHEMA)
    # rows that repeat in id and text were encoded with their twin; one count of them is stored
    fresh_counts.dropDuplicates(["digest"]).write.mode("append").parquet(folder)
    counts = _stored(spark, folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
