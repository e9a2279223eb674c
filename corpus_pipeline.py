"""The corpus pipeline: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's input. All stages but the
last return the columns of ``documents``; the last returns the packed pieces. SQL cannot state
the fitted stages, so there is no ORACLE_SQL; the tests compare with a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm.exact_dedup import drop_exact_duplicates
from tablecare.llm.frames import crc_fold, fresh, scratch_path
from tablecare.llm.jaccard import one_per_component
from tablecare.llm.packing import pack
from tablecare.llm.pii import redact
from tablecare.llm.toxicity import fit_toxicity, score_toxicity

ORACLE_SQL = None
TOXIC_FROM = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic; it learns from the labels of four fifths of the ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(crc_fold(F.col("doc_id"), 5) != 0))
    score = fresh(docs.columns, "toxicity")
    return score_toxicity(docs, model, score=score).where(F.col(score) < TOXIC_FROM).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, the one with the smallest id."""
    return drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of at least 0.8 over five-word shingles."""
    return one_per_component(docs, words=5, p=80, q=100)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, lengths counted anew."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
