"""Exact de-duplication by a tree of merged digest runs, in DataFrame functions only.

Every document becomes a digest record: SHA-256 of its normalised text with a second, independent
64-bit hash and the length, which verify a match. Records are dealt by a hash of the row over
``2**k`` runs. A run holds each digest once with the smallest identifier and the number of
copies. In each round, runs whose numbers agree but for their last ``FAN_IN_BITS`` bits meet and
are merged: equal verified digests collapse to the smaller identifier, the copies add up. The
last round leaves one logical run, spread over tasks by digest. The verdict then goes back the
same way, to the records of the first runs, and from there to the rows; a text that fills a third
of the table is one record per run on the way up and ``1 / 2**k`` of its rows per task on the way
down. Texts never move.

Texts are equal when they are identical after every run of blanks became one space; null counts
as empty. Of equal texts the row with the smallest id stays, a null id being the largest; of
rows that agree in both, one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.frames import durable, fresh

FAN_IN_BITS = 3
BLANKS = "[\\x20\\x09-\\x0D]+"
KEY = ["sha", "check", "size"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest_records(docs: DataFrame, doc_id: str, text: str, run_bits: int) -> DataFrame:
    """(doc_id, row, run, sha, check, size) of every row, kept as a table so that rows keep their numbers."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("t"))
    records = plain.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("t", 256)).alias("sha"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").alias("size"),
    )
    run = F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 64 - run_bits)
    return durable(records.withColumn("run", run.cast("int")), "digests")


def merged(entries: DataFrame) -> DataFrame:
    """One round: groups of ``2**FAN_IN_BITS`` runs merge into one each."""
    parent = F.shiftright("run", FAN_IN_BITS).alias("run")
    return entries.groupBy(parent, *KEY).agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run_bits: int | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    ``run_bits`` defaults to twice as many runs as there are shuffle partitions.
    """
    spark = docs.sparkSession
    if run_bits is None:
        run_bits = max(6, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1)
    records = digest_records(docs, doc_id, text, run_bits)
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    first = records.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("copies"))
    level, left = first, run_bits
    while left > 0:
        level, left = merged(level), left - FAN_IN_BITS
    verdict = level.select(*KEY, F.col("best").alias("keep"), "copies")
    down = first.select("run", *KEY).join(verdict, KEY)
    return records.join(down, ["run", *KEY]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    verdict = durable(exact_duplicates(docs, doc_id, text), "copies")
    mark = fresh(docs.columns, "text_sha256")
    keyed = docs.withColumn(mark, F.sha2(normalised(F.col(text)), 256))
    lost = verdict.where("NOT kept")
    twins = lost.where("doc_id <=> keep_id").limit(1).count() > 0
    ident, sha = fresh(keyed.columns, "verdict_id"), fresh(keyed.columns, "verdict_sha")
    chosen = (verdict.where("kept") if twins else lost).select(F.col("doc_id").alias(ident), F.col("text_sha256").alias(sha))
    same = F.col(doc_id).eqNullSafe(F.col(ident)) & (F.col(mark) == F.col(sha))
    if not twins:
        return keyed.join(chosen, same, "left_anti").drop(mark)
    # rows that agree in id and text stand for each other; one of each stays
    return keyed.join(chosen, same, "left_semi").dropDuplicates([doc_id, mark]).drop(mark)
