"""File arrival as a stream: per-batch runs, row reasons, content de-duplication, repeated keys.

A trigger of ``availableNow`` is the scheduled form: it works through whatever is new and ends;
the clock is whoever starts it. Stream checkpoints serialize the runs of one table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablecare.functions.typed import col
from tablecare.operators.keyflags import flag_by_keys, key_counts, keys_present
from tablecare.operators.rules import row_check
from tablecare.operators.sizing import durable
from tablecare.operators.validate import REASONS
from tablecare.sources.sinks import empty_where_missing
from tablecare.spec import Rule, RuleError, TableSpec, dedupe_rules

# The schema of Spark's binary file source.
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
DIGEST_SCHEMA = "table_name string, digest string"


def arrivals(spark: SparkSession, spec: TableSpec, directory: str, max_files: int | None = None) -> DataFrame:
    """Stream of the rows of every newly landed file of the spec's format."""
    if spec.schema is None:
        raise ValueError("a file stream needs a declared schema")
    reader = spark.readStream.format(spec.fmt).options(**spec.options).schema(spec.schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(directory)


def stream_reasons(stream: DataFrame, rules: Sequence[Rule], reasons: str = REASONS) -> DataFrame:
    """Reasons per row on a stream. Row rules are stateless, so rows pass straight through.

    A rule that a single row cannot decide (keys, groups, tables, shares) is refused: its verdict
    belongs to a batch, see ``run_per_batch``.
    """
    row_rules = dedupe_rules(rules)
    refused = [r.reason for r in row_rules if r.level != "row" or r.kind == "zscore_below" or r.mostly < 1]
    if refused:
        raise RuleError(f"a stream's rows cannot decide {refused}")
    parts = [F.when(row_check(r, stream.schema).violation, F.lit(r.reason)) for r in row_rules]
    listed = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return stream.withColumn(reasons, listed)


def run_per_batch(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Call ``handle(batch, batch_id)`` for every micro-batch, once each by the checkpoint."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# -- identical content ---------------------------------------------------------------------


def line_sums(lines: DataFrame) -> DataFrame:
    """(uri, lines, w0, w1, p0, p1) per file of a text scan with the columns ``uri``, ``block`` and ``value``.

    Two 56-bit hashes of every line are summed, and summed again times the line's number, both
    exactly. A task sees a piece of a file and numbers its lines from anywhere; from a piece's sums
    follow those for any other start, so the pieces of a file fold in place order to the same sums
    however it was cut. Another order of the lines changes the second pair.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    lanes = [F.xxhash64("value"), F.xxhash64(F.lit(7), "value")]
    numbered = lines.select(
        "uri", "block", number.alias("at"), *[F.shiftright(h, 8).cast("decimal(18,0)").alias(f"h{i}") for i, h in enumerate(lanes)]
    )
    pieces = numbered.groupBy("uri", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("at").alias("first"),
        *[F.sum(f"h{i}").cast("decimal(38,0)").alias(f"w{i}") for i in range(2)],
        *[F.sum(F.col(f"h{i}") * F.col("at").cast("decimal(10,0)")).cast("decimal(38,0)").alias(f"p{i}") for i in range(2)],
    )
    # lines of the file in front of the piece, less the number its first line had
    ahead = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).cast("decimal(12,0)")
    placed = pieces.withColumn("shift", shift)
    return placed.groupBy("uri").agg(
        F.sum("n").alias("lines"),
        *[F.sum(f"w{i}").cast("decimal(38,0)").alias(f"w{i}") for i in range(2)],
        *[F.sum((F.col(f"p{i}") + F.col("shift") * F.col(f"w{i}")).cast("decimal(38,0)")).alias(f"p{i}") for i in range(2)],
    )


def file_digests(spark: SparkSession, paths: str | Sequence[str], fmt: str) -> DataFrame:
    """Path and digest of files of any size: equal for equal bytes, else different.

    The digest covers the length, and every line's bytes in place order; what does not parse counts
    as well. Files are read in pieces, so one of any size is hashed by many tasks; a single line is
    a value and ends at 2 GB. Where the reader strips a compression, the text below it counts.
    Empty files are not listed, as no reader lists them.
    """
    chosen = [paths] if isinstance(paths, str) else list(paths)
    # no folder name is taken for a column
    found = {"pathGlobFilter": f"*.{fmt}", "recursiveFileLookup": "true"}
    listed = spark.read.format("binaryFile").schema(BINARY_SCHEMA).options(**found).load(chosen)
    files = listed.select("path", "length", F.col("_metadata.file_path").alias("uri"))
    text = spark.read.format("text").options(lineSep="\n", **found).load(chosen)
    lines = text.select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    sums = ["lines", "w0", "w1", "p0", "p1"]
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in sums]
    return files.join(line_sums(lines), "uri", "left").select(
        "path", F.sha2(F.concat_ws(":", F.col("length").cast("string"), *parts), 256).alias("digest")
    )


def landed_files(spark: SparkSession, directory: str, fmt: str, max_files: int | None = None) -> DataFrame:
    """Stream of newly landed files by path and length, in folders too; contents are not read."""
    files = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("pathGlobFilter", f"*.{fmt}")
    files = files.option("recursiveFileLookup", "true")
    if max_files is not None:
        files = files.option("maxFilesPerTrigger", max_files)
    return files.load(directory).select("path", "length")


def row_digest(df: DataFrame) -> DataFrame:
    """Digest of a table's rows regardless of their order; repeated rows count.

    The count and the exact sums of two independent row hashes; combined per task, one row in the end.
    """
    names = [col(c) for c in df.columns]
    low = F.xxhash64(*names)
    high = F.xxhash64(F.lit(7), *names)
    folded = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(low.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("x"),
        F.coalesce(F.sum(high.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("y"),
    )
    return folded.select(F.sha2(F.concat_ws(":", "n", "x", "y"), 256).alias("digest"))


def first_of_content(items: DataFrame, scope: Sequence[str], digest: str, order: str) -> DataFrame:
    """First arrival of every content per scope: ``scope``, ``digest`` and the smallest ``order``.

    A minimum is combined before the shuffle, so a group of copies of any size costs one row per
    task.
    """
    return items.groupBy(*scope, digest).agg(F.min(order).alias(order))


def new_content(items: DataFrame, ledger: DataFrame, scope: Sequence[str], digest: str, order: str) -> DataFrame:
    """First arrivals whose content is not in the ledger."""
    seen = ledger.select(*scope, digest).distinct()
    return first_of_content(items, scope, digest, order).join(seen, [*scope, digest], "left_anti")


class ContentLedger:
    """Digests of files that were processed, as an append-only table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/content_ledger"

    def frame(self) -> DataFrame:
        try:
            return self.spark.read.schema(DIGEST_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            return empty_where_missing(self.spark, error, DIGEST_SCHEMA)

    def commit(self, table_name: str, digests: str | Sequence[str]) -> None:
        """Add the contents of a batch in one write."""
        digests = [digests] if isinstance(digests, str) else digests
        rows = self.spark.createDataFrame([(table_name, d) for d in digests], DIGEST_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(self.path)


def unseen_files(spark: SparkSession, spec: TableSpec, paths: Sequence[str], ledger: ContentLedger) -> list[tuple[str, str]]:
    """(path, digest) of the files with content that is new, the first path of each content, in order.

    One job hashes all files, one meets the ledger; the driver sees a path and a digest per file.
    """
    if not paths:
        return []
    found = file_digests(spark, paths, spec.fmt).withColumn("table_name", F.lit(spec.name))
    new = new_content(durable(found, "digests"), ledger.frame(), ["table_name"], "digest", "path")
    return sorted((r["path"], r["digest"]) for r in new.collect())


def run_new_files(
    spark: SparkSession,
    spec: TableSpec,
    directory: str,
    ledger: ContentLedger,
    handle: Callable[[str], None],
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Call ``handle(path)`` for each landed file with new content, told apart by its bytes.

    A digest is committed only after its file went through, so a failed run is tried again.
    """

    def batch(files: DataFrame, _batch_id: int) -> None:
        for path, digest in unseen_files(spark, spec, [r["path"] for r in files.select("path").collect()], ledger):
            handle(path)
            ledger.commit(spec.name, digest)

    return run_per_batch(landed_files(spark, directory, spec.fmt), batch, checkpoint, available_now)


def run_new_batches(
    spark: SparkSession,
    spec: TableSpec,
    directory: str,
    ledger: ContentLedger,
    handle: Callable[[list[str], str], None],
    checkpoint: str,
    available_now: bool = True,
    max_files: int | None = None,
) -> StreamingQuery:
    """Call ``handle(paths, batch_id)`` once per micro-batch, with all its files of new content.

    The batch id follows from the contents, so a batch that is tried again has the same one,
    whatever stream brings it. The digests are committed together after the batch went through.
    """

    def batch(files: DataFrame, _batch_id: int) -> None:
        new = unseen_files(spark, spec, [r["path"] for r in files.select("path").collect()], ledger)
        if new:
            digests = [digest for _, digest in new]
            handle([path for path, _ in new], hashlib.sha256("".join(sorted(digests)).encode()).hexdigest())
            ledger.commit(spec.name, digests)

    return run_per_batch(landed_files(spark, directory, spec.fmt, max_files), batch, checkpoint, available_now)


# -- keys across batches -------------------------------------------------------------------


def unique_within(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of event time; state stays bounded."""
    data_type = stream.schema[event_time].dataType
    # A watermark wants a zoned timestamp; the column gets its own type back afterwards.
    zoned = stream.withColumn(event_time, col(event_time).cast("timestamp"))
    kept = zoned.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    return kept.withColumn(event_time, col(event_time).cast(data_type))


def flag_repeats(batch: DataFrame, keys: Sequence[str], ledger: DataFrame, flag: str = "repeated") -> DataFrame:
    """Mark the rows of a batch whose key an earlier batch brought, at any distance in time.

    The batch is reduced to one row per key before it meets the ledger, and the rows are marked
    through those keys, so a key that fills a third of the batch unbalances nothing.
    """
    known = ledger.select(*[col(k) for k in keys]).distinct()
    seen = key_counts(batch.filter(keys_present(keys)), keys).join(known, list(keys), "left_semi")
    return flag_by_keys(batch, keys, seen, flag)
