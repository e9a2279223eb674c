"""Scans: declared or inferred schema, several formats, malformed lines, newest batch."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.operators.sizing import durable
from tablecare.spec import TableSpec

FORMATS = ("csv", "parquet", "json", "orc", "jdbc")
TEXT_FORMATS = ("csv", "json")
CORRUPT = "_corrupt_record"
# Scheme and host in front of a path.
STORE = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


class ScanError(ValueError):
    """The source cannot be read."""


def scan(
    spark: SparkSession,
    spec: TableSpec,
    path: str | Sequence[str] | None = None,
    fmt: str | None = None,
    source_column: str | None = None,
) -> DataFrame:
    """Read a table of the spec, lazily; from several paths as one, with each row's file if asked for.

    With a declared schema no pass over the data is needed to find the types; without one, text
    formats are inferred. A value that does not parse becomes null and shows up under the null
    rules. ``jdbc`` takes its connection from the spec's options and no path.
    """
    fmt = fmt or spec.fmt
    if fmt not in FORMATS:
        raise ScanError(f"unsupported format '{fmt}', supported: {list(FORMATS)}")
    reader = spark.read.format(fmt).options(**spec.options)
    if fmt == "jdbc":
        return reader.load()
    if path is None:
        raise ScanError(f"spec '{spec.name}' names no path to read")
    if spec.schema is not None:
        reader = reader.schema(spec.schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "true")
    try:
        frame = reader.load(path if isinstance(path, str) else list(path))
        return frame if source_column is None else frame.withColumn(source_column, F.col("_metadata.file_path"))
    except AnalysisException as error:
        raise ScanError(f"cannot read {fmt} at {path}: {str(error).splitlines()[0]}") from error


def scan_baseline(spark: SparkSession, spec: TableSpec) -> DataFrame:
    return scan(spark, spec, spec.baseline_path)


def scan_rejects(spark: SparkSession, spec: TableSpec, path: str) -> DataFrame:
    """Lines that do not fit the declared schema, with the raw text in ``_corrupt_record``.

    The lines found are written out once: a line is only seen to be bad while every column is
    parsed, and a caller may go on to ask for the raw text alone.
    """
    if spec.fmt not in TEXT_FORMATS or spec.schema is None:
        raise ScanError("rejects need a text format and a declared schema")
    wide = T.StructType([*spec.schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = (
        spark.read.format(spec.fmt)
        .options(**spec.options)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .schema(wide)
        .load(path)
    )
    return durable(lines.filter(F.col(CORRUPT).isNotNull()), "rejects")


def list_batches(spark: SparkSession, spec: TableSpec, directory: str) -> DataFrame:
    """Files of the spec's format with size, modification time and batch; contents are not read.

    A batch is what lies directly in the landing folder: a file, or a folder with all its part files.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*.{spec.fmt}")
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", "length", "modificationTime")
    )
    root = re.sub(STORE, "", directory).rstrip("/")
    below = F.substring(F.regexp_replace("path", STORE, ""), len(root) + 2, 2**31 - 1)
    name = F.substring_index(below, "/", 1)
    return files.withColumn("batch", F.concat(F.lit(directory.rstrip("/") + "/"), name))


def latest_batch(spark: SparkSession, spec: TableSpec, directory: str) -> str:
    """The newest batch in the landing folder, by its newest file; the greater path wins a tie."""
    newest = (
        list_batches(spark, spec, directory)
        .agg(F.max_by("batch", F.struct("modificationTime", "path")).alias("batch"))
        .first()["batch"]
    )
    if newest is None:
        raise ScanError(f"no .{spec.fmt} files under {directory}")
    return newest
