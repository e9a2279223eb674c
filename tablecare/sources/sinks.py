"""Sinks: quarantine, clean table, reports and run history, all written by the executors."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.operators.validate import REASONS, quarantine, split

RUN_SCHEMA = (
    "run_id string, table_name string, source_ref string, started_at timestamp, finished_at timestamp, "
    "status string, phase_reached string, total_rows bigint, failed_rule_count bigint, "
    "candidates_generated bigint, fixes_replayed bigint, iterations_run bigint, stop_reason string, "
    "quarantine_path string, error string, routed_rows bigint"
)


def write_quarantine(flagged: DataFrame, root: str, run_id: str, loop: int, reasons: str = REASONS) -> str:
    """Append the failing rows, unmasked and with their reasons, under the run's partition."""
    path = f"{root}/quarantine"
    (
        quarantine(flagged, reasons)
        .withColumns({"run_id": F.lit(run_id), "loop": F.lit(loop)})
        .write.mode("append")
        .partitionBy("run_id")
        .parquet(path)
    )
    return path


def read_quarantine(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """One run's quarantine; the filter prunes to its partition."""
    return spark.read.parquet(f"{root}/quarantine").filter(F.col("run_id") == run_id)


def write_clean(flagged: DataFrame, root: str, run_id: str, reasons: str = REASONS) -> str:
    """The rows without a reason, repaired, as a table per run."""
    path = f"{root}/clean/run_id={run_id}"
    split(flagged, reasons)[0].write.mode("errorifexists").parquet(path)
    return path


def write_routed(routed: DataFrame, root: str, run_id: str) -> str:
    """Append the rows that repairs routed aside, with the fix id, under the run's partition."""
    path = f"{root}/routed"
    routed.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return path


def read_routed(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/routed").filter(F.col("run_id") == run_id)


def append_report(report: DataFrame, root: str, name: str, run_id: str) -> None:
    """Append a short report (failures, diagnoses, loop history, ...) keyed by its run."""
    report.withColumn("run_id", F.lit(run_id)).coalesce(1).write.mode("append").partitionBy("run_id").json(
        f"{root}/reports/{name}"
    )


def read_report(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    frame = spark.read.json(f"{root}/reports/{name}")
    return frame if run_id is None else frame.filter(F.col("run_id") == run_id)


def empty_where_missing(spark: SparkSession, error: AnalysisException, schema: str) -> DataFrame:
    """An empty table if ``error`` says that nothing was written yet; every other error goes on."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error
    return spark.createDataFrame([], schema)


def append_run(spark: SparkSession, root: str, metadata: Mapping[str, Any]) -> None:
    names = [part.split()[0] for part in RUN_SCHEMA.split(", ")]
    row = spark.createDataFrame([tuple(metadata.get(n) for n in names)], RUN_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(f"{root}/runs")


def run_history(runs: DataFrame, table_name: str | None = None) -> DataFrame:
    """Recorded runs, newest first."""
    chosen = runs if table_name is None else runs.filter(F.col("table_name") == table_name)
    return chosen.orderBy(F.col("run_id").desc())


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(RUN_SCHEMA).parquet(f"{root}/runs")
    except AnalysisException as error:
        return empty_where_missing(spark, error, RUN_SCHEMA)
