"""The full pass on every batch of files that lands with new content."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tablecare.plans.registry import Registry
from tablecare.plans.run import run
from tablecare.spec import TableSpec
from tablecare.streaming.arrivals import ContentLedger, run_new_batches
from tablecare.streaming.key_ledger import KeyLedger

SOURCE_FILE = "source_file"


def run_on_arrival(
    spark: SparkSession,
    spec: TableSpec,
    registry: Registry,
    out_root: str,
    directory: str | None = None,
    available_now: bool = True,
    key_ledger: KeyLedger | None = None,
    max_files: int | None = None,
    source_column: str = SOURCE_FILE,
    **run_options: Any,
) -> StreamingQuery:
    """Start a stream over the landing folder that calls ``run`` once per micro-batch.

    All files of a batch go through one run; each row carries its file in ``source_column``
    through reasons, quarantine and clean table, and the run's ``sources`` report counts per file.
    Files whose content went through before are left out. With a ``key_ledger`` rows whose key an
    earlier batch brought get a reason too. ``available_now`` works through what is there and
    ends, which is the scheduled form; without it the stream keeps watching. ``max_files`` bounds a
    batch. Further arguments go to ``run``.
    """
    out_root = out_root.rstrip("/")

    def handle(paths: list[str], batch_id: str) -> None:
        run(
            spark, spec, registry, out_root, source=paths, source_column=source_column, key_ledger=key_ledger,
            batch_id=batch_id, **run_options,
        )

    return run_new_batches(
        spark,
        spec,
        directory or spec.incoming_path,
        ContentLedger(spark, out_root),
        handle,
        f"{out_root}/checkpoints/{spec.name}",
        available_now,
        max_files,
    )
