"""One full pass over an incoming table, and what can be done with its records later."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.operators.calibrate import calibrate
from tablecare.operators.fixes import Transforms, apply_fixes, gathered
from tablecare.operators.gates import Snapshot, snapshot
from tablecare.operators.profile import profile_columns, profiles_frame
from tablecare.operators.report import diagnose, evidence, failure_report
from tablecare.operators.sizing import durable
from tablecare.operators.sketches import SketchStore
from tablecare.operators.validate import REASONS, Tables, measures_frame, validate
from tablecare.plans.loop import LoopOutcome, RuleProposer, heal
from tablecare.plans.registry import Registry
from tablecare.sources.scan import TEXT_FORMATS, ScanError, latest_batch, scan, scan_baseline
from tablecare.sources.sinks import (
    append_report,
    append_run,
    read_routed,
    read_runs,
    write_clean,
    write_quarantine,
    write_routed,
)
from tablecare.spec import Fix, RunOptions, TableSpec
from tablecare.streaming.key_ledger import KeyLedger


@dataclass
class RunResult:
    run_id: str
    metadata: dict
    outcome: LoopOutcome | None
    initial: Snapshot


def new_run_id(name: str) -> str:
    return f"{name}-{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def run(
    spark: SparkSession,
    spec: TableSpec,
    registry: Registry,
    out_root: str,
    source: str | Sequence[str] | None = None,
    df: DataFrame | None = None,
    baseline: DataFrame | None = None,
    options: RunOptions | None = None,
    proposed_fixes: Mapping[str, Sequence[Fix]] | None = None,
    propose_rule: RuleProposer | None = None,
    transforms: Transforms | None = None,
    tables: Tables | None = None,
    source_column: str | None = None,
    key_ledger: KeyLedger | None = None,
    batch_id: str | None = None,
    sketches: SketchStore | None = None,
) -> RunResult:
    """Calibrate once, replay accepted repairs, validate, report, repair, split and record.

    The incoming table is ``df``, else the file or files ``source``, else the newest batch under
    the spec's incoming path. Text input is written out once as a columnar table, because every
    later pass needs only some of its columns. The run's record is written in any case.

    With ``source_column`` every row carries its file, and a report counts rows per file. With a
    ``key_ledger`` and the ``batch_id``, rows whose key an earlier batch brought go to quarantine,
    and the batch's keys are committed at the end. Rows that repairs route aside go to a side
    table under the run. With a sketch store the batch leaves a mergeable profile of its columns
    as they came in.
    """
    options = (options or RunOptions()).resolve(spec)
    out_root = out_root.rstrip("/")
    run_id = new_run_id(spec.name)
    metadata = {
        "run_id": run_id,
        "table_name": spec.name,
        "source_ref": _source_ref(source) or ("(dataframe)" if df is not None else None),
        "started_at": datetime.now(timezone.utc),
        "status": "running",
        "phase_reached": "started",
        "candidates_generated": 0,
        "fixes_replayed": 0,
        "iterations_run": 0,
    }
    try:
        if registry.version("rule") == 0:
            reference = baseline if baseline is not None else scan_baseline(spark, spec)
            registry.seed(calibrate(reference, spec))
        rules = registry.active_rules()
        metadata["phase_reached"] = "baseline_ready"

        if df is None:
            if source is None:
                if spec.incoming_path is None:
                    raise ScanError(f"spec '{spec.name}' names no incoming path")
                source = latest_batch(spark, spec, spec.incoming_path)
            metadata["source_ref"] = _source_ref(source)
            df = scan(spark, spec, source, source_column=source_column)
            if spec.fmt in TEXT_FORMATS:
                df = durable(df, "incoming")

        replay = apply_fixes(df, registry.active_fixes(), transforms)
        metadata["fixes_replayed"] = len(replay.applied)
        df = replay.df

        if sketches is not None:
            sketches.add(df, batch_id or run_id, [f.name for f in spec.fields(df.schema)])
        initial = snapshot(df, rules, tables)
        metadata |= {
            "phase_reached": "validated",
            "total_rows": initial.rows,
            "failed_rule_count": len(initial.failures()),
        }
        batch = _Closing(spec, options, out_root, run_id, metadata, source_column, key_ledger, batch_id)
        if initial.success:
            # replayed repairs may have made it clean, so the result is written here too
            batch.close(df.withColumn(REASONS, F.array().cast("array<string>")), True, 0, [replay.routed])
            metadata |= {"status": "succeeded", "phase_reached": "clean", "stop_reason": "clean"}
            return RunResult(run_id, metadata, None, initial)

        _write_failure_reports(spark, df, rules, spec, initial, options, out_root, run_id, tables)
        metadata["phase_reached"] = "reported"

        if propose_rule is not None and baseline is None:
            baseline = scan_baseline(spark, spec)
        outcome = heal(
            df, spec, registry, run_id, options, baseline, proposed_fixes, propose_rule, transforms, tables, initial
        )
        metadata |= {
            "phase_reached": "repaired",
            "candidates_generated": len(outcome.candidate_ids),
            "iterations_run": outcome.loops_run,
            "stop_reason": outcome.stop_reason,
        }
        batch.close(outcome.flagged, outcome.state.success, outcome.loops_run, [replay.routed, outcome.routed])
        _write_outcome(spark, outcome, out_root, run_id)
        metadata |= {"status": "succeeded", "phase_reached": "closed"}
        return RunResult(run_id, metadata, outcome, initial)
    except Exception as error:
        metadata |= {"status": "failed", "error": str(error)}
        raise
    finally:
        metadata["finished_at"] = datetime.now(timezone.utc)
        append_run(spark, out_root, metadata)


def _source_ref(source: str | Sequence[str] | None) -> str | None:
    """One path as it is, several as a JSON list."""
    return source if source is None or isinstance(source, str) else json.dumps(list(source))


def _sources(source_ref: str) -> str | list[str]:
    return json.loads(source_ref) if source_ref.startswith("[") else source_ref


@dataclass
class _Closing:
    """What a run writes at its end: quarantine, clean rows, rows routed aside, counts per file, keys."""

    spec: TableSpec
    options: RunOptions
    out_root: str
    run_id: str
    metadata: dict
    source_column: str | None
    key_ledger: KeyLedger | None
    batch_id: str | None

    def close(self, flagged: DataFrame, clean: bool, loops: int, routed: Sequence[DataFrame | None]) -> None:
        if self.key_ledger is not None:
            batch_id = self.batch_id or self.run_id
            flagged = self.key_ledger.add_reason(flagged, batch_id)
        if self.key_ledger is not None or self.source_column is not None:
            flagged = durable(flagged, "flagged")  # read several times below
        if self.key_ledger is not None:
            clean = flagged.filter(F.size(REASONS) > 0).isEmpty()
        if self.options.export_quarantined and not clean:
            self.metadata["quarantine_path"] = write_quarantine(flagged, self.out_root, self.run_id, loops)
        write_clean(flagged, self.out_root, self.run_id)
        aside = gathered([r for r in routed if r is not None])
        if aside is not None:
            write_routed(aside, self.out_root, self.run_id)
            self.metadata["routed_rows"] = read_routed(flagged.sparkSession, self.out_root, self.run_id).count()
        if self.source_column is not None:
            counts = flagged.groupBy(F.col(self.source_column).alias("source_file")).agg(
                F.count(F.lit(1)).alias("row_count"), F.count_if(F.size(REASONS) > 0).alias("quarantined_rows")
            )
            append_report(counts, self.out_root, "sources", self.run_id)
        if self.key_ledger is not None:
            self.key_ledger.commit(flagged, batch_id)


def _write_failure_reports(spark, df, rules, spec, initial, options, out_root, run_id, tables) -> None:
    measures = list(initial.measures.values())
    result = measures_frame(spark, measures)
    # the report shows the columns of failed rules, so no other is profiled
    asked = {c for m in measures if not m.success for c in m.rule.columns}
    names = [f.name for f in spec.fields(df.schema) if f.name in asked]
    profiles = profile_columns(df, names, options.profile_distinct, options.profile_median)
    report = failure_report(
        df, rules, spec, measures, None, profiles, options.max_sample_rows, options.mask_pii, tables, initial.keys
    )
    # Short by construction, and read three times below.
    report = durable(report, "report")
    append_report(report, out_root, "failure_report", run_id)
    append_report(evidence(report, spec), out_root, "evidence", run_id)
    append_report(diagnose(result, profiles_frame(spark, profiles)), out_root, "diagnosis", run_id)


def _write_outcome(spark, outcome: LoopOutcome, out_root: str, run_id: str) -> None:
    measures = list(outcome.state.measures.values())
    append_report(measures_frame(spark, measures), out_root, "post_repair", run_id)
    append_report(iteration_history(spark, outcome), out_root, "iterations", run_id)


def iteration_history(spark: SparkSession, outcome: LoopOutcome) -> DataFrame:
    rows = [
        (i["loop"], i["remaining_failures"], i["remaining_rows"], json.dumps(i["candidates"]))
        for i in outcome.iterations
    ]
    return spark.createDataFrame(
        rows, "loop bigint, remaining_failures bigint, remaining_rows bigint, candidates string"
    )


def revalidate(
    spark: SparkSession,
    spec: TableSpec,
    registry: Registry,
    out_root: str,
    run_id: str,
    transforms: Transforms | None = None,
    tables: Tables | None = None,
    df: DataFrame | None = None,
) -> DataFrame:
    """After a promotion: read the run's source again, replay what is accepted, validate."""
    if df is None:
        recorded = read_runs(spark, out_root).filter(f"run_id = '{run_id}'").first()
        if recorded is None:
            raise ValueError(f"no run '{run_id}'")
        df = scan(spark, spec, _sources(recorded["source_ref"]))
    replay = apply_fixes(df, registry.active_fixes(), transforms)
    result = validate(replay.df, registry.active_rules(), tables)
    # short, and both written and returned
    result = durable(result, "post-approval")
    append_report(result, out_root, "post_approval", run_id)
    return result
