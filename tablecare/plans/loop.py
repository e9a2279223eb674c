"""The repair loop: measure, plan, gate, accept, measure again until nothing moves."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.typed import col
from tablecare.operators.fixes import Transforms, gathered, plan_fixes, routed_rows
from tablecare.operators.gates import GateResult, Snapshot, check_fixes, check_rules, independent, snapshot
from tablecare.operators.profile import profile_columns
from tablecare.operators.sizing import durable
from tablecare.operators.validate import Measure, Tables, attribute, failing_keys
from tablecare.plans.registry import Registry
from tablecare.spec import Fix, Rule, RunOptions, TableSpec

# Repairs after which the table is written out: they shuffle, or hide what they do.
_BARRIERS = ("keep_first", "custom")

RuleProposer = Callable[[Measure], "Rule | None"]


@dataclass
class LoopOutcome:
    df: DataFrame
    flagged: DataFrame
    state: Snapshot
    loops_run: int
    stop_reason: str
    accepted: list[Fix] = field(default_factory=list)
    gates: list[GateResult] = field(default_factory=list)
    candidate_ids: list[str] = field(default_factory=list)
    iterations: list[dict] = field(default_factory=list)
    # rows that accepted repairs took out of the table, with the fix id
    routed: DataFrame | None = None


def same_keys(a: DataFrame, b: DataFrame) -> bool:
    """Do two frames of distinct keys hold the same keys? Null-safe."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def failing_keys_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that stopped failing and keys that started to."""
    return (
        before.exceptAll(after)
        .withColumn("change", F.lit("resolved"))
        .unionByName(after.exceptAll(before).withColumn("change", F.lit("new")))
    )


def key_fingerprint(keys: DataFrame) -> tuple[int, int]:
    """Number of keys and an order-free digest; different digests prove different key sets."""
    row = keys.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*[col(c) for c in keys.columns])).alias("h")
    ).first()
    return row["n"], row["h"] or 0


def repair_round(
    df: DataFrame,
    state: Snapshot,
    rules: Sequence[Rule],
    options: RunOptions,
    proposed: Mapping[str, Sequence[Fix]] | None,
    transforms: Transforms | None,
    tables: Tables | None,
    tried: set[str],
    order: Sequence[str] = (),
    routed: list[DataFrame] | None = None,
) -> tuple[DataFrame, Snapshot, list[GateResult]]:
    """Try the planned repairs of every failed rule, next choice after a rejection.

    Repairs that cannot influence each other share one measuring pass. ``tried`` holds repairs
    rejected on this very table; they are not measured again until it changes. Rows that an
    accepted repair routes aside are written and added to ``routed``.
    """
    failures = state.failures()
    columns = list(dict.fromkeys(c for m in failures if m.rule.level == "row" for c in m.rule.columns))
    profiles = profile_columns(df, columns, distinct="none") if columns else []
    plan = plan_fixes(
        failures, profiles, df.schema, options.repair_not_drop, proposed, order, options.quarantine_failures
    )
    queues = [(m.rule, list(plan[m.rule.rule_id])) for m in failures]
    results: list[GateResult] = []
    while True:
        heads = []
        for rule, queue in queues:
            # Another repair of this round may have settled the rule in passing.
            if state.measures[rule.rule_id].success:
                queue.clear()
            while queue and queue[0].fix_id in tried:
                queue.pop(0)
            if queue:
                heads.append((queue[0], rule))
        if not heads:
            return df, state, results
        wave, whole = independent(heads, rules), df
        df, state, outcome = check_fixes(
            df, state, rules, wave, options.repair_not_drop, transforms, tables
        )
        results += outcome
        if any(r.passed for r in outcome):
            tried.clear()
        if routed is not None:
            moved = [r.fix for r in outcome if r.passed and r.fix.action == "quarantine_where"]
            routed += [durable(routed_rows(whole, fix), "routed") for fix in moved]
        for result in outcome:
            queue = next(q for rule, q in queues if rule.rule_id == result.rule.rule_id)
            queue.pop(0)
            if result.passed:
                queue.clear()
            else:
                tried.add(result.fix.fix_id)
        if any(r.passed and r.fix.action in _BARRIERS for r in outcome):
            df = durable(df, "repaired")


def heal(
    df: DataFrame,
    spec: TableSpec,
    registry: Registry,
    run_id: str,
    options: RunOptions | None = None,
    baseline: DataFrame | None = None,
    proposed_fixes: Mapping[str, Sequence[Fix]] | None = None,
    propose_rule: RuleProposer | None = None,
    transforms: Transforms | None = None,
    tables: Tables | None = None,
    state: Snapshot | None = None,
) -> LoopOutcome:
    """Repair rounds until clean, stuck or capped.

    ``stop_reason`` is, in this order of testing, ``clean``, ``no_progress`` (two rounds in a row
    leave exactly the same keys failing), ``max_loops_reached`` or ``single_pass_mode``.
    A passing repair always changes the table at hand; it is registered only when repairs are
    promoted automatically. The bad keys of every key rule live in the snapshot until a repair
    touches the rule, and the failing keys of a round are a written table.
    """
    options = (options or RunOptions()).resolve(spec)
    rules = registry.active_rules()
    state = state if state is not None else snapshot(df, rules, tables)
    outcome = LoopOutcome(df, df, state, 0, "clean")
    flagged = attribute(df, rules, [], tables)
    previous: tuple[DataFrame, tuple[int, int]] | None = None
    routed: list[DataFrame] = []
    tried: set[str] = set()
    proposed_before: set[str] = set()

    while not outcome.state.success:
        outcome.loops_run += 1
        loop = outcome.loops_run
        candidate_ids: list[str] = []
        suite_changed = False

        if propose_rule is not None and baseline is not None:
            fresh: dict[Rule, str] = {}
            for failure in outcome.state.failures():
                rule = propose_rule(failure)
                if rule is not None and rule not in rules and rule.rule_id not in proposed_before:
                    proposed_before.add(rule.rule_id)
                    fresh[rule] = failure.rule.rule_id
            checks = check_rules(baseline, list(fresh), tables)
            checked = [
                (rule, source, check.passed, check.note)
                for (rule, source), check in zip(fresh.items(), checks, strict=True)
            ]
            ids = registry.add_candidates(run_id, loop, checked)
            candidate_ids += ids
            passing = [i for i, (_, _, passed, _) in zip(ids, checked, strict=True) if passed]
            if passing and options.rule_promotion == "auto":
                registry.promote(passing, "system:auto")
                suite_changed = True

        outcome.df, outcome.state, gates = repair_round(
            outcome.df, outcome.state, rules, options, proposed_fixes, transforms, tables, tried, routed=routed
        )
        accepted = [g.fix for g in gates if g.passed]
        ids = registry.add_gate_results(run_id, loop, gates)
        candidate_ids += ids
        if accepted and options.fix_promotion == "auto":
            registry.promote([i for i, g in zip(ids, gates, strict=True) if g.passed], "system:auto")
        outcome.accepted += accepted
        outcome.gates += gates

        if suite_changed:
            # A newly accepted rule counts from this round's measurement on.
            rules = registry.active_rules()
            outcome.state = snapshot(outcome.df, rules, tables)
        if accepted or suite_changed or previous is None:
            failed = [m.rule for m in outcome.state.failures()]
            flagged = attribute(outcome.df, rules, failed, tables, kept=outcome.state.keys)
            keys = durable(failing_keys(flagged, spec.primary_key), "failing-keys")
            current = (keys, key_fingerprint(keys))
            stuck = previous is not None and current[1] == previous[1] and same_keys(current[0], previous[0])
        else:
            current, stuck = previous, True

        outcome.candidate_ids += candidate_ids
        outcome.iterations.append(
            {
                "loop": loop,
                "remaining_failures": len(outcome.state.failures()),
                "remaining_rows": current[1][0],
                "candidates": candidate_ids,
            }
        )
        if outcome.state.success:
            outcome.stop_reason = "clean"
            break
        if stuck:
            outcome.stop_reason = "no_progress"
            break
        if loop >= options.max_loops:
            outcome.stop_reason = "max_loops_reached"
            break
        if not options.loop_until_clean:
            outcome.stop_reason = "single_pass_mode"
            break
        previous = current

    outcome.flagged, outcome.routed = flagged, gathered(routed)
    return outcome


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Unexpected counts of two validations side by side, per rule."""
    a = before.select("rule_id", F.col("unexpected_count").alias("before_count"))
    b = after.select("rule_id", F.col("unexpected_count").alias("after_count"))
    return a.join(b, "rule_id", "full").withColumn(
        "delta",
        F.coalesce("after_count", F.lit(0).cast("bigint")) - F.coalesce("before_count", F.lit(0).cast("bigint")),
    )
