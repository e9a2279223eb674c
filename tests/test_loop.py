"""The repair loop's stopping cases and full runs, on real tables."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from catalog.fixture import ORDER_COLUMNS, ORDERS, base, dirty
from tablecare.plans.loop import heal, same_keys
from tablecare.plans.registry import Registry
from tablecare.plans.run import revalidate, run
from tablecare.sources.scan import ScanError, scan
from tablecare.sources.sinks import read_quarantine, read_report, read_runs, run_history
from tablecare.spec import Fix, RunOptions, TableSpec, between, in_set, not_null

SPEC = TableSpec("t", ("id",))
KEEP = RunOptions(repair_not_drop=True)


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(
        [(i, None if i < 3 else f"n{i}", float(i) if i != 9 else 900.0) for i in range(10)],
        "id int, name string, x double",
    )


@pytest.fixture()
def registry(spark, tmp_path):
    return Registry(spark, str(tmp_path / "registry"))


NAMES, RANGE = not_null("name"), between("x", 0, 10)
FILL = {NAMES.reason: [Fix("fill_null", "name", {"value": "?"})]}


def start(registry, table, rules, options=KEEP, **more):
    registry.seed(rules)
    return heal(table, SPEC, registry, "run-1", options, **more)


def test_clean_from_the_start(registry, table):
    outcome = start(registry, table, [between("id", 0, 9)])
    assert (outcome.stop_reason, outcome.loops_run, outcome.candidate_ids) == ("clean", 0, [])
    assert outcome.flagged.filter(F.size("dq_reasons") > 0).isEmpty()


def test_clean_as_soon_as_a_round_settles_it(registry, table):
    outcome = start(registry, table, [NAMES, RANGE], proposed_fixes=FILL)
    assert (outcome.stop_reason, outcome.loops_run) == ("clean", 1)
    assert outcome.df.count() == 10 and outcome.df.filter("name IS NULL OR x > 10").isEmpty()
    assert [f.action for f in registry.active_fixes()] == ["fill_null", "impute_median"]


def test_no_progress(registry, table):
    outcome = start(registry, table, [NAMES])
    assert (outcome.stop_reason, outcome.loops_run) == ("no_progress", 2)
    assert [i["remaining_rows"] for i in outcome.iterations] == [3, 3]


def test_progress_until_the_cap(registry, table):
    """A repair that cures one row per round, by its position, is progress every time."""
    nibble = [
        Fix("replace_where", "name", {"predicate": f"id = {i} AND name IS NULL", "value": "?"}) for i in range(3)
    ]
    proposed: dict = {NAMES.reason: nibble}
    outcome = start(registry, table, [NAMES], dataclasses.replace(KEEP, max_loops=2), proposed_fixes=proposed)
    assert (outcome.stop_reason, outcome.loops_run) == ("max_loops_reached", 2)
    assert [i["remaining_rows"] for i in outcome.iterations] == [2, 1]


def test_single_pass(registry, table):
    outcome = start(registry, table, [NAMES], dataclasses.replace(KEEP, loop_until_clean=False))
    assert (outcome.stop_reason, outcome.loops_run) == ("single_pass_mode", 1)


def test_single_pass_that_cleans_says_so(registry, table):
    options = dataclasses.replace(KEEP, loop_until_clean=False)
    assert start(registry, table, [NAMES], options, proposed_fixes=FILL).stop_reason == "clean"


def test_candidates_carry_their_round(registry, table):
    # The first choice is refused, the next one passes; both are on record.
    proposed = {NAMES.reason: [Fix("fill_null", "name", {"value": None}), *FILL[NAMES.reason]]}
    outcome = start(registry, table, [NAMES], proposed_fixes=proposed)
    rows = registry.candidates(None).orderBy("passed").collect()
    assert [(r["iteration"], r["passed"], r["status"]) for r in rows] == [
        (1, False, "pending"), (1, True, "auto_promoted"),
    ]
    assert {r["candidate_id"] for r in rows} == set(outcome.candidate_ids)


def test_manual_mode_repairs_the_table_but_registers_nothing(registry, table):
    options = dataclasses.replace(KEEP, fix_promotion="manual")
    outcome = start(registry, table, [NAMES], options, proposed_fixes=FILL)
    assert outcome.stop_reason == "clean" and registry.active_fixes() == []
    assert registry.candidates("pending").count() == 1


def test_accepted_rules_count_from_their_round_on(registry, table):
    options = dataclasses.replace(KEEP, rule_promotion="auto")
    rules = {NAMES.rule_id: in_set("name", [f"n{i}" for i in range(3, 10)]), RANGE.rule_id: between("id", 0, 2)}
    outcome = start(
        registry, table, [NAMES, RANGE], options, proposed_fixes=FILL, baseline=table.filter("id BETWEEN 3 AND 8"),
        propose_rule=lambda failure: rules[failure.rule.rule_id] if failure.rule.rule_id in rules else None,
    )
    # The set spares the baseline and now flags the stand-in name; the other flags the baseline.
    assert registry.active_rules() == [NAMES, RANGE, rules[NAMES.rule_id]]
    assert outcome.stop_reason == "no_progress" and outcome.iterations[0]["remaining_rows"] == 3


def test_key_sets_compare_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert same_keys(a, a.orderBy("a"))
    assert not same_keys(a, a.filter("b IS NOT NULL"))


def test_spec_overrides_global_options():
    spec = TableSpec("t", ("id",), overrides={"rule_promotion": "auto", "max_loops": 2})
    assert RunOptions(max_loops=7).resolve(spec) == RunOptions(rule_promotion="auto", max_loops=2)
    for wrong in ({"no_option": 1}, {"fix_promotion": "sometimes"}):
        with pytest.raises(ValueError):
            RunOptions().resolve(TableSpec("t", ("id",), overrides=wrong))


def test_full_run_on_csv_files(spark, sf_dir, tmp_path):
    """Baseline and newest batch as files; approve, replay and measure again."""
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    base(spark, sf_dir).select(*ORDER_COLUMNS).write.option("header", "true").csv(str(tmp_path / "baseline"))
    dirty(spark, sf_dir).select(*ORDER_COLUMNS).coalesce(1).write.option("header", "true").csv(landing)
    spec = dataclasses.replace(ORDERS, baseline_path=str(tmp_path / "baseline"), incoming_path=landing)
    registry = Registry(spark, str(tmp_path / "registry"))
    proposed = {"not_null on 'customer_id'": [Fix("fill_null", "customer_id", {"value": "UNKNOWN"})]}
    options = dataclasses.replace(KEEP, fix_promotion="manual")

    first = run(spark, spec, registry, out, options=options, proposed_fixes=proposed)
    assert first.metadata["failed_rule_count"] == 8 and first.metadata["stop_reason"] == "no_progress"
    assert read_report(spark, out, "failure_report", first.run_id).count() == 8
    assert read_report(spark, out, "diagnosis").filter("failure_category = 'Temporal Anomaly'").count() == 1
    samples = read_report(spark, out, "failure_report").filter("column = 'customer_email'").first()["samples"]
    assert all(set(s["customer_email"]) <= set("x_.@") for s in samples)
    left = read_quarantine(spark, out, first.run_id)
    clean = spark.read.parquet(f"{out}/clean/run_id={first.run_id}")
    assert left.filter("Reason = ''").isEmpty()
    assert left.count() + clean.count() == dirty(spark, sf_dir).count()

    # One approved repair: one failing rule less, on the source as it was.
    chosen = registry.candidates().filter("column = 'customer_id'").first()["candidate_id"]
    registry.promote(chosen, "user:ann")
    after = revalidate(spark, spec, registry, out, first.run_id)
    assert after.filter("NOT success").count() == 7

    second = run(spark, spec, registry, out, options=options)
    assert (second.metadata["fixes_replayed"], second.metadata["failed_rule_count"]) == (1, 7)
    history = run_history(read_runs(spark, out), "orders").collect()
    assert {r["run_id"] for r in history} == {first.run_id, second.run_id}

    with pytest.raises(ScanError):
        run(spark, spec, registry, out, source=str(tmp_path / "nowhere.csv"))
    failed = read_runs(spark, out).filter("status = 'failed'").first()
    assert "nowhere.csv" in failed["error"]


def test_scan_refuses_unknown_formats(spark):
    with pytest.raises(ScanError):
        scan(spark, dataclasses.replace(ORDERS, fmt="xls"), "/nowhere")
