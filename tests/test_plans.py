"""Physical plans: what is read, what moves, and that nothing leaves the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from catalog.fixture import ORDERS, base, dirty, table
from tablecare.operators.calibrate import calibrate
from tablecare.operators.fixes import keep_first
from tablecare.operators.gates import rewritten, snapshot
from tablecare.operators.keyflags import duplicate_keys, flag_by_keys
from tablecare.operators import gates, report
from tablecare.operators import validate as validation
from tablecare.operators.report import sample_failures
from tablecare.operators.validate import attribute, validate
from tablecare.plans.registry import Registry
from tablecare.plans.run import run
from tablecare.spec import Fix, RunOptions, between, in_set, not_null, unique


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_schemas(plan):
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>", plan)]


def test_row_rules_share_one_pruned_scan(spark, sf_dir):
    rules = [not_null("l_shipdate"), between("l_quantity", 1, 50), in_set("l_returnflag", ["A", "N", "R"])]
    plan = plan_of(validate(table(spark, sf_dir, "lineitem"), rules))
    assert read_schemas(plan) == [{"l_shipdate", "l_quantity", "l_returnflag"}]
    assert plan.count("Exchange SinglePartition") == 1 and "hashpartitioning" not in plan


def test_uniqueness_shuffles_keys_and_counts_only(spark, sf_dir):
    plan = plan_of(validate(table(spark, sf_dir, "lineitem"), [unique("l_orderkey", "l_linenumber")]))
    assert read_schemas(plan) == [{"l_orderkey", "l_linenumber"}]
    assert "partial_count(1)" in plan and plan.count("hashpartitioning") == 1


def test_reasons_leave_wide_rows_in_place(spark, sf_dir):
    flagged = attribute(dirty(spark, sf_dir), calibrate(base(spark, sf_dir), ORDERS))
    plan = plan_of(flagged)
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_beyond_the_broadcast_limit_hot_and_null_keys_are_spread(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("l_orderkey", F.expr("if(l_orderkey % 3 = 0, 1, l_orderkey)"))
    flagged = flag_by_keys(rows, ["l_orderkey"], duplicate_keys(rows, ["l_orderkey"]), "dup", 0)
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    # The salt stays a join key; it is not folded away into a filter on one side.
    assert re.search(r"Join LeftOuter, \(+__j0#\w+ = __c0#\w+\) AND \(__salt#\d+ = __csalt#\d+\)", plan)
    # Rows of the hot key reach the shuffle with no key but the number of their input partition.
    assert "SPARK_PARTITION_ID" in plan.upper()


@pytest.mark.parametrize("build", ["samples", "keep_first", "status"])
def test_rank_filters_work_before_the_shuffle(spark, sf_dir, build, monkeypatch):
    if build == "samples":
        # the winners are written; what writes them is the plan to look at
        flagged = attribute(dirty(spark, sf_dir), [not_null("customer_id")], [not_null("customer_id")])
        written = []
        monkeypatch.setattr(report, "durable", lambda df, label: written.append(df) or df)
        sample_failures(flagged, ["order_id"])
        df = written[-1]
    elif build == "keep_first":
        df = keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_extendedprice"])
    else:
        df = queries()["candidate_status"](spark, sf_dir)
    plan = plan_of(df)
    assert re.search(r"WindowGroupLimit .*Partial", plan) and re.search(r"WindowGroupLimit .*Final", plan)


def test_gates_read_what_a_repair_can_move(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    fix = Fix("clamp", "l_quantity", {"max": 40})
    assert rewritten(lines, [fix]) == ["l_quantity"]
    assert rewritten(lines, [fix, Fix("custom", None, {"name": "x"})]) == lines.columns
    plan = plan_of(validate(lines, [between("l_quantity", 1, 40)], probe=["l_quantity"]))
    assert read_schemas(plan) == [{"l_quantity"}]
    assert snapshot(lines, []).rows == lines.count()


@pytest.mark.parametrize(
    "name", ["validate_suite", "row_reasons", "fix_replay", "fix_keep_first", "mask_structural", "rules_import",
             "rule_foreign_key", "rule_zscore", "content_dedupe", "suite_diff", "failing_keys_diff", "clean_split"]
)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    plan = plan_of(queries()[name](spark, sf_dir))
    for node in ("EvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_filters_reach_the_files(spark, sf_dir):
    plan = plan_of(queries()["registry_rollback"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_linenumber), EqualTo(l_linenumber,2)]" in plan


def test_samples_move_no_wide_row(spark, sf_dir):
    flagged = attribute(dirty(spark, sf_dir), [not_null("customer_id")], [not_null("customer_id")])
    plan = plan_of(sample_failures(flagged, ["order_id"], max_rows=5000))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "Window" not in plan
    # what is shuffled after the join is one row per winner
    assert plan.index("LeftSemi") > plan.index("hashpartitioning")


def test_a_run_shuffles_an_untouched_key_once(spark, sf_dir, tmp_path, monkeypatch):
    rules = [unique("order_id"), not_null("customer_id"), between("order_amount", 1000, 500000), unique("customer_id", "k")]
    registry = Registry(spark, str(tmp_path / "registry"))
    registry.seed(rules)
    asked = []
    found = validation.bad_keys
    for module in (validation, gates):
        monkeypatch.setattr(module, "bad_keys", lambda df, rule, tables=None: asked.append(rule.columns) or found(df, rule, tables))
    fill = {"not_null on 'customer_id'": [Fix("fill_null", "customer_id", {"value": "UNKNOWN"})]}
    result = run(
        spark, ORDERS, registry, str(tmp_path / "out"), df=dirty(spark, sf_dir), proposed_fixes=fill,
        options=RunOptions(repair_not_drop=True),
    )
    assert result.metadata["iterations_run"] == 2 and result.metadata["failed_rule_count"] >= 3
    # measured, reported, repaired in two rounds, flagged and written; the filled column's key twice
    assert asked.count(("order_id",)) == 1 and asked.count(("customer_id", "k")) == 2
    flagged = attribute(dirty(spark, sf_dir), rules, rules, kept=snapshot(dirty(spark, sf_dir), rules).keys)
    assert "hashpartitioning" not in plan_of(flagged)


def test_versions_are_compared_in_one_pass(spark, sf_dir):
    # both versions were read, made distinct and met twice, three tables of items in one task
    plan = plan_of(queries()["suite_diff"](spark, sf_dir))
    assert plan.count("FileScan") == 1 and plan.count("hashpartitioning") == 1 and "Union" not in plan


def test_rows_to_rank_move_once_and_without_idle_columns(spark, sf_dir):
    key, price = ["l_orderkey", "l_linenumber"], ["l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").withColumn("l_orderkey", F.expr("CASE WHEN l_partkey % 9 > 0 THEN l_orderkey % 500 END"))
    many, few = keep_first(lines, key, price, 0), keep_first(lines, key, price)
    plan = plan_of(many.select(*key, *price))
    # joined with the repeated keys before, each row as wide as the table
    assert "Join" not in plan and plan.count("hashpartitioning") == 1
    assert "l_shipdate" not in plan[: plan.index("hashpartitioning")] and "BroadcastHashJoin" in plan_of(few)
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()
    assert 0 < many.count() < lines.count()
