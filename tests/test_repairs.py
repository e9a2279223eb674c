"""Repairs and gates: every gate with a passing and a failing case."""

import pytest
from pyspark.sql import functions as F

from tablecare.operators.calibrate import related_rules
from tablecare.operators.fixes import apply_fix, apply_fixes, keep_first, plan_fixes, template_fix
from tablecare.operators.gates import (
    check_fixes,
    check_rule,
    check_rules,
    import_rules,
    independent,
    judge,
    resolve_kind,
    rules_from_import,
    snapshot,
    touches,
    trial,
)
from tablecare.operators.profile import ColumnProfile, profile_columns
from tablecare.operators.validate import measure
from tablecare.spec import (
    Fix,
    FixError,
    Rule,
    TableSpec,
    between,
    in_set,
    length_between,
    matches,
    not_null,
    rule_param,
    unique,
)


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(i, f"c{i}" if i % 5 else None, float(i), "CARD" if i % 4 else "BAD") for i in range(40)]
    rows[7] = (7, "c7", -50.0, "CARD")
    rows[9] = (8, "c9", None, "CARD")  # repeats the key 8, and lacks an amount
    return spark.createDataFrame(rows, "id int, customer string, amount double, method string")


RULES = [not_null("customer"), between("amount", 0, 35), in_set("method", ["CARD"]), unique("id"), not_null("amount")]


def gate(df, fix, rule, keep_rows=True, transforms=None, rules=RULES):
    after, state, (result,) = check_fixes(df, snapshot(df, rules), rules, [(fix, rule)], keep_rows, transforms)
    return after, state, result


def profile_of(column, dtype, median):
    value = {"median_ts": median} if dtype.startswith("timestamp") else {"median_num": median}
    return ColumnProfile(column, dtype, 50000, 0, 0.0, **value)


# -- template ------------------------------------------------------------------------------


def test_template_needs_both_bounds_and_a_median():
    rule = between("order_amount", 10.01, 500.0)
    fix = template_fix(rule, profile_of("order_amount", "double", 253.9))
    assert fix.action == "impute_median" and fix.params == {"min": 10.01, "max": 500.0, "median": 253.9}
    assert template_fix(rule, profile_of("order_amount", "double", None)) is None
    assert template_fix(rule, None) is None
    assert template_fix(between("order_amount", min=1), profile_of("order_amount", "double", 1.5)) is None
    assert template_fix(matches("email", "^x$"), profile_of("email", "string", None)) is None


def test_imputed_times_compare_as_times(spark):
    df = spark.createDataFrame(
        [("2026-08-01 00:00:00",), ("2099-01-01 00:00:00",), (None,), ("2026-07-29 16:00:01",)], "s string"
    ).select(F.col("s").cast("timestamp_ntz").alias("t"))
    rule = between("t", "2026-07-29T16:00:01", "2026-08-05T16:00:00")
    out = apply_fix(df, template_fix(rule, profile_of("t", "timestamp_ntz", "2026-08-02T03:58:13")))
    assert sorted(str(r["t"]) for r in out.collect()) == [
        "2026-07-29 16:00:01", "2026-08-01 00:00:00", "2026-08-02 03:58:13", "None",
    ]
    assert out.schema == df.schema


# -- actions -------------------------------------------------------------------------------


def test_integer_columns_keep_their_type(spark):
    df = spark.createDataFrame([(1,), (900,), (None,)], "x int")
    out = apply_fix(df, Fix("impute_median", "x", {"min": 0, "max": 10, "median": 4.0}))
    assert [r["x"] for r in out.collect()] == [1, 4, None] and out.schema == df.schema


def test_fix_declarations_are_checked(orders):
    for make in (
        lambda: Fix("no_such_action", "id"),
        lambda: Fix("fill_null", "id"),
        lambda: Fix("drop_where", "id"),
        lambda: Fix("clamp", "id"),
        lambda: Fix("trim"),
    ):
        with pytest.raises(FixError):
            make()
    for fix in (
        Fix("trim", "amount"),
        Fix("fill_null", "nothing", {"value": 1}),
        Fix("fill_null", "amount", {"value": "much"}),
        Fix("custom", None, {"name": "unknown"}),
        Fix("drop_where", None, {"rule": rule_param(unique("id"))}),
    ):
        with pytest.raises(FixError):
            apply_fix(orders, fix)


def test_fix_survives_its_stored_form():
    fix = Fix("map_values", "method", {"mapping": {"a": "b"}}, "why")
    assert Fix.load(fix.action, fix.column, fix.params_json, fix.description) == fix


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_keep_first_with_a_hot_key(spark, limit):
    """A third of the rows share one key, a third have none."""
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 30).alias("key"),
        F.col("id").alias("rank"),
    )
    out = keep_first(df, ["key"], ["rank"], limit)
    kept = {r["key"]: r["rank"] for r in out.filter("key IS NOT NULL").collect()}
    assert kept[0] == 0 and all(kept[k] == k for k in kept if k)
    assert out.filter("key IS NOT NULL").count() == len(kept)
    assert out.filter("key IS NULL").count() == 300


def test_replay_skips_what_no_longer_fits(orders):
    fixes = [
        Fix("fill_null", "customer", {"value": "?"}),
        Fix("fill_null", "gone", {"value": "?"}),
        Fix("replace_where", "method", {"predicate": "no_such_column = 1", "value": "x"}),
        Fix("custom", None, {"name": "shrink"}),
        Fix("lower", "method"),
    ]
    replay = apply_fixes(orders, fixes, {"shrink": lambda df: df.select("id")})
    assert [f.action for f in replay.applied] == ["fill_null", "lower"]
    assert len(replay.skipped) == 3 and replay.df.columns == orders.columns


# -- gates ---------------------------------------------------------------------------------


def test_efficacy(orders):
    ok, part, none = (
        Fix("clamp", "amount", {"min": 0, "max": 35}),
        Fix("clamp", "amount", {"min": 0}),
        Fix("fill_null", "amount", {"value": 1}),
    )
    _, state, result = gate(orders, ok, RULES[1])
    assert result.passed and (result.before_count, result.after_count) == (5, 0)
    assert state.measures[RULES[1].rule_id].success
    assert gate(orders, part, RULES[1])[2].passed
    after, _, result = gate(orders, none, RULES[1])
    assert not result.passed and "changed nothing" in result.note and after is orders


def test_row_preservation(orders):
    drop = Fix("drop_where", None, {"rule": rule_param(RULES[0])})
    result = gate(orders, drop, RULES[0])[2]
    assert not result.passed and "deleted 8 rows" in result.note
    after, state, result = gate(orders, drop, RULES[0], keep_rows=False)
    assert result.passed and result.rows_after == 32 == state.rows == after.count()


def test_schema_and_evaluation(orders):
    transforms = {
        "lose": lambda df: df.drop("method"),
        "retype": lambda df: df.withColumn("amount", F.col("amount").cast("string")),
        "late": lambda df: df.withColumn("amount", F.when(F.col("id") == 39, F.lit("x")).otherwise("1").cast("int").cast("double")),
        "add": lambda df: df.fillna({"customer": "?"}).withColumn("extra", F.lit(1)),
    }
    notes = {}
    for name in transforms:
        result = gate(orders, Fix("custom", None, {"name": name}), RULES[0], True, transforms)[2]
        notes[name] = (result.passed, result.note)
    assert notes["add"] == (True, "accepted")
    assert "dropped columns ['method']" in notes["lose"][1]
    assert "changed the type" in notes["retype"][1]
    assert not notes["late"][0] and "does not run" in notes["late"][1]


def test_trial_is_only_an_early_exit(orders):
    late = {"late": lambda df: df.withColumn("amount", F.when(F.col("id") == 39, F.lit("x")).otherwise("1").cast("int").cast("double"))}
    fix = Fix("custom", None, {"name": "late"})
    assert trial(orders.coalesce(1), fix, late, rows=20) is None
    assert "does not run" in trial(orders, fix, late)


def test_no_collateral(orders):
    empty = Fix("null_out", "amount", {"rule": rule_param(RULES[1])})
    result = gate(orders, empty, RULES[1])[2]
    assert not result.passed and "made worse: not_null on 'amount'" in result.note
    _, _, (allowed,) = check_fixes(orders, snapshot(orders, RULES), RULES, [(empty, RULES[1])], True, protect=False)
    assert allowed.passed


def test_aggregate_rules_count_distance(orders):
    rule = Rule("mean_between", ("amount",), {"max": 10})
    closer = Fix("clamp", "amount", {"max": 20})
    assert gate(orders, closer, rule, rules=[rule])[2].passed
    assert not gate(orders, Fix("fill_null", "amount", {"value": 500}), rule, rules=[rule])[2].passed


def test_joint_gating_gives_the_verdicts_of_single_gating(orders):
    pairs = [
        (Fix("fill_null", "customer", {"value": "?"}), RULES[0]),
        (Fix("clamp", "amount", {"min": 0, "max": 35}), RULES[1]),
        (Fix("map_values", "method", {"mapping": {"WORSE": "CARD"}}), RULES[2]),
    ]
    assert independent(pairs, RULES) == pairs
    before = snapshot(orders, RULES)
    after, state, joint = check_fixes(orders, before, RULES, pairs, True)
    single = [check_fixes(orders, before, RULES, [p], True)[2][0] for p in pairs]
    assert [(r.passed, r.after_count) for r in joint] == [(r.passed, r.after_count) for r in single]
    assert [r.passed for r in joint] == [True, True, False]
    assert {k: m.unexpected_count for k, m in state.measures.items()} == {
        m.rule.rule_id: m.unexpected_count for m in measure(after, RULES)
    }


def test_repairs_that_meet_are_gated_apart():
    a, b = Fix("lower", "x"), Fix("upper", "x")
    c, drop = Fix("trim", "y"), Fix("drop_where", None, {"predicate": "x = 1"})
    rule = matches("x", "a")
    assert independent([(a, rule), (b, rule), (c, rule), (drop, rule)], [rule]) == [(a, rule), (c, rule)]
    assert independent([(drop, rule), (a, rule)], [rule]) == [(drop, rule)]
    both = Rule("pair_equal", ("x", "y"))
    assert independent([(a, rule), (c, rule)], [rule, both]) == [(a, rule)]
    assert touches(both, c) and not touches(rule, c)


def test_one_repair_that_breaks_does_not_sink_the_others(orders):
    pairs = [
        (Fix("fill_null", "customer", {"value": "?"}), RULES[0]),
        (Fix("replace_where", "method", {"predicate": "CAST(method AS INT) = 1", "value": "CARD"}), RULES[2]),
    ]
    _, _, results = check_fixes(orders, snapshot(orders, RULES), RULES, pairs, True)
    assert [r.passed for r in results] == [True, False]
    assert "does not run" in results[1].note


def test_plan(orders):
    failures = [m for m in measure(orders, RULES) if not m.success]
    profiles = profile_columns(orders, ["customer", "amount", "method"], distinct="none")
    keep = plan_fixes(failures, profiles, orders.schema, True)
    assert [f.action for f in keep[RULES[1].rule_id]] == ["impute_median"]
    assert keep[RULES[0].rule_id] == [] and keep[RULES[3].rule_id] == []
    proposed = {RULES[0].reason: [Fix("fill_null", "customer", {"value": "?"})]}
    drop = plan_fixes(failures, profiles, orders.schema, False, proposed)
    assert [f.action for f in drop[RULES[0].rule_id]] == ["fill_null", "drop_where"]
    assert [f.action for f in drop[RULES[3].rule_id]] == ["keep_first"]
    assert [f.action for f in drop[RULES[1].rule_id]] == ["impute_median", "drop_where"]


def test_new_rules_must_spare_the_baseline(orders):
    assert check_rule(orders, between("id", 0, 100)).passed
    check = check_rule(orders, between("id", 0, 10))
    assert not check.passed and "/40 rows" in check.note
    assert "does not run" in check_rule(orders, between("method", 1, 2)).note


def test_many_rules_are_checked_as_one_by_one(orders):
    rules = [between("id", 0, 100), between("id", 0, 10), between("id", 0, 100)]
    assert check_rules(orders, rules) == [check_rule(orders, r) for r in rules]
    # One that does not run spoils nothing for the others.
    rules.append(between("method", 1, 2))
    assert [c.passed for c in check_rules(orders, rules)] == [True, False, True, False]
    assert check_rules(orders, []) == []


def test_related_rules(orders):
    propose = related_rules(orders, TableSpec("orders", ("id",)))
    failures = {m.rule.reason: m for m in measure(orders, RULES)}
    assert propose(failures["in_set on 'method'"]) == length_between("method", 3, 4)
    assert propose(failures["between on 'amount'"]) is None  # the table itself lacks an amount
    assert propose(failures["unique on 'id'"]) == not_null("id")


def test_rule_names():
    for name in ("ExpectColumnValuesToBeInSet", "expect_column_values_to_be_in_set", "in_set", "InSet"):
        assert resolve_kind(name) == "in_set"
    assert resolve_kind("expect_string_to_match_regex") is None


def test_imported_rules(spark):
    rows = [
        (1, "ExpectColumnValuesToBeInSet", "method", "{\"value_set\": \"['A, B', 'C']\"}"),
        (2, "expect_column_values_to_be_in_set", "method", '{"value_set": ["A", "B"], "mostly": 0.9}'),
        (3, "between", "amount", '{"min": 10.01, "max": 500}'),
        (4, "matches", "email", '{"regex": "^[A-Za-z]+@x\\\\.com$"}'),
        (5, "in_set", "method", '{"value_set": "[not, valid"}'),
        (6, "in_set", "method", '{"value_set": "[__import__(\'os\').system(\'x\')]"}'),
        (7, "not_null", "id", "no json"),
        (8, "not_null", "id", '{"threshold": 3}'),
    ]
    good, bad = import_rules(spark.createDataFrame(rows, "n int, name string, column string, params string"))
    assert rules_from_import(good.orderBy("n")) == [
        in_set("method", ["A, B", "C"]),
        in_set("method", ["A", "B"], mostly=0.9),
        between("amount", 10.01, 500),
        matches("email", r"^[A-Za-z]+@x\.com$"),
    ]
    assert {r["n"]: r["problem"] for r in bad.collect()} == {
        5: "values are no list", 6: "values are no list", 7: "parameters are no JSON object", 8: "unknown parameter",
    }


def test_judge_is_pure(orders):
    before = snapshot(orders, RULES)
    fix = Fix("fill_null", "customer", {"value": "?"})
    assert not judge(fix, RULES[0], before, before, True).passed


# -- changes beside the target, rows routed aside ------------------------------------------


def test_custom_repairs_answer_for_what_they_change(orders):
    transforms = {
        "fill": lambda df: df.fillna({"customer": "?"}),
        "other column": lambda df: df.fillna({"customer": "?"}).withColumn("amount", F.col("amount") + 1),
        "good rows": lambda df: df.withColumn("customer", F.lit("?")),
        "doubles rows": lambda df: df.fillna({"customer": "?"}).unionByName(df.filter("customer IS NOT NULL").limit(1)),
        "hides": lambda df: df.fillna({"customer": "?"}).select("id", "customer", "amount", "method"),
    }
    results = {n: gate(orders, Fix("custom", None, {"name": n}), RULES[0], True, transforms)[2] for n in transforms}
    assert {n: r.passed for n, r in results.items()} == {n: n == "fill" for n in transforms}
    assert (results["fill"].changed_rows, results["fill"].collateral_rows) == (8, 0)
    assert results["other column"].collateral_rows == 39 and results["good rows"].collateral_rows == 32
    assert "left 33 of 32 rows" in results["doubles rows"].note and "does not know" in results["hides"].note


def test_declared_repairs_count_their_changes(orders):
    result = gate(orders, Fix("clamp", "amount", {"min": 0, "max": 35}), RULES[1])[2]
    assert result.passed and (result.changed_rows, result.collateral_rows) == (5, 0)


def test_key_rules_let_their_rows_change(orders):
    def renumber(df):
        return df.withColumn("id", F.when((F.col("id") == 8) & F.col("amount").isNull(), 99).otherwise(F.col("id")))

    def renumber_more(df):
        return renumber(df).withColumn("id", F.when(F.col("id") == 20, 120).otherwise(F.col("id")))

    transforms = {"one": renumber, "more": renumber_more}
    assert gate(orders, Fix("custom", None, {"name": "one"}), RULES[3], True, transforms)[2].passed
    worse = gate(orders, Fix("custom", None, {"name": "more"}), RULES[3], True, transforms)[2]
    assert not worse.passed and worse.collateral_rows == 1


def test_routing_keeps_every_row_once(orders):
    fix = Fix("quarantine_where", "amount", {"rule": rule_param(RULES[1])})
    after, state, result = gate(orders, fix, RULES[1])
    assert result.passed and (result.rows_before, result.rows_after, result.routed_rows) == (40, 35, 5)
    assert state.rows == after.count() == 35
    replay = apply_fixes(orders, [fix, Fix("quarantine_where", None, {"predicate": "method = 'BAD'"})])
    assert replay.df.count() + replay.routed.count() == 40
    assert {r["fix_id"]: r["count"] for r in replay.routed.groupBy("fix_id").count().collect()}[fix.fix_id] == 5
    assert apply_fixes(orders, []).routed is None
    with pytest.raises(FixError):
        Fix("quarantine_where", "amount")


def test_plan_routes_last_and_only_if_asked(orders):
    failures = [m for m in measure(orders, RULES) if not m.success]
    plain = plan_fixes(failures, [], orders.schema, True)
    routed = plan_fixes(failures, [], orders.schema, True, quarantine_failures=True)
    assert not any(f.action == "quarantine_where" for fixes in plain.values() for f in fixes)
    for rule in RULES:
        assert ([f.action for f in routed[rule.rule_id]][-1:] == ["quarantine_where"]) == (rule.level == "row")
