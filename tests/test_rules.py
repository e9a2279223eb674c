"""Rule semantics on small tables, and the key-flag regimes against a plain window count."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.fixture import ORDERS, base, dirty, table
from tablecare.operators.calibrate import calibrate, suite_frame, suite_from_frame
from tablecare.operators.keyflags import duplicate_keys, flag_by_keys, orphan_keys
from tablecare.operators.rules import row_check
from tablecare.operators.validate import attribute, dry_run, measure, reason_counts, split, validate, violations
from tablecare.spec import (
    Rule,
    RuleError,
    TableSpec,
    between,
    dedupe_rules,
    foreign_key,
    in_set,
    length_between,
    matches,
    not_null,
    schema_of,
    unique,
    where,
)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, "a", 1.0), (2, "b", 5.0), (2, None, 9.0), (None, "c", None), (None, "a", float("nan"))]
    return spark.createDataFrame(rows, "id bigint, name string, amount double")


def count(df, rule, tables=None):
    seen = dry_run(df, rule, tables)
    return seen.element_count, seen.evaluated_count, seen.unexpected_count, seen.success


def test_nulls_are_skipped_by_value_rules(small):
    assert count(small, not_null("name")) == (5, 5, 1, False)
    assert count(small, in_set("name", ["a", "b", "c"])) == (5, 4, 0, True)
    assert count(small, between("amount", 1, 5)) == (5, 4, 2, False)  # 9.0 and NaN
    assert count(small, unique("id")) == (5, 3, 2, False)
    assert count(small, length_between("name", 2, 3)) == (5, 4, 4, False)


def test_bounds_are_inclusive_and_optional(small):
    assert count(small, between("amount", min=5))[2] == 1
    assert count(small, between("amount", max=5))[2] == 2
    with pytest.raises(RuleError):
        between("amount")


def test_mostly(small):
    assert count(small, not_null("name", mostly=0.8))[3]
    assert not count(small, not_null("name", mostly=0.81))[3]


def test_empty_table_passes_everything(spark):
    empty = spark.createDataFrame([], "id bigint, name string, amount double")
    rules = [not_null("id"), unique("id"), between("amount", 1, 2), matches("name", "x")]
    assert all(m.success and m.element_count == 0 and m.unexpected_percent == 0.0 for m in measure(empty, rules))


def test_empty_suite(small):
    assert validate(small, []).count() == 0
    assert measure(small, []) == []


def test_misfit_rules_are_refused(small):
    for rule in (between("name", 1, 2), matches("amount", "x"), not_null("nothing")):
        with pytest.raises(RuleError):
            validate(small, [rule])
    for make in (
        lambda: Rule("no_such_rule", ("id",)),
        lambda: Rule("in_set", ("id",)),
        lambda: Rule("in_set", ("id",), {"values": [1], "threshold": 2}),
        lambda: not_null("id", mostly=1.5),
    ):
        with pytest.raises(RuleError):
            make()


def test_nested_columns_take_null_rules_only(spark):
    nested = spark.createDataFrame([([1],), (None,)], "xs array<int>")
    assert count(nested, not_null("xs"))[2] == 1
    with pytest.raises(RuleError):
        validate(nested, [in_set("xs", [1])])


def test_identical_rules_count_once_and_different_ones_do_not():
    a, b = between("x", 0, 1000), between("x", 10, 500)
    assert dedupe_rules([a, b, between("x", 0, 1000)]) == [a, b]
    assert a.rule_id != b.rule_id


def test_rule_survives_its_stored_form():
    rules = [
        between("t", "2024-01-01T00:00:00", "2024-02-01T00:00:00", mostly=0.5),
        in_set("c", ["a,b", "it's"]),
        foreign_key(("a", "b"), "other", ("x", "y")),
        where("a > 1", "a"),
    ]
    for rule in rules:
        assert Rule.load(rule.kind, rule.column, rule.params_json) == rule


def test_large_value_set_goes_through_a_table(spark, small):
    many = [f"v{i}" for i in range(1500)] + ["a", "b"]
    assert count(small, in_set("name", many)) == (5, 4, 1, False)
    assert [r["name"] for r in violations(small, in_set("name", many)).collect()] == ["c"]


def test_zscore_without_spread_flags_nothing(spark):
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert count(flat, Rule("zscore_below", ("x",), {"threshold": 1}))[2] == 0


def test_foreign_key_ignores_nulls_and_needs_its_table(small, spark):
    other = spark.createDataFrame([(1,), (1,), (3,), (None,)], "key bigint")
    rule = foreign_key("id", "other", "key")
    assert count(small, rule, {"other": other}) == (5, 3, 2, False)
    with pytest.raises(RuleError):
        validate(small, [rule])


def test_injected_faults_are_counted_exactly(spark, sf_dir):
    clean = base(spark, sf_dir)
    rules = calibrate(clean, ORDERS)
    assert all(m.success for m in measure(clean, rules))
    for every in (7, 50):
        broken = clean.withColumn("payment_method", F.expr(f"if(k % {every} = 3, 'BARTER', payment_method)"))
        expected = clean.filter(f"k % {every} = 3").count()
        found = {m.rule.reason: m.unexpected_count for m in measure(broken, rules)}
        assert found.pop("in_set on 'payment_method'") == expected
        assert set(found.values()) == {0}


def test_clean_and_quarantine_are_disjoint_and_complete(spark, sf_dir):
    incoming = dirty(spark, sf_dir)
    flagged = attribute(incoming, calibrate(base(spark, sf_dir), ORDERS))
    kept, out = split(flagged)
    together = kept.unionByName(out.drop("dq_reasons"))
    assert together.exceptAll(incoming).isEmpty() and incoming.exceptAll(together).isEmpty()


def test_reasons_only_blame_the_own_predicate(small):
    # A failing range must not drag in rows that are merely null.
    flagged = attribute(small, [between("amount", 1, 5)])
    assert {(r["id"], tuple(r["dq_reasons"])) for r in flagged.filter("amount IS NULL").collect()} == {(None, ())}


def test_counts_and_reasons_agree(spark, sf_dir):
    incoming, rules = dirty(spark, sf_dir), calibrate(base(spark, sf_dir), ORDERS)
    measured = {m.rule.reason: m.unexpected_count for m in measure(incoming, rules) if not m.success}
    listed = {r["reason"]: r["row_count"] for r in reason_counts(attribute(incoming, rules)).collect()}
    assert measured == listed


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_key_flags_match_a_window_count_in_every_regime(spark, sf_dir, limit):
    """A third of the rows share one key, a sixth have none."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 6 = 1 THEN NULL ELSE l_orderkey END AS a",
        "CASE WHEN l_orderkey % 3 = 0 THEN 'hot' ELSE CAST(l_linenumber AS STRING) END AS b",
        "l_extendedprice AS price",
    )
    flagged = flag_by_keys(rows, ["a", "b"], duplicate_keys(rows, ["a", "b"]), "dup", limit)
    window = Window.partitionBy("a", "b")
    expected = rows.withColumn(
        "dup", (F.count(F.lit(1)).over(window) > 1) & F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    assert flagged.columns == expected.columns
    assert flagged.exceptAll(expected).isEmpty() and expected.exceptAll(flagged).isEmpty()
    assert flagged.filter("dup").count() > 0


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_reference_flags_with_a_hot_good_key(spark, sf_dir, limit):
    """The key that fills a third of the rows is a good one; orphans are among the others."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 3 = 0 THEN 1 WHEN l_orderkey % 6 = 1 THEN NULL ELSE l_orderkey END AS a", "l_tax"
    )
    known = spark.range(1200).withColumnRenamed("id", "ref")
    flagged = flag_by_keys(rows, ["a"], orphan_keys(rows, ["a"], known, ["ref"]), "orphan", limit)
    expected = rows.withColumn("orphan", F.expr("coalesce(a >= 1200, false)"))
    assert flagged.exceptAll(expected).isEmpty() and expected.exceptAll(flagged).isEmpty()
    assert flagged.filter("orphan").count() > 0


def test_no_bad_keys_need_no_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    flagged = flag_by_keys(orders, ["o_orderkey"], duplicate_keys(orders, ["o_orderkey"]), "dup")
    assert flagged.filter("dup").isEmpty()
    assert "Join" not in flagged._jdf.queryExecution().executedPlan().toString()


def test_calibration_rules_in_order_and_skips(spark):
    frame = spark.createDataFrame(
        [(i, f"v{i % 25}", "x" if i % 2 else None, None, None, True) for i in range(60)],
        "id bigint, many string, few string, empty string, gone double, flag boolean",
    )
    spec = TableSpec("t", ("id",), critical_columns=(), schema=frame.schema)
    rules = calibrate(frame, spec)
    # 25 values are too many, an all-null column gives no rule, booleans get none.
    assert [(r.kind, r.column) for r in rules] == [("not_null", "id"), ("unique", "id"), ("in_set", "few")]
    assert suite_from_frame(suite_frame(spark, rules)) == rules


def test_twenty_values_and_a_null_are_categorical(spark):
    frame = spark.createDataFrame([(i, f"v{i:02d}" if i < 20 else None) for i in range(40)], "id bigint, c string")
    rules = calibrate(frame, TableSpec("t", ("id",)))
    assert rules[-1].params["values"] == [f"v{i:02d}" for i in range(20)]
    more = frame.unionByName(spark.createDataFrame([(99, "v20")], frame.schema))
    assert [r.kind for r in calibrate(more, TableSpec("t", ("id",)))] == ["not_null", "unique"]


def test_schema_declaration():
    schema = schema_of([("a", "string", False), ("b", "double"), ("c", "timestamp")])
    assert [f.nullable for f in schema.fields] == [False, True, True]
    with pytest.raises(ValueError):
        schema_of([("a", "interval")])
    with pytest.raises(ValueError):
        TableSpec("t", ("missing",), schema=schema)


def test_row_check_refuses_other_levels(small):
    with pytest.raises(RuleError):
        row_check(unique("id"), small.schema)
