"""Numbers that a double cannot hold, keys of any length, lists of any length, results that are always written."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalog.fixture import base
from tablecare import Fix, RunOptions, TableSpec
from tablecare.operators.fixes import apply_fix
from tablecare.operators.validate import validate
from tablecare.plans.registry import Registry
from tablecare.plans.run import run
from tablecare.spec import Rule, between, in_set, schema_of

BIG = 2**60


def after(spark, rows, schema, fix):
    return [r[0] for r in apply_fix(spark.createDataFrame([(r,) for r in rows], schema), fix).collect()]


@pytest.mark.parametrize(
    ("fix", "want"),
    [
        (Fix("fill_null", "x", {"value": 1.5}), [BIG + 1, BIG + 3, 1]),
        (Fix("impute_median", "x", {"min": 0, "max": BIG + 2, "median": 7.0}), [BIG + 1, 7, None]),
        (Fix("replace_where", "x", {"predicate": f"x > {BIG + 2}", "value": 2.0}), [BIG + 1, 2, None]),
        (Fix("clamp", "x", {"min": 0.5, "max": 9e18}), [BIG + 1, BIG + 3, None]),
    ],
)
def test_repairs_leave_other_whole_numbers_alone(spark, fix, want):
    assert after(spark, [BIG + 1, BIG + 3, None], "x bigint", fix) == want


def test_repairs_leave_other_decimals_alone(spark):
    kept = Decimal("12345678901234567.89")
    got = after(spark, [kept, None], "x decimal(20,2)", Fix("fill_null", "x", {"value": 1.5}))
    assert got == [kept, Decimal("1.50")]
    got = after(spark, [kept, Decimal("-1.00")], "x decimal(20,2)", Fix("clamp", "x", {"min": 0.25, "max": None}))
    assert got == [kept, Decimal("0.25")]


def test_bounds_of_whole_numbers_round_inwards(spark):
    assert after(spark, [0, 5, 10], "x int", Fix("clamp", "x", {"min": 1.5, "max": 7.5})) == [2, 5, 7]


def failures(df, rule):
    return [(r["unexpected_count"], r["success"]) for r in validate(df, [rule]).collect()]


def test_long_lists_compare_like_short_ones(spark, monkeypatch):
    for schema, values in (("x int", [1.0, 2.5, 3, None]), ("x bigint", [BIG + 1, 1, 3]), ("x double", [1, 2.5]), ("x string", ["1", "3"])):
        df = spark.createDataFrame([(str(i),) for i in [1, 2, 3, BIG % 7]], "x string").select(F.col("x").cast(schema[2:]))
        rule = in_set("x", values)
        inline = failures(df, rule)
        with monkeypatch.context() as patch:
            patch.setattr("tablecare.operators.validate.MAX_INLINE_VALUES", 0)
            assert failures(df, rule) == inline


def test_sums_of_whole_numbers_do_not_overflow(spark):
    df = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "x bigint")
    assert failures(df, Rule("sum_between", ("x",), {"min": 0, "max": 1.5e19}))[0][1]


def test_keys_of_seven_digits_stay_apart(spark, tmp_path):
    orders = spark.range(999_990, 1_000_990).selectExpr(
        "id AS o_orderkey", "id + 1000000 AS o_custkey", "1.0D AS o_totalprice", "timestamp_ntz'2024-01-01' AS o_orderdate"
    )
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    row = base(spark, str(tmp_path)).agg(F.countDistinct("order_id"), F.countDistinct("customer_id")).first()
    assert tuple(row) == (1000, 1000)


def test_a_clean_batch_is_written_after_replay(spark, tmp_path):
    spec = TableSpec("t", ("id",), schema_of([("id", "long"), ("x", "double")]))
    registry, out = Registry(spark, str(tmp_path / "registry")), str(tmp_path / "out")
    registry.seed([between("x", 0, 10)])
    dirty = spark.createDataFrame([(1, 5.0), (2, 50.0), (3, 6.0)], "id long, x double")
    proposed = {between("x", 0, 10).rule_id: [Fix("clamp", "x", {"min": 0, "max": 10})]}
    options = RunOptions(repair_not_drop=True)
    first = run(spark, spec, registry, out, df=dirty, baseline=dirty, options=options, proposed_fixes=proposed)
    second = run(spark, spec, registry, out, df=dirty, baseline=dirty, options=options)
    assert second.metadata["phase_reached"] == "clean" and second.metadata["fixes_replayed"] == 1
    clean = [sorted(map(tuple, spark.read.parquet(f"{out}/clean/run_id={r.run_id}").collect())) for r in (first, second)]
    assert clean[0] == clean[1] == [(1, 5.0), (2, 10.0), (3, 6.0)]
