"""Profiles and exact quantiles against sorting in plain Python."""

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalog.fixture import dirty
from tablecare.functions.masking import mask_structural, mask_table, pii_columns
from tablecare.operators.profile import distinct_counts, exact_medians, profile_columns
from tablecare.operators.quantiles import exact_quantiles
from tablecare.operators.sketches import SketchStore, column_sketches
from tablecare.spec import RuleError


def lower_quantile(values, q):
    kept = sorted(v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v)))
    return kept[max(1, math.ceil(q * len(kept) - 1e-9)) - 1] if kept else None


number = st.one_of(
    st.none(),
    st.floats(allow_nan=True, allow_infinity=True),
    st.integers(-5, 5).map(float),
)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(number, min_size=1, max_size=60), q=st.sampled_from([0.01, 0.25, 0.5, 0.9, 1.0]))
def test_quantile_of_any_doubles(spark, values, q):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert exact_quantiles(df, ["x"], q)["x"] == lower_quantile(values, q)


def test_quantiles_of_all_types_together(spark):
    start = datetime(2024, 1, 1)
    rows = [(i * i - 500, 2**62 + i, float(i % 7), i / 3, start + timedelta(microseconds=i), None) for i in range(101)]
    df = spark.createDataFrame(rows, "a int, b bigint, c float, d double, t timestamp_ntz, e double")
    found = exact_quantiles(df, ["a", "b", "c", "d", "e"], 0.3)
    for i, name in enumerate(["a", "b", "c", "d"]):
        assert found[name] == pytest.approx(lower_quantile([r[i] for r in rows], 0.3))
    # Longs beyond the precision of a double stay exact.
    assert found["b"] == 2**62 + 30
    assert found["e"] is None
    assert exact_medians(df, ["t"])["t"] == "2024-01-01T00:00:00.00005"
    with pytest.raises(RuleError):
        exact_quantiles(spark.createDataFrame([("x",)], "s string"), ["s"])


def test_a_value_that_fills_half_the_table(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, 1e300).otherwise(F.col("id") / 7).alias("x"))
    assert exact_quantiles(df, ["x"], 0.75)["x"] == 1e300
    assert exact_quantiles(df, ["x"], 0.25)["x"] == lower_quantile([i / 7 for i in range(1, 10_000, 2)], 0.5)


def test_profile_of_an_empty_table(spark):
    seen = profile_columns(spark.createDataFrame([], "id bigint, s string, t timestamp_ntz"))
    assert [(p.row_count, p.null_count, p.null_ratio, p.distinct_count, p.median) for p in seen] == [(0, 0, 0.0, 0, None)] * 3


def test_approximate_modes_come_close(spark, sf_dir):
    df = dirty(spark, sf_dir)
    exact = {p.column: p for p in profile_columns(df)}
    near = {p.column: p for p in profile_columns(df, distinct="approx", median="approx")}
    for name, p in exact.items():
        assert near[name].distinct_count == pytest.approx(p.distinct_count, rel=0.2)
        assert (near[name].median is None) == (p.median is None)
    with pytest.raises(ValueError):
        profile_columns(df, median="guess")


def test_distinct_counts_skip_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (None, "b")], "a int, b string")
    assert distinct_counts(df, ["a", "b"]) == {"a": 1, "b": 2}


def test_nan_is_no_number(spark):
    p = profile_columns(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double"))[0]
    assert (p.min_num, p.max_num, p.mean_num, p.median_num, p.null_count) == (1.0, 3.0, 2.0, 1.0, 0)


def mask(spark, text):
    return spark.createDataFrame([(text,)], "s string").select(mask_structural(F.col("s"))).first()[0]


def test_masking_keeps_the_shape(spark):
    assert mask(spark, "jane.doe@example.com") == "xxxx.xxx@xxxxxxx.xxx"
    assert "@" not in mask(spark, "invalid_email_at_google.com")
    assert mask(spark, None) is None
    assert mask(spark, "+49 30-1234 Äb") == "+xx xx-xxxx Äx"


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(text=st.text(alphabet=st.characters(codec="ascii", exclude_characters="\x00"), max_size=40))
def test_masking_keeps_the_length(spark, text):
    masked = mask(spark, text)
    assert len(masked) == len(text)
    assert not any(c.isdigit() or (c.isalpha() and c != "x") for c in masked)


def test_only_hinted_text_is_masked(spark):
    df = spark.createDataFrame([("ORD-000010", "jane@example.com", 42.5, 7)], "order_id string, customer_email string, amount double, phone int")
    assert pii_columns(df.schema) == ["customer_email", "phone"]
    assert tuple(mask_table(df).first()) == ("ORD-000010", "xxxx@xxxxxxx.xxx", 42.5, 7)


# -- sketches ------------------------------------------------------------------------------


def test_sketches_merge_to_the_profile_of_all_rows(spark, tmp_path):
    df = spark.range(0, 40_000).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 1000 AS DOUBLE) END AS x", "concat('v', id % 7) AS s",
        "timestamp_micros(id * 1000000) AS t", "CASE WHEN id % 4 = 0 THEN DOUBLE('NaN') ELSE 1D END AS nan", "CAST(NULL AS INT) AS nothing",
    )
    store = SketchStore(spark, str(tmp_path), "t")
    assert store.profiles() == []
    for i in range(5):
        store.add(df.filter(f"id % 5 = {i}"), f"b{i}")
    store.add(df.filter("id < 0"), "empty")
    got = {p.column: p for p in store.profiles()}
    want = {p.column: p for p in profile_columns(df)}
    assert set(got) == set(want)
    for name, p in got.items():
        w = want[name]
        same = ("dtype", "row_count", "null_count", "null_ratio", "min_num", "max_num", "min_ts", "max_ts")
        assert [getattr(p, f) for f in same] == [getattr(w, f) for f in same], name
        assert p.mean_num == pytest.approx(w.mean_num) and abs(p.distinct_count - w.distinct_count) <= 0.06 * w.distinct_count
    assert abs(got["x"].median_num - want["x"].median_num) <= 40 and got["nothing"].median is None
    seconds = lambda text: spark.sql(f"SELECT unix_seconds(TIMESTAMP '{text}')").first()[0]
    assert abs(seconds(got["t"].median_ts) - 20_000) <= 0.04 * 40_000
    store.add(df.filter("id % 5 = 0"), "b0")
    assert {p.column: p.row_count for p in store.profiles()}["id"] == 40_000
    assert {p.column: p.row_count for p in store.profiles(["b0"])}["id"] == 8_000


def test_sketches_take_one_scan_and_no_key_shuffle(spark, sf_dir):
    plan = column_sketches(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_returnflag"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "hashpartitioning" not in text and "l_shipdate" not in text
