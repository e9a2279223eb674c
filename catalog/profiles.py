"""Profiles, calibration, masking and reports."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixture import DIRTY_SQL, ORDER_COLUMNS, ORDERS, base, dirty, query, table
from catalog.rules import FLAGGED_SQL, SUITE_SQL
from tablecare.functions.masking import mask_structural, mask_table
from tablecare.operators.calibrate import calibrate, calibrated_bounds, suite_frame
from tablecare.operators.profile import exact_medians, profile
from tablecare.operators.report import CATEGORIES, OTHER_CATEGORY, diagnose, evidence, failure_report
from tablecare.operators.sizing import scratch_path
from tablecare.operators.sketches import SketchStore
from tablecare.operators.validate import validate
from tablecare.sources.scan import scan_baseline
from tablecare.sources.sinks import append_report, read_report
from tablecare.spec import EMAIL_REGEX

# Spark type names of the SQL types in use.
TYPE_NAMES = {
    "order_id": "string",
    "customer_id": "string",
    "order_amount": "double",
    "customer_email": "string",
    "payment_method": "string",
    "country_code": "string",
    "order_timestamp": "timestamp_ntz",
    "l_orderkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_returnflag": "string",
    "l_shipdate": "timestamp_ntz",
}


def profile_sql(column: str, source: str) -> str:
    kind = TYPE_NAMES[column]
    numeric = kind in ("double", "bigint", "int")

    def when(applies: bool, text: str, sql_type: str) -> str:
        return text if applies else f"CAST(NULL AS {sql_type})"

    timed = kind == "timestamp_ntz"
    return f"""SELECT '{column}' AS "column", '{kind}' AS dtype, CAST(count(*) AS BIGINT) AS row_count,
 CAST(count(*) - count({column}) AS BIGINT) AS null_count,
 round(CAST(count(*) - count({column}) AS DOUBLE) / count(*), 4) AS null_ratio,
 CAST(count(DISTINCT {column}) AS BIGINT) AS distinct_count,
 {when(numeric, f"CAST(min({column}) AS DOUBLE)", "DOUBLE")} AS min_num,
 {when(numeric, f"CAST(max({column}) AS DOUBLE)", "DOUBLE")} AS max_num,
 {when(numeric, f"round(avg({column}), 4)", "DOUBLE")} AS mean_num,
 {when(numeric, f"CAST(quantile_disc({column}, 0.5) AS DOUBLE)", "DOUBLE")} AS median_num,
 {when(timed, f"min({column})", "TIMESTAMP")} AS min_ts,
 {when(timed, f"max({column})", "TIMESTAMP")} AS max_ts,
 {when(timed, f"quantile_disc({column}, 0.5)", "TIMESTAMP")} AS median_ts FROM {source}"""


def rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.round(c, 4) for c in ("null_ratio", "mean_num")})


@query(
    "column_profile",
    f"WITH {DIRTY_SQL}\n" + "\nUNION ALL\n".join(profile_sql(c, "dirty") for c in ORDER_COLUMNS),
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile(dirty(spark, sf), ORDER_COLUMNS))


LINEITEM_COLUMNS = [c for c in TYPE_NAMES if c.startswith("l_")]


@query(
    "column_profile_lineitem",
    "\nUNION ALL\n".join(profile_sql(c, "lineitem") for c in LINEITEM_COLUMNS),
)
def column_profile_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile(table(spark, sf, "lineitem"), LINEITEM_COLUMNS))


@query(
    "column_profile_null_counts",
    f"WITH {DIRTY_SQL}\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS row_count,
 CAST(count(*) - count({c}) AS BIGINT) AS null_count,
 round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 4) AS null_ratio FROM dirty"""
        for c in [*ORDER_COLUMNS, "k"]
    ),
)
def column_profile_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The cheap profile: one aggregate, no distinct counts and no medians. Column list from the data."""
    cheap = profile(dirty(spark, sf), distinct="none", median="none")
    return cheap.select("column", "row_count", "null_count", F.round("null_ratio", 4).alias("null_ratio"))


MEDIANS = {"lineitem": ["l_quantity", "l_extendedprice", "l_orderkey", "l_discount"], "events": ["value"]}


@query(
    "median_numeric",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS median FROM {name}"""
        for name, columns in MEDIANS.items()
        for c in columns
    ),
)
def median_numeric(spark: SparkSession, sf: str) -> DataFrame:
    found: dict[str, float] = {}
    for name, columns in MEDIANS.items():
        found |= exact_medians(table(spark, sf, name), columns)
    return spark.createDataFrame([(c, float(v)) for c, v in found.items()], "column string, median double")


@query(
    "median_timestamp",
    """SELECT 'events.ts' AS "column", quantile_disc(ts, 0.5) AS median FROM events
UNION ALL SELECT 'lineitem.l_shipdate', quantile_disc(l_shipdate, 0.5) FROM lineitem""",
)
def median_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    rows = [
        (f"{name}.{c}", exact_medians(table(spark, sf, name), [c])[c])
        for name, c in (("events", "ts"), ("lineitem", "l_shipdate"))
    ]
    frame = spark.createDataFrame(rows, "column string, median string")
    return frame.select("column", F.col("median").cast("timestamp_ntz").alias("median"))


# -- calibration ---------------------------------------------------------------------------

NO_NUM = "CAST(NULL AS DOUBLE) AS min_num, CAST(NULL AS DOUBLE) AS max_num"
NO_TS = "CAST(NULL AS TIMESTAMP) AS min_ts, CAST(NULL AS TIMESTAMP) AS max_ts"
NO_TEXT = "CAST(NULL AS VARCHAR)"


def calibrated_sql(kind: str, column: str, order: int) -> str:
    num, ts, values, regex = NO_NUM, NO_TS, NO_TEXT, NO_TEXT
    if kind == "between" and column == "order_timestamp":
        ts = "t_lo AS min_ts, t_hi AS max_ts"
    elif kind == "between":
        num = "lo AS min_num, hi AS max_num"
    elif kind == "in_set":
        values = f"(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM base))"
    elif kind == "matches":
        regex = f"'{EMAIL_REGEX}'"
    return (
        f"SELECT CAST({order} AS INTEGER) AS ord, '{kind}' AS rule, '{column}' AS \"column\", {num}, {ts},"
        f' {values} AS "values", {regex} AS regex FROM bounds'
    )


SUITE_ROWS = [calibrated_sql(kind, column, i) for i, (kind, column, _, _) in enumerate(SUITE_SQL)]


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated_bounds(suite_frame(spark, calibrate(base(spark, sf), ORDERS)))


@query("calibrate_suite", f"WITH {DIRTY_SQL}\n" + "\nUNION ALL\n".join(SUITE_ROWS))
def calibrate_suite(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf)


@query(
    "calibrate_numeric",
    f"WITH {DIRTY_SQL}\nSELECT \"column\", min_num, max_num FROM ({SUITE_ROWS[4]})",
)
def calibrate_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf).filter("rule = 'between' AND min_num IS NOT NULL").select(
        "column", "min_num", "max_num"
    )


@query(
    "calibrate_timestamp",
    f"WITH {DIRTY_SQL}\nSELECT \"column\", min_ts, max_ts FROM ({SUITE_ROWS[11]})",
)
def calibrate_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf).filter("min_ts IS NOT NULL").select("column", "min_ts", "max_ts")


@query(
    "calibrate_categorical",
    f"WITH {DIRTY_SQL}\nSELECT \"column\", \"values\" FROM ({SUITE_ROWS[8]} UNION ALL {SUITE_ROWS[9]})",
)
def calibrate_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return calibrated(spark, sf).filter("rule = 'in_set'").select("column", "values")


# -- masking -------------------------------------------------------------------------------


@query(
    "mask_structural",
    r"SELECT doc_id, regexp_replace(text, '[A-Za-z\p{Nd}]', 'x', 'g') AS masked FROM documents",
)
def masked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", mask_structural(F.col("text")).alias("masked"))


@query(
    "mask_table",
    f"""WITH {DIRTY_SQL} SELECT order_id, customer_id, order_amount,
 regexp_replace(customer_email, '[A-Za-z0-9]', 'x', 'g') AS customer_email, payment_method, country_code,
 order_timestamp, k FROM dirty""",
)
def masked_table(spark: SparkSession, sf: str) -> DataFrame:
    return mask_table(dirty(spark, sf))


# -- reports -------------------------------------------------------------------------------


def category_sql(kind: str, column: str) -> str:
    return CATEGORIES["between_time"] if column == "order_timestamp" and kind == "between" else CATEGORIES.get(
        kind, OTHER_CATEGORY
    )


@query(
    "diagnose",
    f"WITH {FLAGGED_SQL}\nSELECT * FROM ("
    + "\nUNION ALL\n".join(
        f"""SELECT '{kind}' AS rule, '{column}' AS "column", '{category_sql(kind, column)}' AS failure_category,
 count(*) FILTER (WHERE v{i}) || ' of ' || count(*) FILTER (WHERE e{i}) || ' rows break {kind} on column {column}.'
 AS explanation FROM flagged HAVING count(*) FILTER (WHERE v{i}) > 0"""
        for i, (kind, column, _, _) in enumerate(SUITE_SQL)
    )
    + ")",
)
def diagnosed(spark: SparkSession, sf: str) -> DataFrame:
    incoming = dirty(spark, sf)
    result = validate(incoming, calibrate(base(spark, sf), ORDERS))
    types = profile(incoming, ORDER_COLUMNS, distinct="none", median="none")
    return diagnose(result, types).select("rule", "column", "failure_category", "explanation")


REPORT_SQL = f"WITH {FLAGGED_SQL}\n" + "\nUNION ALL\n".join(
    f"""SELECT '{kind}' AS rule, '{column}' AS "column", CAST(count(*) AS BIGINT) AS element_count,
 CAST(count(*) FILTER (WHERE v{i}) AS BIGINT) AS unexpected_count,
 round(100.0 * count(*) FILTER (WHERE v{i}) / count(*) FILTER (WHERE e{i}), 4) AS unexpected_percent,
 '{category_sql(kind, column)}' AS failure_category,
 CAST(count(*) - count({column}) AS BIGINT) AS null_count,
 CAST(count(DISTINCT {column}) AS BIGINT) AS distinct_count,
 CAST(least(8, count(*) FILTER (WHERE v{i})) AS BIGINT) AS sample_count,
 (SELECT string_agg(coalesce(order_id, ''), ',' ORDER BY order_id NULLS FIRST) FROM (SELECT order_id FROM flagged
  WHERE v{i} ORDER BY order_id NULLS FIRST LIMIT 8)) AS sample_keys
 FROM flagged HAVING count(*) FILTER (WHERE v{i}) > 0"""
    for i, (kind, column, _, _) in enumerate(SUITE_SQL)
)


def order_report(spark: SparkSession, sf: str) -> DataFrame:
    return failure_report(dirty(spark, sf), calibrate(base(spark, sf), ORDERS), ORDERS)


@query("failure_report", REPORT_SQL)
def report(spark: SparkSession, sf: str) -> DataFrame:
    return order_report(spark, sf).select(
        "rule",
        "column",
        "element_count",
        "unexpected_count",
        F.round("unexpected_percent", 4).alias("unexpected_percent"),
        "failure_category",
        F.col("profile.null_count").alias("null_count"),
        F.col("profile.distinct_count").alias("distinct_count"),
        F.size("samples").cast("bigint").alias("sample_count"),
        F.concat_ws(",", F.transform("samples", lambda s: F.coalesce(s["order_id"], F.lit("")))).alias("sample_keys"),
    )


@query(
    "evidence",
    f"WITH {FLAGGED_SQL}\n"
    + "\nUNION ALL\n".join(
        f"""SELECT 'orders' AS "table", '{kind}' AS rule, '{column}' AS "column",
 CAST(count(*) FILTER (WHERE v{i}) AS BIGINT) AS unexpected_count,
 round(100.0 * count(*) FILTER (WHERE v{i}) / count(*) FILTER (WHERE e{i}), 4) AS unexpected_percent,
 CAST(count(DISTINCT {column}) AS BIGINT) AS distinct_count FROM flagged
 HAVING count(*) FILTER (WHERE v{i}) > 0"""
        for i, (kind, column, _, _) in enumerate(SUITE_SQL)
    ),
)
def evidence_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON evidence, read back with JSON paths."""
    documents = evidence(order_report(spark, sf), ORDERS)

    def at(path: str, kind: str = "string"):
        return F.get_json_object("evidence", path).cast(kind)

    return documents.select(
        at("$.table").alias("table"),
        at("$.failed_rule.rule").alias("rule"),
        at("$.failed_rule.column").alias("column"),
        at("$.unexpected_count", "bigint").alias("unexpected_count"),
        at("$.unexpected_percent", "double").alias("unexpected_percent"),
        at("$.column_profile.distinct_count", "bigint").alias("distinct_count"),
    )




# -- kept sketches, written baseline, written reports --------------------------------------

SKETCHED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


@query(
    "profile_sketches",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count,
 {f"CAST(min({c}) AS DOUBLE)" if c in ("l_orderkey", "l_quantity", "l_extendedprice") else "CAST(NULL AS DOUBLE)"} AS min_num,
 {f"CAST(max({c}) AS DOUBLE)" if c in ("l_orderkey", "l_quantity", "l_extendedprice") else "CAST(NULL AS DOUBLE)"} AS max_num,
 TRUE AS distinct_near, TRUE AS median_near FROM lineitem"""
        for c in SKETCHED
    ),
)
def profile_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches leave sketches; merged, their counts are exact and the rest is within its bounds."""
    lines = table(spark, sf, "lineitem").select(*SKETCHED)
    store = SketchStore(spark, scratch_path(spark, "sketches"), "lineitem")
    for batch in range(3):
        store.add(lines.filter(F.col("l_orderkey") % 3 == batch), f"batch-{batch}")
    store.add(lines.filter(F.col("l_orderkey") % 3 == 2), "batch-2")  # again: replaces itself
    rows = []
    for p in store.profiles():
        exact = lines.agg(F.count_distinct(p.column).alias("d")).first()["d"]
        near = True
        if p.median is not None:
            middle = F.lit(p.median).cast(lines.schema[p.column].dataType)
            ranks = lines.agg(F.avg((F.col(p.column) < middle).cast("int")).alias("a"), F.avg((F.col(p.column) <= middle).cast("int")).alias("b")).first()
            near = ranks["a"] <= 0.54 and ranks["b"] >= 0.46
        rows.append((p.column, p.row_count, p.null_count, p.min_num, p.max_num, abs(p.distinct_count - exact) <= 0.08 * exact + 1, near))
    return spark.createDataFrame(
        rows, "column string, row_count bigint, null_count bigint, min_num double, max_num double, distinct_near boolean, median_near boolean"
    )


@query("calibrate_baseline_path", f"WITH {DIRTY_SQL}\n" + "\nUNION ALL\n".join(SUITE_ROWS))
def calibrate_baseline_path(spark: SparkSession, sf: str) -> DataFrame:
    """The suite from a baseline that lies under the spec's path."""
    path = scratch_path(spark, "baseline")
    base(spark, sf).select(*ORDER_COLUMNS).write.parquet(path)
    spec = dataclasses.replace(ORDERS, fmt="parquet", options={}, baseline_path=path)
    return calibrated_bounds(suite_frame(spark, calibrate(scan_baseline(spark, spec), spec)))


@query(
    "report_read_back",
    f"""WITH {DIRTY_SQL} SELECT 'run-' || CAST(k % 3 AS VARCHAR) AS run_id, payment_method, CAST(count(*) AS BIGINT) AS rows,
 min(order_amount) AS low FROM dirty GROUP BY ALL""",
)
def report_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of three runs, appended one after the other and read back, one of them by its run."""
    root = scratch_path(spark, "reports")
    for run_id in range(3):
        rows = dirty(spark, sf).filter(F.col("k") % 3 == run_id).groupBy("payment_method")
        append_report(rows.agg(F.count(F.lit(1)).alias("rows"), F.min("order_amount").alias("low")), root, "methods", f"run-{run_id}")
    one, all_runs = read_report(spark, root, "methods", "run-1"), read_report(spark, root, "methods")
    return one.unionByName(all_runs.filter("run_id <> 'run-1'")).select("run_id", "payment_method", "rows", "low")
