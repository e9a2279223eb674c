"""Repairs, their plan and replay, and the gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixture import DIRTY_SQL, ORDER_COLUMNS, ORDERS, base, dirty, query, table
from catalog.rules import AMOUNT_HIGH, AMOUNT_LOW, FLAGGED_SQL, METHODS, METHODS_SQL, ROW_SQL, SUITE_SQL
from tablecare.operators.calibrate import calibrate, related_rules
from tablecare.operators.fixes import FIX_ID, apply_fix, apply_fixes, plan_fixes, quarantine_where, template_fix
from tablecare.operators.gates import GateResult, check_fixes, check_rules, import_rules, snapshot
from tablecare.operators.profile import profile_columns
from tablecare.operators.validate import measure
from tablecare.spec import Fix, Rule, between, in_set, not_null, rule_param, unique, where


def replaced_sql(source: str = "dirty", condition: str = "TRUE", **new: str) -> str:
    """SQL of the order table with some columns restated."""
    columns = ", ".join(f"{new[c]} AS {c}" if c in new else c for c in [*ORDER_COLUMNS, "k"])
    return f"WITH {DIRTY_SQL} SELECT {columns} FROM {source} WHERE {condition}"


# -- one repair each -----------------------------------------------------------------------


@query(
    "fix_impute_median",
    replaced_sql(
        "dirty, bounds, (SELECT quantile_disc(order_amount, 0.5) AS m, quantile_disc(order_timestamp, 0.5) AS mt"
        " FROM dirty)",
        order_amount="CASE WHEN order_amount < lo OR order_amount > hi THEN m ELSE order_amount END",
        order_timestamp="CASE WHEN order_timestamp < t_lo OR order_timestamp > t_hi THEN mt ELSE order_timestamp END",
    ),
)
def fix_impute_median(spark: SparkSession, sf: str) -> DataFrame:
    incoming = dirty(spark, sf)
    profiles = {p.column: p for p in profile_columns(incoming, ["order_amount", "order_timestamp"], distinct="none")}
    fixes = [template_fix(r, profiles.get(r.column)) for r in calibrate(base(spark, sf), ORDERS)]
    return apply_fixes(incoming, [f for f in fixes if f is not None]).df


@query("fix_fill_null", replaced_sql(customer_id="coalesce(customer_id, 'UNKNOWN')", order_amount="coalesce(order_amount, 0)"))
def fix_fill_null(spark: SparkSession, sf: str) -> DataFrame:
    fixes = [
        Fix("fill_null", "customer_id", {"value": "UNKNOWN"}),
        Fix("fill_null", "order_amount", {"value": 0}),
    ]
    return apply_fixes(dirty(spark, sf), fixes).df


WIDE_KEY = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 1152921504606846976 + o_orderkey END"
WIDE_AMOUNT = """CASE WHEN o_orderkey % 7 = 0 THEN NULL
 ELSE CAST(CAST('12345678901234567.89' AS DECIMAL(20,2)) + CAST(o_orderkey AS DECIMAL(15,0)) AS DECIMAL(20,2)) END"""


@query(
    "fix_wide_numbers",
    f"""SELECT k, CAST(CASE WHEN wide_key IS NULL THEN 7 WHEN wide_key % 10 = 3 THEN 8 ELSE wide_key END AS VARCHAR) AS wide_key,
 CAST(coalesce(greatest(wide_amount, CAST('12345678901234600.25' AS DECIMAL(20,2))), CAST('1.50' AS DECIMAL(20,2))) AS VARCHAR)
 AS wide_amount
FROM (SELECT o_orderkey AS k, {WIDE_KEY} AS wide_key,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST('1.50' AS DECIMAL(20,2)) ELSE {WIDE_AMOUNT} END AS wide_amount FROM orders)""",
)
def fix_wide_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers beyond the precision of a double; constants of other types must not touch them."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS k", f"{WIDE_KEY} AS wide_key", f"{WIDE_AMOUNT} AS wide_amount")
    fixes = [
        Fix("replace_where", "wide_key", {"predicate": "wide_key % 10 = 3", "value": 8.0}),
        Fix("fill_null", "wide_key", {"value": 7.5}),
        Fix("fill_null", "wide_amount", {"value": 1.5}),
        Fix("clamp", "wide_amount", {"min": "12345678901234600.25"}),
    ]
    fixed = apply_fixes(rows, fixes).df
    return fixed.selectExpr("k", "CAST(wide_key AS STRING) AS wide_key", "CAST(wide_amount AS STRING) AS wide_amount")


@query(
    "fix_replace_where",
    replaced_sql(
        payment_method=f"CASE WHEN payment_method NOT IN {METHODS_SQL} THEN 'CARD' ELSE payment_method END",
        order_amount="CASE WHEN order_amount < 0 THEN 0 ELSE order_amount END",
    ),
)
def fix_replace_where(spark: SparkSession, sf: str) -> DataFrame:
    fixes = [
        Fix("replace_where", "payment_method", {"rule": rule_param(in_set("payment_method", METHODS)), "value": "CARD"}),
        Fix("replace_where", "order_amount", {"predicate": "order_amount < 0", "value": 0}),
    ]
    return apply_fixes(dirty(spark, sf), fixes).df


@query("fix_drop_where", replaced_sql(condition="customer_id IS NOT NULL AND NOT coalesce(order_amount < 0, FALSE)"))
def fix_drop_where(spark: SparkSession, sf: str) -> DataFrame:
    fixes = [
        Fix("drop_where", None, {"rule": rule_param(not_null("customer_id"))}),
        Fix("drop_where", None, {"predicate": "order_amount < 0"}),
    ]
    return apply_fixes(dirty(spark, sf), fixes).df


@query(
    "fix_quarantine",
    f"WITH {DIRTY_SQL} SELECT {ROW_SQL}, coalesce(order_amount < {AMOUNT_LOW} OR order_amount > {AMOUNT_HIGH},"
    " FALSE) AS routed_out FROM dirty",
)
def fix_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    kept, out = quarantine_where(dirty(spark, sf), f"order_amount < {AMOUNT_LOW} OR order_amount > {AMOUNT_HIGH}")
    return kept.withColumn("routed_out", F.lit(False)).unionByName(out.withColumn("routed_out", F.lit(True)))


@query("fix_regex_replace", replaced_sql(customer_email="regexp_replace(customer_email, '_at_', '@', 'g')"))
def fix_regex_replace(spark: SparkSession, sf: str) -> DataFrame:
    return apply_fix(
        dirty(spark, sf), Fix("regex_replace", "customer_email", {"pattern": "_at_", "replacement": "@"})
    )


@query(
    "fix_text_normalize",
    "SELECT doc_id, trim('  ' || lang || ' ') AS lang, upper(source) AS source, lower(text) AS text FROM"
    " (SELECT doc_id, lang, source, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM documents)",
)
def fix_text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    padded = table(spark, sf, "documents").selectExpr(
        "doc_id", "concat('  ', lang, ' ') AS lang", "source", "regexp_replace(text, '[^ -~]', '?') AS text"
    )
    return apply_fixes(padded, [Fix("trim", "lang"), Fix("upper", "source"), Fix("lower", "text")]).df


@query(
    "fix_keep_first",
    """SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS rows_kept, min(l_extendedprice) AS price
 FROM lineitem GROUP BY ALL HAVING rows_kept > 0""".replace("CAST(count(*) AS BIGINT)", "CAST(1 AS BIGINT)"),
)
def fix_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    """One row per key; with the price leading the order, it carries the smallest price of its key."""
    kept = apply_fix(
        table(spark, sf, "lineitem"),
        Fix("keep_first", None, {"key": ["l_orderkey", "l_linenumber"], "order": ["l_extendedprice"]}),
    )
    return kept.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.min("l_extendedprice").alias("price")
    )


@query(
    "fix_keep_first_null_keys",
    f"""WITH {DIRTY_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY customer_id NULLS LAST,
 order_amount NULLS LAST, customer_email, payment_method, order_timestamp) AS rn FROM dirty)
 SELECT {ROW_SQL} FROM ranked WHERE rn = 1 OR order_id IS NULL""",
)
def fix_keep_first_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a key are all kept."""
    order = ["customer_id", "order_amount", "customer_email", "payment_method", "order_timestamp"]
    return apply_fix(dirty(spark, sf), Fix("keep_first", None, {"key": ["order_id"], "order": order}))


@query(
    "fix_clamp",
    replaced_sql(
        order_amount=f"CASE WHEN order_amount < {AMOUNT_LOW} THEN {AMOUNT_LOW} WHEN order_amount > {AMOUNT_HIGH}"
        f" THEN {AMOUNT_HIGH} ELSE order_amount END"
    ),
)
def fix_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return apply_fix(dirty(spark, sf), Fix("clamp", "order_amount", {"min": AMOUNT_LOW, "max": AMOUNT_HIGH}))


@query(
    "fix_null_out",
    replaced_sql(customer_email="CASE WHEN contains(customer_email, '_at_') THEN NULL ELSE customer_email END"),
)
def fix_null_out(spark: SparkSession, sf: str) -> DataFrame:
    return apply_fix(dirty(spark, sf), Fix("null_out", "customer_email", {"predicate": "customer_email LIKE '%\\_at\\_%'"}))


@query(
    "fix_map_values",
    replaced_sql(
        payment_method="CASE payment_method WHEN 'CRYPTO' THEN 'OTHER' WHEN 'CARD' THEN 'CREDIT_CARD'"
        " ELSE payment_method END"
    ),
)
def fix_map_values(spark: SparkSession, sf: str) -> DataFrame:
    mapping = {"CRYPTO": "OTHER", "CARD": "CREDIT_CARD"}
    return apply_fix(dirty(spark, sf), Fix("map_values", "payment_method", {"mapping": mapping}))


def _flag_large(df: DataFrame) -> DataFrame:
    return df.withColumn("order_amount", F.round("order_amount", 0)).withColumn(
        "is_large", F.coalesce(F.col("order_amount") > 400000, F.lit(False))
    )


@query(
    "fix_custom",
    f"""WITH {DIRTY_SQL} SELECT order_id, customer_id, round(order_amount, 0) AS order_amount, customer_email,
 payment_method, country_code, order_timestamp, k, coalesce(round(order_amount, 0) > 400000, FALSE) AS is_large
 FROM dirty""",
)
def fix_custom(spark: SparkSession, sf: str) -> DataFrame:
    return apply_fix(dirty(spark, sf), Fix("custom", None, {"name": "flag_large"}), {"flag_large": _flag_large})


# Actions the plan names per failed calibrated rule, when rows may not be dropped.
PLANNED = {
    ("not_null", "order_amount"): "fill_null",
    ("between", "order_amount"): "impute_median",
    ("between", "order_timestamp"): "impute_median",
}


@query(
    "fix_plan",
    f"WITH {FLAGGED_SQL}\nSELECT * FROM ("
    + "\nUNION ALL\n".join(
        f"""SELECT '{kind}' AS rule, '{column}' AS "column", '{PLANNED.get((kind, column), "")}' AS actions
 FROM flagged HAVING count(*) FILTER (WHERE v{i}) > 0"""
        for i, (kind, column, _, _) in enumerate(SUITE_SQL)
    )
    + ")",
)
def fix_plan(spark: SparkSession, sf: str) -> DataFrame:
    incoming = dirty(spark, sf)
    failures = [m for m in measure(incoming, calibrate(base(spark, sf), ORDERS)) if not m.success]
    profiles = profile_columns(incoming, ORDER_COLUMNS, distinct="none")
    plan = plan_fixes(failures, profiles, incoming.schema, repair_not_drop=True)
    rows = [(m.rule.kind, m.rule.column, ",".join(f.action for f in plan[m.rule.rule_id])) for m in failures]
    return spark.createDataFrame(rows, "rule string, column string, actions string")


@query(
    "fix_replay",
    replaced_sql(
        customer_id="coalesce(customer_id, 'UNKNOWN')",
        customer_email="regexp_replace(customer_email, '_at_', '@', 'g')",
        payment_method="CASE payment_method WHEN 'CRYPTO' THEN 'CARD' ELSE payment_method END",
    ),
)
def fix_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted repairs in order; one that no longer fits the table is skipped."""
    fixes = [
        Fix("fill_null", "customer_id", {"value": "UNKNOWN"}),
        Fix("fill_null", "column_of_last_year", {"value": 0}),
        Fix("regex_replace", "customer_email", {"pattern": "_at_", "replacement": "@"}),
        Fix("map_values", "payment_method", {"mapping": {"CRYPTO": "CARD"}}),
    ]
    replay = apply_fixes(dirty(spark, sf), fixes)
    if len(replay.applied) != 3 or len(replay.skipped) != 1:
        raise AssertionError("exactly the repair of the missing column is skipped")
    return replay.df


# -- gates ---------------------------------------------------------------------------------

GATE_COLUMNS = "fix_id string, before_count bigint, after_count bigint, rows_before bigint, rows_after bigint, passed boolean"


def gate_frame(spark: SparkSession, results: list[GateResult]) -> DataFrame:
    rows = [(g.fix.fix_id, g.before_count, g.after_count, g.rows_before, g.rows_after, g.passed) for g in results]
    return spark.createDataFrame(rows, GATE_COLUMNS)


def gate_sql(fix: Fix, before: str, after: str, passed: str, rows_after: str = "(SELECT count(*) FROM dirty)") -> str:
    return f"""SELECT '{fix.fix_id}' AS fix_id, CAST({before} AS BIGINT) AS before_count,
 CAST({after} AS BIGINT) AS after_count, CAST((SELECT count(*) FROM dirty) AS BIGINT) AS rows_before,
 CAST({rows_after} AS BIGINT) AS rows_after, {passed} AS passed"""


def try_each(spark: SparkSession, sf: str, rules: list[Rule], pairs, repair_not_drop: bool, protect: bool = True):
    """Every repair on the same incoming table, one at a time."""
    incoming = dirty(spark, sf)
    before = snapshot(incoming, rules)
    results = []
    for fix, rule in pairs:
        results += check_fixes(incoming, before, rules, [(fix, rule)], repair_not_drop, protect=protect)[2]
    return gate_frame(spark, results)


NO_CUSTOMER = not_null("customer_id")
DROP_NULL = Fix("drop_where", None, {"rule": rule_param(NO_CUSTOMER)})
FILL_NULL = Fix("fill_null", "customer_id", {"value": "UNKNOWN"})
NULLS_SQL = "(SELECT count(*) FROM dirty WHERE customer_id IS NULL)"


@query(
    "gate_row_preservation",
    f"WITH {DIRTY_SQL}\n"
    + gate_sql(DROP_NULL, NULLS_SQL, "0", f"{NULLS_SQL} = 0", "(SELECT count(customer_id) FROM dirty)")
    + "\nUNION ALL\n"
    + gate_sql(FILL_NULL, NULLS_SQL, "0", "TRUE"),
)
def gate_row_preservation(spark: SparkSession, sf: str) -> DataFrame:
    return try_each(spark, sf, [NO_CUSTOMER], [(DROP_NULL, NO_CUSTOMER), (FILL_NULL, NO_CUSTOMER)], True)


AMOUNT_RANGE = between("order_amount", AMOUNT_LOW, AMOUNT_HIGH)
OUT_SQL = f"(SELECT count(*) FROM dirty WHERE order_amount < {AMOUNT_LOW} OR order_amount > {AMOUNT_HIGH})"
EFFICACY = [
    # Repairs everything, a part, nothing.
    (Fix("clamp", "order_amount", {"min": AMOUNT_LOW, "max": AMOUNT_HIGH}), "0", "TRUE"),
    (
        Fix("replace_where", "order_amount", {"predicate": "order_amount < 0", "value": AMOUNT_LOW}),
        f"(SELECT count(*) FROM dirty WHERE order_amount > {AMOUNT_HIGH} OR"
        f" (order_amount < {AMOUNT_LOW} AND order_amount >= 0))",
        "(SELECT count(*) FROM dirty WHERE order_amount < 0) > 0",
    ),
    (Fix("fill_null", "order_amount", {"value": AMOUNT_LOW}), OUT_SQL, "FALSE"),
]


@query(
    "gate_efficacy",
    f"WITH {DIRTY_SQL}\n" + "\nUNION ALL\n".join(gate_sql(fix, OUT_SQL, after, ok) for fix, after, ok in EFFICACY),
)
def gate_efficacy(spark: SparkSession, sf: str) -> DataFrame:
    return try_each(spark, sf, [AMOUNT_RANGE], [(fix, AMOUNT_RANGE) for fix, _, _ in EFFICACY], True)


PROTECTED = [AMOUNT_RANGE, not_null("order_amount"), unique("order_id"), not_null("order_id")]
NULL_OUT = Fix("null_out", "order_amount", {"rule": rule_param(AMOUNT_RANGE)})
SAME_KEY = Fix("fill_null", "order_id", {"value": "UNKNOWN"})


@query(
    "gate_no_regression",
    f"WITH {DIRTY_SQL}\n"
    + gate_sql(NULL_OUT, OUT_SQL, "0", "FALSE")
    + "\nUNION ALL\n"
    + gate_sql(SAME_KEY, "(SELECT count(*) FROM dirty WHERE order_id IS NULL)", "0",
               "(SELECT count(*) FROM dirty WHERE order_id IS NULL) = 1"),
)
def gate_no_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Emptying bad amounts breaks the null rule; one shared stand-in key breaks uniqueness."""
    return try_each(spark, sf, PROTECTED, [(NULL_OUT, AMOUNT_RANGE), (SAME_KEY, PROTECTED[3])], True)


def _lose_column(df: DataFrame) -> DataFrame:
    return df.drop("payment_method")


def _retype(df: DataFrame) -> DataFrame:
    return df.withColumn("order_amount", F.col("order_amount").cast("string"))


def _late_failure(df: DataFrame) -> DataFrame:
    # Analyses and counts fine, fails on rows far beyond any small sample.
    broken = F.when(F.col("k") == F.lit(1000), F.lit("x")).otherwise(F.lit("1")).cast("int")
    return df.withColumn("order_amount", F.col("order_amount") * broken)


CUSTOM = {"lose_column": _lose_column, "retype": _retype, "late_failure": _late_failure}


@query(
    "gate_schema_and_evaluation",
    f"WITH {DIRTY_SQL}\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{Fix("custom", None, {"name": name}).fix_id}' AS fix_id, '{note}' AS note, FALSE AS passed,
 CAST((SELECT count(*) FROM dirty) AS BIGINT) AS rows_before"""
        for name, note in (
            ("lose_column", "dropped columns"),
            ("retype", "changed the type"),
            ("late_failure", "does not run"),
        )
    ),
)
def gate_schema_and_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    incoming = dirty(spark, sf)
    before = snapshot(incoming, [AMOUNT_RANGE])
    rows = []
    for name in CUSTOM:
        fix = Fix("custom", None, {"name": name})
        result = check_fixes(incoming, before, [AMOUNT_RANGE], [(fix, AMOUNT_RANGE)], False, CUSTOM)[2][0]
        note = next(n for n in ("dropped columns", "changed the type", "does not run") if n in result.note)
        rows.append((fix.fix_id, note, result.passed, result.rows_before))
    return spark.createDataFrame(rows, "fix_id string, note string, passed boolean, rows_before bigint")


BASE_RULES = [
    between("order_amount", min=0),
    between("order_amount", max=100000),
    where("order_timestamp < TIMESTAMP_NTZ '2100-01-01 00:00:00'"),
    in_set("country_code", ["CA", "DE"]),
]


@query(
    "gate_rule_baseline",
    f"WITH {DIRTY_SQL}\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{r.rule_id}' AS rule_id, (SELECT count(*) FROM base WHERE {bad}) = 0 AS passed,"
        f" CAST((SELECT count(*) FROM base WHERE {bad}) AS VARCHAR) AS flagged"
        for r, bad in zip(
            BASE_RULES,
            (
                "order_amount < 0",
                "order_amount > 100000",
                "order_timestamp >= TIMESTAMP '2100-01-01'",
                "country_code NOT IN ('CA','DE')",
            ),
            strict=True,
        )
    ),
)
def gate_rule_baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for rule, check in zip(BASE_RULES, check_rules(base(spark, sf), BASE_RULES), strict=True):
        flagged = "0" if check.passed else check.note.split(": ")[1].split("/")[0]
        rows.append((rule.rule_id, check.passed, flagged))
    return spark.createDataFrame(rows, "rule_id string, passed boolean, flagged string")


# Rule proposed per failed calibrated rule: text by its length, the rest by its nulls.
PROPOSED_KINDS = {
    "order_id": "length_between",
    "customer_id": "length_between",
    "customer_email": "length_between",
    "payment_method": "length_between",
    "order_timestamp": "not_null",
}


def proposal_sql(i: int, kind: str, column: str) -> str:
    proposed = PROPOSED_KINDS.get(column, "" if kind == "not_null" else "not_null")
    text = proposed == "length_between"
    return f"""SELECT '{kind}' AS rule, '{column}' AS "column", '{proposed}' AS proposed,
 {f"(SELECT CAST(min(length({column})) AS BIGINT) FROM base)" if text else "CAST(NULL AS BIGINT)"} AS low,
 {f"(SELECT CAST(max(length({column})) AS BIGINT) FROM base)" if text else "CAST(NULL AS BIGINT)"} AS high,
 {"TRUE" if proposed else "FALSE"} AS passed FROM flagged HAVING count(*) FILTER (WHERE v{i}) > 0"""


@query(
    "rule_proposals",
    f"WITH {FLAGGED_SQL}\n"
    + "\nUNION ALL\n".join(proposal_sql(i, kind, column) for i, (kind, column, _, _) in enumerate(SUITE_SQL)),
)
def rule_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Rules proposed for the failures of the incoming table, each tried on the baseline."""
    clean = base(spark, sf)
    propose = related_rules(clean, ORDERS)
    failed = [m for m in measure(dirty(spark, sf), calibrate(clean, ORDERS)) if not m.success]
    proposals = [propose(m) for m in failed]
    stated = [r for r in proposals if r is not None]
    passed = {r for r, check in zip(stated, check_rules(clean, stated), strict=True) if check.passed}
    rows = []
    for failure, rule in zip(failed, proposals, strict=True):
        bounds = (None, None) if rule is None else (rule.params.get("min"), rule.params.get("max"))
        rows.append((failure.rule.kind, failure.rule.column, rule.kind if rule else "", *bounds, rule in passed))
    return spark.createDataFrame(
        rows, "rule string, column string, proposed string, low bigint, high bigint, passed boolean"
    )


# A table of foreign rules, one per order: names in three spellings, parameters right and wrong.
IMPORT_SQL = """SELECT k, CASE WHEN problem IS NULL THEN rule END AS rule, problem,
 CASE WHEN problem IS NULL AND k % 7 = 0 THEN 'O,F' WHEN problem IS NULL AND k % 7 = 5 THEN 'A,B' END AS "values",
 CASE WHEN problem IS NULL AND k % 7 = 1 THEN '10.01' END AS low,
 CASE WHEN problem IS NULL AND k % 7 = 3 THEN '^[OF]$' END AS regex
FROM (SELECT *, CASE k % 7 WHEN 0 THEN 'in_set' WHEN 1 THEN 'between' WHEN 2 THEN 'not_null' WHEN 3 THEN 'matches'
  WHEN 5 THEN 'in_set' WHEN 6 THEN 'length_between' END AS rule,
 CASE WHEN k % 7 = 4 THEN 'unknown rule' WHEN k % 11 = 0 THEN 'no column'
  WHEN k % 7 = 6 AND k % 3 = 1 THEN 'unknown parameter'
  WHEN k % 7 = 1 AND k % 3 = 0 THEN 'no bound'
  WHEN k % 7 = 6 AND k % 3 = 0 THEN 'bound is no number'
  WHEN k % 7 = 5 AND k % 2 = 0 THEN 'values are no list'
  WHEN k % 7 = 6 AND k % 3 = 2 THEN 'mostly not in 0..1' END AS problem FROM (SELECT o_orderkey AS k FROM orders))"""


def _rule_table(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS k",
        """CASE o_orderkey % 7 WHEN 0 THEN 'ExpectColumnValuesToBeInSet' WHEN 1 THEN 'expect_column_values_to_be_between'
           WHEN 2 THEN 'not_null' WHEN 3 THEN 'ExpectColumnValuesToMatchRegex' WHEN 4 THEN 'expect_string_to_match_regex'
           WHEN 5 THEN 'expect_column_values_to_be_in_set' ELSE 'length_between' END AS name""",
        "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'o_orderstatus' END AS `column`",
        """CASE o_orderkey % 7 WHEN 0 THEN '{"column":"o_orderstatus","value_set":["O","F"]}'
           WHEN 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE '{"min_value":"10.01","max_value":"500"}' END
           WHEN 2 THEN '{}' WHEN 3 THEN '{"regex":"^[OF]$"}' WHEN 4 THEN '{"regex":"x"}'
           WHEN 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN '{"value_set":"[not, a list"}'
             ELSE '{"value_set":"[\\'A\\', \\'B\\']"}' END
           ELSE CASE WHEN o_orderkey % 3 = 0 THEN '{"min":"one"}'
             WHEN o_orderkey % 3 = 1 THEN '{"min":"1","threshold":"2"}' ELSE '{"min":"1","mostly":"1.5"}' END
           END AS params""",
    )


@query("rules_import", IMPORT_SQL)
def rules_import(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = import_rules(_rule_table(table(spark, sf, "orders")))
    shape = ["k", "rule", "problem", "values", "low", "regex"]
    accepted = good.select(
        "k",
        "rule",
        F.lit(None).cast("string").alias("problem"),
        F.array_join("values", ",").alias("values"),
        F.col("min").alias("low"),
        "regex",
    )
    rejected = bad.select(
        "k", *[F.col("problem") if c == "problem" else F.lit(None).cast("string").alias(c) for c in shape[1:]]
    )
    return accepted.unionByName(rejected)


# -- routed rows and changes beside the target ---------------------------------------------

ROUTE = [
    Fix("quarantine_where", "order_amount", {"rule": rule_param(AMOUNT_RANGE)}),
    Fix("fill_null", "customer_id", {"value": "UNKNOWN"}),
    Fix("quarantine_where", None, {"predicate": "payment_method = 'CRYPTO'"}),
]
OUT_OF_RANGE = f"coalesce(order_amount < {AMOUNT_LOW} OR order_amount > {AMOUNT_HIGH}, FALSE)"


@query(
    "fix_quarantine_replayed",
    f"""WITH {DIRTY_SQL} SELECT order_id, CASE WHEN {OUT_OF_RANGE} THEN customer_id ELSE coalesce(customer_id, 'UNKNOWN') END AS customer_id,
 {", ".join(c for c in [*ORDER_COLUMNS, "k"] if c not in ("order_id", "customer_id"))},
 CASE WHEN {OUT_OF_RANGE} THEN '{ROUTE[0].fix_id}' WHEN payment_method = 'CRYPTO' THEN '{ROUTE[2].fix_id}' END AS fix_id FROM dirty""",
)
def fix_quarantine_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Rows kept and rows routed aside by accepted repairs: together the incoming table, each row once."""
    replay = apply_fixes(dirty(spark, sf), ROUTE)
    return replay.df.withColumn(FIX_ID, F.lit(None).cast("string")).unionByName(replay.routed)


def _fill_customer(df: DataFrame) -> DataFrame:
    return df.withColumn("customer_id", F.coalesce("customer_id", F.lit("UNKNOWN")))


def _fill_and_round(df: DataFrame) -> DataFrame:
    """Fills customers, and spoils the amounts of some orders that nobody asked about."""
    spoiled = F.when(F.col("k") % 7 == 0, F.lit(5000.0)).otherwise(F.col("order_amount"))
    return _fill_customer(df).withColumn("order_amount", spoiled)


def _fill_all(df: DataFrame) -> DataFrame:
    """Fills customers, and some that were there."""
    return df.withColumn("customer_id", F.when(F.col("k") % 11 == 0, F.lit("UNKNOWN")).otherwise(F.coalesce("customer_id", F.lit("UNKNOWN"))))


def _fill_and_lose(df: DataFrame) -> DataFrame:
    """Fills customers, and loses orders that had one."""
    return _fill_customer(df.filter("customer_id IS NULL OR k % 13 <> 0"))


SPOILERS = {"fill": _fill_customer, "round": _fill_and_round, "all": _fill_all, "lose": _fill_and_lose}
SPOILED_SQL = {
    "fill": ("customer_id IS NULL", "FALSE", "TRUE"),
    "round": (
        "customer_id IS NULL OR (k % 7 = 0 AND order_amount IS DISTINCT FROM 5000)", "k % 7 = 0 AND order_amount IS DISTINCT FROM 5000", "TRUE"
    ),
    "all": (
        "customer_id IS NULL OR (k % 11 = 0 AND customer_id IS DISTINCT FROM 'UNKNOWN')", "customer_id IS NOT NULL AND k % 11 = 0", "TRUE"
    ),
    "lose": ("customer_id IS NULL", "FALSE", "customer_id IS NULL OR k % 13 <> 0"),
}


@query(
    "gate_change",
    f"WITH {DIRTY_SQL}\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS name, CAST(count_if(({changed}) AND ({left})) AS BIGINT) AS changed_rows,
 CAST(count_if(({beside}) AND ({left})) AS BIGINT) AS collateral_rows, CAST(count_if({left}) AS BIGINT) AS rows_after,
 count_if(({beside}) AND ({left})) = 0 AND count_if(NOT ({left})) = 0 AS passed FROM dirty"""
        for name, (changed, beside, left) in SPOILED_SQL.items()
    ),
)
def gate_change(spark: SparkSession, sf: str) -> DataFrame:
    """A custom repair may change the column it is for, in rows that break the rule, and nothing else."""
    incoming = dirty(spark, sf)
    before = snapshot(incoming, [NO_CUSTOMER])
    rows = []
    for name in SPOILERS:
        fix = Fix("custom", "customer_id", {"name": name})
        (r,) = check_fixes(incoming, before, [NO_CUSTOMER], [(fix, NO_CUSTOMER)], False, SPOILERS)[2]
        rows.append((name, r.changed_rows, r.collateral_rows, r.rows_after, r.passed))
    return spark.createDataFrame(rows, "name string, changed_rows bigint, collateral_rows bigint, rows_after bigint, passed boolean")


@query(
    "gate_quarantine",
    f"""WITH {DIRTY_SQL} SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count_if(NOT {OUT_OF_RANGE}) AS BIGINT) AS rows_after,
 CAST(count_if({OUT_OF_RANGE}) AS BIGINT) AS routed_rows, count_if({OUT_OF_RANGE}) > 0 AS passed FROM dirty""",
)
def gate_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Routing rows aside passes where no row may be dropped: kept and routed rows add up."""
    incoming = dirty(spark, sf)
    before = snapshot(incoming, [AMOUNT_RANGE])
    (r,) = check_fixes(incoming, before, [AMOUNT_RANGE], [(ROUTE[0], AMOUNT_RANGE)], True)[2]
    return spark.createDataFrame(
        [(r.rows_before, r.rows_after, r.routed_rows, r.passed)], "rows_before bigint, rows_after bigint, routed_rows bigint, passed boolean"
    )
