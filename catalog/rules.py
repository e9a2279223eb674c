"""Single-rule and whole-suite queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixture import DIRTY_SQL, ORDER_COLUMNS, ORDERS, base, dirty, query, table
from tablecare.operators.calibrate import calibrate
from tablecare.operators.report import sample_failures
from tablecare.operators.validate import (
    attribute,
    dry_run,
    failing_keys,
    reason_counts,
    reason_rollup,
    validate,
)
from tablecare.spec import (
    EMAIL_REGEX,
    Rule,
    between,
    foreign_key,
    in_set,
    length_between,
    matches,
    not_null,
    unique,
    where,
)

METHODS = ["CARD", "TRANSFER", "VOUCHER", "WALLET"]
METHODS_SQL = "('CARD','TRANSFER','VOUCHER','WALLET')"
AMOUNT_LOW, AMOUNT_HIGH = 1000.0, 500000.0
TIME_LOW, TIME_HIGH = "1990-01-01T00:00:00", "2010-12-31T00:00:00"


def counts(result: DataFrame) -> DataFrame:
    """The common shape of rule results."""
    return result.select(
        "rule_id",
        "rule",
        "column",
        "element_count",
        "unexpected_count",
        F.round("unexpected_percent", 4).alias("unexpected_percent"),
        F.round("unexpected_percent_total", 4).alias("unexpected_percent_total"),
        "success",
    )


def judged(result: DataFrame) -> DataFrame:
    """The common shape of results judged by one number."""
    return result.select(
        "rule_id", "rule", "column", "element_count", F.round("observed", 4).alias("observed"), "success"
    )


def counts_sql(rule: Rule, violation: str, evaluated: str = "TRUE", source: str = "dirty") -> str:
    """SQL of one rule result: both conditions are stated per row of ``source``."""
    return f"""SELECT '{rule.rule_id}' AS rule_id, '{rule.kind}' AS rule, '{rule.column}' AS "column",
 n AS element_count, u AS unexpected_count,
 CASE WHEN e > 0 THEN round(100.0 * u / e, 4) ELSE 0.0 END AS unexpected_percent,
 CASE WHEN n > 0 THEN round(100.0 * u / n, 4) ELSE 0.0 END AS unexpected_percent_total,
 (e = 0 OR 1 - CAST(u AS DOUBLE) / e >= {rule.mostly}) AS success
 FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE {evaluated}) AS BIGINT) AS e,
  CAST(count(*) FILTER (WHERE coalesce({violation}, FALSE)) AS BIGINT) AS u FROM {source})"""


def judged_sql(rule: Rule, observed: str, test: str, source: str) -> str:
    return f"""SELECT '{rule.rule_id}' AS rule_id, '{rule.kind}' AS rule, '{rule.column}' AS "column",
 n AS element_count, round(CAST(o AS DOUBLE), 4) AS observed, ({test}) AS success
 FROM (SELECT CAST(count(*) AS BIGINT) AS n, {observed} AS o FROM {source})"""


def union_sql(*selects: str, head: str = DIRTY_SQL) -> str:
    return f"WITH {head}\n" + "\nUNION ALL\n".join(selects)


DUPLICATED = "dirty LEFT JOIN (SELECT order_id AS dup_id FROM dirty GROUP BY 1 HAVING count(*) > 1) ON order_id = dup_id"

# -- one rule each -------------------------------------------------------------------------

NOT_NULL = [not_null(c) for c in ("order_id", "customer_id", "order_amount")]


@query("rule_not_null", union_sql(*[counts_sql(r, f"{r.column} IS NULL") for r in NOT_NULL]))
def rule_not_null(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), NOT_NULL))


UNIQUE = unique("order_id")


@query("rule_unique", union_sql(counts_sql(UNIQUE, "dup_id IS NOT NULL", "order_id IS NOT NULL", DUPLICATED)))
def rule_unique(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), [UNIQUE]))


IN_SET = [in_set("payment_method", METHODS), in_set("country_code", ["CA", "DE", "FR"])]


@query(
    "rule_in_set",
    union_sql(
        counts_sql(IN_SET[0], f"payment_method NOT IN {METHODS_SQL}", "payment_method IS NOT NULL"),
        counts_sql(IN_SET[1], "country_code NOT IN ('CA','DE','FR')", "country_code IS NOT NULL"),
    ),
)
def rule_in_set(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), IN_SET))


# More values than are compared one by one, with a fraction and a null among whole numbers; and a short list alike.
LONG_SET = [
    in_set("k", [*(v for v in range(1, 6001) if v % 3), 2.5, None]),
    in_set("k", [1.0, 2.0, 2.5, None]),
]


@query(
    "rule_in_set_long",
    union_sql(
        counts_sql(LONG_SET[0], "k > 6000 OR k % 3 = 0", "k IS NOT NULL"),
        counts_sql(LONG_SET[1], "k NOT IN (1, 2)", "k IS NOT NULL"),
    ),
)
def rule_in_set_long(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), LONG_SET))


BETWEEN = [
    between("order_amount", AMOUNT_LOW, AMOUNT_HIGH),
    between("order_amount", min=0),
    between("order_amount", max=AMOUNT_HIGH),
]


@query(
    "rule_between_numeric",
    union_sql(
        *[
            counts_sql(r, bad, "order_amount IS NOT NULL")
            for r, bad in zip(
                BETWEEN,
                (
                    f"order_amount < {AMOUNT_LOW} OR order_amount > {AMOUNT_HIGH}",
                    "order_amount < 0",
                    f"order_amount > {AMOUNT_HIGH}",
                ),
                strict=True,
            )
        ]
    ),
)
def rule_between_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), BETWEEN))


BETWEEN_TS = between("order_timestamp", TIME_LOW, TIME_HIGH)


@query(
    "rule_between_ts",
    union_sql(
        counts_sql(
            BETWEEN_TS,
            f"order_timestamp < TIMESTAMP '{TIME_LOW}' OR order_timestamp > TIMESTAMP '{TIME_HIGH}'",
            "order_timestamp IS NOT NULL",
        )
    ),
)
def rule_between_ts(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), [BETWEEN_TS]))


MATCHES = [matches("customer_email", EMAIL_REGEX), matches("customer_id", "C00.*[05]$")]


@query(
    "rule_matches",
    union_sql(
        *[
            counts_sql(r, f"NOT regexp_matches({r.column}, '{r.params['regex']}')", f"{r.column} IS NOT NULL")
            for r in MATCHES
        ]
    ),
)
def rule_matches(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), MATCHES))


LENGTH = [length_between("text", 100, 2000), length_between("text", min=400), length_between("source", max=5)]


@query(
    "rule_length_between",
    union_sql(
        *[
            counts_sql(r, bad, f"{r.column} IS NOT NULL", "documents")
            for r, bad in zip(
                LENGTH,
                ("length(text) NOT BETWEEN 100 AND 2000", "length(text) < 400", "length(source) > 5"),
                strict=True,
            )
        ]
    ),
)
def rule_length_between(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(table(spark, sf, "documents"), LENGTH))


MOSTLY = [
    not_null("customer_id", mostly=0.85),
    not_null("customer_id", mostly=0.95),
    in_set("payment_method", METHODS, mostly=0.99),
    between("order_amount", AMOUNT_LOW, AMOUNT_HIGH, mostly=0.9999),
    unique("order_id", mostly=0.5),
]


@query(
    "rule_mostly",
    union_sql(
        counts_sql(MOSTLY[0], "customer_id IS NULL"),
        counts_sql(MOSTLY[1], "customer_id IS NULL"),
        counts_sql(MOSTLY[2], f"payment_method NOT IN {METHODS_SQL}", "payment_method IS NOT NULL"),
        counts_sql(
            MOSTLY[3],
            f"order_amount < {AMOUNT_LOW} OR order_amount > {AMOUNT_HIGH}",
            "order_amount IS NOT NULL",
        ),
        counts_sql(MOSTLY[4], "dup_id IS NOT NULL", "order_id IS NOT NULL", DUPLICATED),
    ),
)
def rule_mostly(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), MOSTLY))


WHERE = [
    where("order_amount < 300000 OR payment_method <> 'CARD'"),
    where("substr(order_id, 5) = lpad(CAST(k AS STRING), CAST(greatest(6, length(CAST(k AS STRING))) AS INT), '0')", "order_id"),
]


@query(
    "rule_where",
    union_sql(
        counts_sql(
            WHERE[0],
            "NOT (order_amount < 300000 OR payment_method <> 'CARD')",
            "(order_amount < 300000 OR payment_method <> 'CARD') IS NOT NULL",
        ),
        counts_sql(
            WHERE[1],
            "substr(order_id, 5) <> lpad(CAST(k AS VARCHAR), CAST(greatest(6, length(CAST(k AS VARCHAR))) AS INT), '0')",
            "order_id IS NOT NULL",
        ),
    ),
)
def rule_where(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), WHERE))


TIER2 = [
    Rule("is_null", ("customer_id",)),
    Rule("not_in_set", ("payment_method",), {"values": ["CRYPTO", "CARD"]}),
    Rule("not_matches", ("customer_email",), {"regex": "_at_"}),
    Rule("matches_any", ("country_code",), {"regexes": ["^C", "^D", "K$"]}),
    Rule("like", ("customer_email",), {"pattern": "user%@example.com"}),
]


@query(
    "rule_tier2_row",
    union_sql(
        counts_sql(TIER2[0], "customer_id IS NOT NULL"),
        counts_sql(TIER2[1], "payment_method IN ('CRYPTO','CARD')", "payment_method IS NOT NULL"),
        counts_sql(TIER2[2], "regexp_matches(customer_email, '_at_')", "customer_email IS NOT NULL"),
        counts_sql(TIER2[3], "NOT regexp_matches(country_code, '^C|^D|K$')", "country_code IS NOT NULL"),
        counts_sql(TIER2[4], "customer_email NOT LIKE 'user%@example.com'", "customer_email IS NOT NULL"),
    ),
)
def rule_tier2_row(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), TIER2))


CASTABLE = [
    Rule("castable", ("amount_text",), {"type": "double"}),
    Rule("castable", ("key_text",), {"type": "bigint"}),
]


@query(
    "rule_castable",
    union_sql(
        *[
            counts_sql(
                r,
                f"TRY_CAST({r.column} AS {r.params['type']}) IS NULL AND {r.column} IS NOT NULL",
                f"{r.column} IS NOT NULL",
                """(SELECT CASE WHEN k % 50 = 3 THEN 'n/a' ELSE CAST(k AS VARCHAR) || '.5' END AS amount_text,
                    CASE WHEN k % 40 = 1 THEN NULL WHEN k % 40 = 2 THEN 'K' || CAST(k AS VARCHAR)
                    ELSE CAST(k AS VARCHAR) END AS key_text FROM dirty)""",
            )
            for r in CASTABLE
        ]
    ),
)
def rule_castable(spark: SparkSession, sf: str) -> DataFrame:
    texts = dirty(spark, sf).selectExpr(
        "CASE WHEN k % 50 = 3 THEN 'n/a' ELSE concat(k, '.5') END AS amount_text",
        "CASE WHEN k % 40 = 1 THEN NULL WHEN k % 40 = 2 THEN concat('K', k) ELSE CAST(k AS STRING) END AS key_text",
    )
    return counts(validate(texts, CASTABLE))


AGGREGATES = [
    Rule("min_between", ("l_quantity",), {"min": 1, "max": 1}),
    Rule("max_between", ("l_quantity",), {"max": 49}),
    Rule("mean_between", ("l_discount",), {"min": 0.04, "max": 0.06}),
    Rule("sum_between", ("l_linenumber",), {"min": 1}),
    Rule("stddev_between", ("l_quantity",), {"min": 20}),
    Rule("median_between", ("l_extendedprice",), {"min": 0}),
    Rule("quantile_between", ("l_extendedprice",), {"q": 0.95, "max": 1000}),
    Rule("null_ratio_between", ("l_shipdate",), {"max": 0.0}),
]
AGGREGATE_SQL = {
    "min_between": ("min(l_quantity)", "o >= 1 AND o <= 1"),
    "max_between": ("max(l_quantity)", "o <= 49"),
    "mean_between": ("avg(l_discount)", "o BETWEEN 0.04 AND 0.06"),
    "sum_between": ("sum(l_linenumber)", "o >= 1"),
    "stddev_between": ("stddev_samp(l_quantity)", "o >= 20"),
    "median_between": ("quantile_disc(l_extendedprice, 0.5)", "o >= 0"),
    "quantile_between": ("quantile_disc(l_extendedprice, 0.95)", "o <= 1000"),
    "null_ratio_between": ("CAST(count(*) - count(l_shipdate) AS DOUBLE) / count(*)", "o <= 0"),
}


@query(
    "rule_aggregate_bounds",
    "\nUNION ALL\n".join(judged_sql(r, *AGGREGATE_SQL[r.kind], "lineitem") for r in AGGREGATES),
)
def rule_aggregate_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return judged(validate(table(spark, sf, "lineitem"), AGGREGATES))


DISTINCTS = [
    Rule("distinct_count_between", ("payment_method",), {"max": 4}),
    Rule("unique_ratio_between", ("order_id",), {"min": 0.99}),
    Rule("null_ratio_between", ("customer_id",), {"max": 0.05}),
]


@query(
    "rule_distinct_bounds",
    union_sql(
        judged_sql(DISTINCTS[0], "count(DISTINCT payment_method)", "o <= 4", "dirty"),
        judged_sql(DISTINCTS[1], "CAST(count(DISTINCT order_id) AS DOUBLE) / count(order_id)", "o >= 0.99", "dirty"),
        judged_sql(
            DISTINCTS[2], "CAST(count(*) - count(customer_id) AS DOUBLE) / count(*)", "o <= 0.05", "dirty"
        ),
    ),
)
def rule_distinct_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return judged(validate(dirty(spark, sf), DISTINCTS))


DISTINCT_SETS = [
    Rule("distinct_in_set", ("payment_method",), {"values": METHODS}),
    Rule("distinct_equal_set", ("country_code",), {"values": ["CA", "DE", "FR", "UK", "US"]}),
    Rule("distinct_contain_set", ("country_code",), {"values": ["CA", "XX"]}),
    Rule("most_common_in_set", ("payment_method",), {"values": METHODS}),
]


@query(
    "rule_distinct_set",
    union_sql(
        *[
            f"""SELECT '{r.rule_id}' AS rule_id, '{r.kind}' AS rule, '{r.column}' AS "column",
 CAST(bad AS BIGINT) AS unexpected_count, (bad = 0) AS success FROM ({bad})"""
            for r, bad in zip(
                DISTINCT_SETS,
                (
                    f"SELECT count(DISTINCT payment_method) AS bad FROM dirty WHERE payment_method NOT IN {METHODS_SQL}",
                    "SELECT count(DISTINCT country_code) FILTER (WHERE country_code NOT IN ('CA','DE','FR','UK','US'))"
                    " + 5 - count(DISTINCT country_code) FILTER (WHERE country_code IN ('CA','DE','FR','UK','US'))"
                    " AS bad FROM dirty",
                    "SELECT 2 - count(DISTINCT country_code) AS bad FROM dirty WHERE country_code IN ('CA','XX')",
                    f"SELECT CASE WHEN payment_method IN {METHODS_SQL} THEN 0 ELSE 1 END AS bad FROM"
                    " (SELECT payment_method FROM dirty WHERE payment_method IS NOT NULL"
                    " GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
                ),
                strict=True,
            )
        ]
    ),
)
def rule_distinct_set(spark: SparkSession, sf: str) -> DataFrame:
    return validate(dirty(spark, sf), DISTINCT_SETS).select(
        "rule_id", "rule", "column", "unexpected_count", "success"
    )


ROW_COUNTS = [
    Rule("row_count_between", (), {"min": 1}),
    Rule("row_count_equals", (), {"table": "orders"}),
    Rule("row_count_equals", (), {"table": "dirty"}),
]


@query(
    "rule_row_count",
    union_sql(
        judged_sql(ROW_COUNTS[0], "count(*)", "o >= 1", "dirty"),
        judged_sql(ROW_COUNTS[1], "count(*)", "o = (SELECT count(*) FROM orders)", "dirty"),
        judged_sql(ROW_COUNTS[2], "count(*)", "o = (SELECT count(*) FROM dirty)", "dirty"),
    ),
)
def rule_row_count(spark: SparkSession, sf: str) -> DataFrame:
    incoming = dirty(spark, sf)
    return judged(validate(incoming, ROW_COUNTS, {"orders": table(spark, sf, "orders"), "dirty": incoming}))


COLUMN_NAMES = [
    Rule("columns_exist", ("order_id", "nonsense")),
    Rule("columns_match_ordered", (*ORDER_COLUMNS, "k")),
    Rule("columns_match_set", ("k", *ORDER_COLUMNS)),
    Rule("row_count_between", (), {"min": 1}),
]


@query(
    "rule_columns",
    union_sql(
        *[
            f"""SELECT '{r.rule_id}' AS rule_id, '{r.kind}' AS rule, '{r.column}' AS "column",
 CAST({n} AS BIGINT) AS element_count, CAST({bad} AS BIGINT) AS unexpected_count, {bad} = 0 AS success"""
            for r, n, bad in zip(
                COLUMN_NAMES, ("0", "0", "0", "(SELECT count(*) FROM dirty)"), (1, 0, 0, 0), strict=True
            )
        ]
    ),
)
def rule_columns(spark: SparkSession, sf: str) -> DataFrame:
    return validate(dirty(spark, sf), COLUMN_NAMES).select(
        "rule_id", "rule", "column", "element_count", "unexpected_count", "success"
    )


PAIRS = [
    Rule("pair_greater", ("l_extendedprice", "l_quantity")),
    Rule("pair_greater", ("l_discount", "l_tax"), {"or_equal": True}),
    Rule("pair_equal", ("l_discount", "l_tax")),
    Rule("pair_in_set", ("l_returnflag", "l_linestatus"), {"values": [["A", "F"], ["N", "O"], ["R", "F"]]}),
    Rule("sum_equals", ("l_discount", "l_tax"), {"total": 0.1}),
]


@query(
    "rule_pair",
    "\nUNION ALL\n".join(
        counts_sql(r, bad, f"{r.columns[0]} IS NOT NULL AND {r.columns[1]} IS NOT NULL", "lineitem")
        for r, bad in zip(
            PAIRS,
            (
                "l_extendedprice <= l_quantity",
                "l_discount < l_tax",
                "l_discount <> l_tax",
                "(l_returnflag, l_linestatus) NOT IN (('A','F'),('N','O'),('R','F'))",
                "l_discount + l_tax <> CAST(0.1 AS DOUBLE)",
            ),
            strict=True,
        )
    ),
)
def rule_pair(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(table(spark, sf, "lineitem"), PAIRS))


COMPOUND = unique("l_orderkey", "l_linenumber")


@query(
    "rule_compound_unique",
    counts_sql(
        COMPOUND,
        "m > 1",
        source="(SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS m FROM lineitem)",
    ),
)
def rule_compound_unique(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(table(spark, sf, "lineitem"), [COMPOUND]))


ZSCORE = [
    Rule("zscore_below", ("order_amount",), {"threshold": 3}),
    Rule("zscore_below", ("k",), {"threshold": 1.5}),
]


@query(
    "rule_zscore",
    union_sql(
        *[
            counts_sql(
                r,
                f"abs({r.column} - m) / s >= {r.params['threshold']}",
                f"{r.column} IS NOT NULL",
                f"dirty, (SELECT avg({r.column}) AS m, stddev_samp({r.column}) AS s FROM dirty)",
            )
            for r in ZSCORE
        ]
    ),
)
def rule_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return counts(validate(dirty(spark, sf), ZSCORE))


FOREIGN_KEYS = [
    foreign_key("o_custkey", "customer", "c_custkey"),
    foreign_key("parent", "customer", "c_custkey"),
    foreign_key(("parent", "parent_copy"), "customer", ("c_custkey", "c_custkey")),
]
CHILD_SQL = """child AS (SELECT *, CASE WHEN o_orderkey % 90 = 4 THEN NULL WHEN o_orderkey % 100 = 5
 THEN o_custkey + 100000000 ELSE o_custkey END AS parent FROM orders),
 pairs AS (SELECT child.*, parent AS parent_copy FROM child)"""


@query(
    "rule_foreign_key",
    union_sql(
        *[
            counts_sql(
                r,
                f"{r.columns[0]} IS NOT NULL AND {r.columns[0]} NOT IN (SELECT c_custkey FROM customer)",
                f"{r.columns[0]} IS NOT NULL",
                "pairs",
            )
            for r in FOREIGN_KEYS
        ],
        head=CHILD_SQL,
    ),
)
def rule_foreign_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn(
        "parent",
        F.expr(
            "CASE WHEN o_orderkey % 90 = 4 THEN NULL WHEN o_orderkey % 100 = 5 THEN o_custkey + 100000000"
            " ELSE o_custkey END"
        ),
    )
    child = orders.withColumn("parent_copy", F.col("parent"))
    return counts(validate(child, FOREIGN_KEYS, {"customer": table(spark, sf, "customer")}))


# -- whole suites --------------------------------------------------------------------------

# Violation, evaluated and name of every calibrated rule, in suite order.
SUITE_SQL = [
    ("not_null", "order_id", "order_id IS NULL", "TRUE"),
    ("unique", "order_id", "dup_id IS NOT NULL", "order_id IS NOT NULL"),
    ("not_null", "customer_id", "customer_id IS NULL", "TRUE"),
    ("not_null", "order_amount", "order_amount IS NULL", "TRUE"),
    ("between", "order_amount", "order_amount < lo OR order_amount > hi", "order_amount IS NOT NULL"),
    ("not_null", "customer_email", "customer_email IS NULL", "TRUE"),
    (
        "matches",
        "customer_email",
        f"NOT regexp_matches(customer_email, '{EMAIL_REGEX}')",
        "customer_email IS NOT NULL",
    ),
    ("not_null", "payment_method", "payment_method IS NULL", "TRUE"),
    (
        "in_set",
        "payment_method",
        "payment_method NOT IN (SELECT payment_method FROM base)",
        "payment_method IS NOT NULL",
    ),
    ("in_set", "country_code", "country_code NOT IN (SELECT country_code FROM base)", "country_code IS NOT NULL"),
    ("not_null", "order_timestamp", "order_timestamp IS NULL", "TRUE"),
    (
        "between",
        "order_timestamp",
        "order_timestamp < t_lo OR order_timestamp > t_hi",
        "order_timestamp IS NOT NULL",
    ),
]
FLAGGED_SQL = (
    DIRTY_SQL
    + ",\nflagged AS (SELECT "
    + ", ".join(f"coalesce({bad}, FALSE) AS v{i}, ({seen}) AS e{i}" for i, (_, _, bad, seen) in enumerate(SUITE_SQL))
    + f", dirty.* FROM {DUPLICATED}, bounds)"
)


def suite_counts_sql(entries=None) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT CAST({i} AS INTEGER) AS ord, '{kind}' AS rule, '{column}' AS "column",
 CAST(count(*) AS BIGINT) AS element_count, CAST(count(*) FILTER (WHERE v{i}) AS BIGINT) AS unexpected_count,
 round(100.0 * count(*) FILTER (WHERE v{i}) / count(*) FILTER (WHERE e{i}), 4) AS unexpected_percent,
 round(100.0 * count(*) FILTER (WHERE v{i}) / count(*), 4) AS unexpected_percent_total,
 count(*) FILTER (WHERE v{i}) = 0 AS success FROM flagged"""
        for i, (kind, column, _, _) in enumerate(SUITE_SQL)
        if entries is None or i in entries
    )


def suite_counts(result: DataFrame) -> DataFrame:
    return counts(result.withColumn("rule_id", F.col("ord"))).withColumnRenamed("rule_id", "ord")


@query("validate_suite", f"WITH {FLAGGED_SQL}\n{suite_counts_sql()}")
def validate_suite(spark: SparkSession, sf: str) -> DataFrame:
    return suite_counts(validate(dirty(spark, sf), calibrate(base(spark, sf), ORDERS)))


@query(
    "rule_dry_run",
    f"WITH {FLAGGED_SQL}\nSELECT rule, \"column\", element_count, unexpected_count, success FROM"
    f" ({suite_counts_sql({6})})",
)
def rule_dry_run(spark: SparkSession, sf: str) -> DataFrame:
    seen = dry_run(dirty(spark, sf), matches("customer_email", EMAIL_REGEX))
    return spark.createDataFrame(
        [(seen.rule.kind, seen.rule.column, seen.element_count, seen.unexpected_count, seen.success)],
        "rule string, column string, element_count bigint, unexpected_count bigint, success boolean",
    )


def reasons_sql(entries: list[int] | None = None) -> str:
    """The joined reason text of a row, in suite order."""
    parts = ", ".join(
        f"CASE WHEN v{i} THEN '{kind} on ''{column}''' END"
        for i, (kind, column, _, _) in enumerate(SUITE_SQL)
        if entries is None or i in entries
    )
    return f"concat_ws('; ', {parts})"


ROW_SQL = ", ".join([*ORDER_COLUMNS, "k"])


def flagged_orders(spark: SparkSession, sf: str, mostly: dict[tuple[str, str], float] | None = None) -> DataFrame:
    rules = calibrate(base(spark, sf), ORDERS)
    if mostly:
        rules = [
            Rule(r.kind, r.columns, r.params, mostly.get((r.kind, r.column), r.mostly)) for r in rules
        ]
    return attribute(dirty(spark, sf), rules)


def joined(flagged: DataFrame) -> DataFrame:
    return flagged.withColumn("reasons", F.concat_ws("; ", "dq_reasons")).drop("dq_reasons")


@query("row_reasons", f"WITH {FLAGGED_SQL}\nSELECT {ROW_SQL}, {reasons_sql()} AS reasons FROM flagged")
def row_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return joined(flagged_orders(spark, sf))


@query(
    "row_reasons_mostly",
    f"WITH {FLAGGED_SQL}\nSELECT {ROW_SQL}, {reasons_sql([i for i in range(12) if i not in (2, 11)])} AS reasons"
    " FROM flagged",
)
def row_reasons_mostly(spark: SparkSession, sf: str) -> DataFrame:
    return joined(
        flagged_orders(spark, sf, {("not_null", "customer_id"): 0.8, ("between", "order_timestamp"): 0.99})
    )


@query(
    "reason_counts",
    f"WITH {FLAGGED_SQL}\nSELECT * FROM ("
    + "\nUNION ALL\n".join(
        f"SELECT '{kind} on ''{column}''' AS reason, CAST(count(*) FILTER (WHERE v{i}) AS BIGINT) AS row_count"
        " FROM flagged"
        for i, (kind, column, _, _) in enumerate(SUITE_SQL)
    )
    + ") WHERE row_count > 0",
)
def reasons_counted(spark: SparkSession, sf: str) -> DataFrame:
    return reason_counts(flagged_orders(spark, sf))


@query(
    "reason_rollup",
    f"WITH {FLAGGED_SQL}, exploded AS ("
    + "\nUNION ALL\n".join(
        f"SELECT '{kind}' AS rule, '{column}' AS \"column\" FROM flagged WHERE v{i}"
        for i, (kind, column, _, _) in enumerate(SUITE_SQL)
    )
    + ') SELECT "column", rule, CAST(count(*) AS BIGINT) AS row_count FROM exploded GROUP BY ROLLUP("column", rule)',
)
def reasons_rolled_up(spark: SparkSession, sf: str) -> DataFrame:
    return reason_rollup(flagged_orders(spark, sf))


ANY_SQL = " OR ".join(f"v{i}" for i in range(len(SUITE_SQL)))


@query("failing_keys", f"WITH {FLAGGED_SQL}\nSELECT DISTINCT order_id FROM flagged WHERE {ANY_SQL}")
def keys_failing(spark: SparkSession, sf: str) -> DataFrame:
    return failing_keys(flagged_orders(spark, sf), ORDERS.primary_key)


@query(
    "failure_samples",
    f"WITH {FLAGGED_SQL}, exploded AS ("
    + "\nUNION ALL\n".join(
        f"SELECT '{kind} on ''{column}''' AS reason, k, order_amount, customer_email FROM flagged WHERE v{i}"
        for i, (kind, column, _, _) in enumerate(SUITE_SQL)
    )
    + """), ranked AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY k) AS rank FROM exploded)
 SELECT reason, CAST(rank AS BIGINT) AS rank, k FROM ranked WHERE rank <= 8""",
)
def samples(spark: SparkSession, sf: str) -> DataFrame:
    return sample_failures(flagged_orders(spark, sf), ["k"]).select("reason", "rank", "k")


@query(
    "suite_two_ranges",
    union_sql(
        *[
            counts_sql(r, bad, "order_amount IS NOT NULL")
            for r, bad in (
                (between("order_amount", 0, 400000), "order_amount < 0 OR order_amount > 400000"),
                (between("order_amount", 2000, 1000000), "order_amount < 2000 OR order_amount > 1000000"),
            )
        ]
    ),
)
def suite_two_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Two ranges on one column keep their own counts; an identical third is listed once."""
    rules = [
        between("order_amount", 0, 400000),
        between("order_amount", 2000, 1000000),
        between("order_amount", 0, 400000),
    ]
    return counts(validate(dirty(spark, sf), rules))


