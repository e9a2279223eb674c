"""The repair loop, full runs, and what compares or splits their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixture import DIRTY_SQL, ORDER_COLUMNS, ORDERS, base, dirty, query, table
from catalog.rules import (
    AMOUNT_HIGH,
    AMOUNT_LOW,
    ANY_SQL,
    FLAGGED_SQL,
    METHODS,
    METHODS_SQL,
    ROW_SQL,
    flagged_orders,
    joined,
    reasons_sql,
    suite_counts,
    suite_counts_sql,
)
from tablecare.operators.calibrate import calibrate
from tablecare.operators.fixes import apply_fix
from tablecare.operators.sizing import scratch_path
from tablecare.operators.validate import attribute, failing_keys, quarantine, split, validate
from tablecare.plans.loop import LoopOutcome, compare, failing_keys_diff, heal
from tablecare.plans.registry import Registry
from tablecare.plans.run import iteration_history, revalidate, run
from tablecare.sources.sinks import read_quarantine, read_routed, read_runs, run_history, write_quarantine
from tablecare.spec import Fix, RunOptions, between, in_set, not_null, unique

OPTIONS = RunOptions(repair_not_drop=True)
PROPOSED = {"not_null on 'customer_id'": [Fix("fill_null", "customer_id", {"value": "UNKNOWN"})]}

# The same order table after the repairs the loop accepts: the stand-in customer, and the median
# of the incoming amounts and times in place of what is missing or out of range.
HEALED_SQL = (
    FLAGGED_SQL.split(",\nflagged AS")[0]
    + """,
medians AS (SELECT quantile_disc(order_amount, 0.5) AS m, quantile_disc(order_timestamp, 0.5) AS mt FROM dirty),
incoming AS (SELECT * FROM dirty),
healed AS (SELECT order_id, coalesce(customer_id, 'UNKNOWN') AS customer_id,
 CASE WHEN order_amount IS NULL OR order_amount < lo OR order_amount > hi THEN m ELSE order_amount END AS order_amount,
 customer_email, payment_method, country_code,
 CASE WHEN order_timestamp < t_lo OR order_timestamp > t_hi THEN mt ELSE order_timestamp END AS order_timestamp, k
 FROM incoming, bounds, medians),
flagged AS"""
    + FLAGGED_SQL.split(",\nflagged AS")[1]
    .replace("dirty.*", "healed.*")
    .replace("FROM dirty LEFT JOIN (SELECT order_id AS dup_id FROM dirty", "FROM healed LEFT JOIN (SELECT order_id AS dup_id FROM healed")
)


def healed(spark: SparkSession, sf: str) -> LoopOutcome:
    registry = Registry(spark, scratch_path(spark, "registry"))
    registry.seed(calibrate(base(spark, sf), ORDERS))
    return heal(dirty(spark, sf), ORDERS, registry, "orders-run", OPTIONS, proposed_fixes=PROPOSED)


@query("heal", f"WITH {HEALED_SQL}\nSELECT {ROW_SQL}, {reasons_sql()} AS reasons FROM flagged")
def healed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return joined(healed(spark, sf).flagged)


@query(
    "iteration_history",
    f"""WITH {HEALED_SQL}, left_over AS (SELECT CAST(count(DISTINCT order_id) + max(CASE WHEN order_id IS NULL THEN 1
 ELSE 0 END) AS BIGINT) AS remaining_rows FROM flagged WHERE {ANY_SQL}),
 failed AS (SELECT CAST(count(*) AS BIGINT) AS remaining_failures FROM ({suite_counts_sql()}) WHERE NOT success)
 SELECT CAST(loop AS BIGINT) AS loop, remaining_failures, remaining_rows, 'no_progress' AS stop_reason
 FROM left_over, failed, (VALUES (1), (2)) AS l(loop)""",
)
def iterations(spark: SparkSession, sf: str) -> DataFrame:
    outcome = healed(spark, sf)
    history = iteration_history(spark, outcome).drop("candidates")
    return history.withColumn("stop_reason", F.lit(outcome.stop_reason))


@query(
    "heal_accepted_repairs",
    f"""WITH {DIRTY_SQL} SELECT * FROM (
 SELECT 'fill_null' AS action, 'customer_id' AS "column", CAST(count(*) - count(customer_id) AS BIGINT) AS before_count FROM dirty
 UNION ALL SELECT 'fill_null', 'order_amount', count(*) - count(order_amount) FROM dirty
 UNION ALL SELECT 'impute_median', 'order_amount', count(*) FROM dirty, bounds WHERE order_amount < lo OR order_amount > hi
 UNION ALL SELECT 'impute_median', 'order_timestamp', count(*) FROM dirty, bounds
  WHERE order_timestamp < t_lo OR order_timestamp > t_hi) WHERE before_count > 0""",
)
def heal_accepted_repairs(spark: SparkSession, sf: str) -> DataFrame:
    gates = [g for g in healed(spark, sf).gates if g.passed]
    return spark.createDataFrame(
        [(g.fix.action, g.fix.column, g.before_count) for g in gates],
        "action string, column string, before_count bigint",
    )


# -- full run ------------------------------------------------------------------------------


def full_run(spark: SparkSession, sf: str):
    root = scratch_path(spark, "run")
    registry = Registry(spark, f"{root}/registry")
    result = run(
        spark, ORDERS, registry, root, df=dirty(spark, sf), baseline=base(spark, sf), options=OPTIONS,
        proposed_fixes=PROPOSED,
    )
    return root, registry, result


@query(
    "run",
    f"""WITH {HEALED_SQL} SELECT 'orders' AS table_name, 'succeeded' AS status, 'closed' AS phase_reached,
 'no_progress' AS stop_reason, CAST((SELECT count(*) FROM dirty) AS BIGINT) AS total_rows,
 CAST(2 AS BIGINT) AS iterations_run,
 CAST((SELECT count(*) FROM flagged WHERE {ANY_SQL}) AS BIGINT) AS quarantined_rows,
 CAST((SELECT count(*) FROM flagged WHERE NOT ({ANY_SQL})) AS BIGINT) AS clean_rows""",
)
def run_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """The record of a full run, beside what it wrote."""
    root, _, result = full_run(spark, sf)
    out = read_quarantine(spark, root, result.run_id).count()
    kept = spark.read.parquet(f"{root}/clean/run_id={result.run_id}").count()
    return run_history(read_runs(spark, root), "orders").select(
        "table_name",
        "status",
        "phase_reached",
        "stop_reason",
        "total_rows",
        "iterations_run",
        F.lit(out).cast("bigint").alias("quarantined_rows"),
        F.lit(kept).cast("bigint").alias("clean_rows"),
    )


@query("revalidate", f"WITH {HEALED_SQL}\n{suite_counts_sql()}")
def revalidated(spark: SparkSession, sf: str) -> DataFrame:
    """After the run, the accepted repairs are replayed on the source and the suite is measured."""
    root, registry, result = full_run(spark, sf)
    return suite_counts(revalidate(spark, ORDERS, registry, root, result.run_id, df=dirty(spark, sf)))


@query(
    "run_history",
    """SELECT 'run-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(9, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') AS run_id, o_orderpriority AS table_name,
 o_orderdate AS started_at FROM orders WHERE o_orderpriority = '1-URGENT'""",
)
def history(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").selectExpr(
        "concat('run-', lpad(CAST(o_orderkey AS STRING), CAST(greatest(9, length(CAST(o_orderkey AS STRING))) AS INT), '0')) AS run_id",
        "o_orderpriority AS table_name",
        "o_orderdate AS started_at",
    )
    return run_history(runs, "1-URGENT")


# -- comparison and split ------------------------------------------------------------------

COMPARED = [
    not_null("customer_id"),
    between("order_amount", AMOUNT_LOW, AMOUNT_HIGH),
    in_set("payment_method", METHODS),
    unique("order_id"),
]


@query(
    "compare_runs",
    f"WITH {DIRTY_SQL}\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{rule.rule_id}' AS rule_id, CAST(({before}) AS BIGINT) AS before_count,"
        f" CAST(({after}) AS BIGINT) AS after_count, CAST(({after}) - ({before}) AS BIGINT) AS delta"
        for rule, before, after in (
            (COMPARED[0], "SELECT count(*) - count(customer_id) FROM dirty", "SELECT 0"),
            (
                COMPARED[1],
                f"SELECT count(*) FROM dirty WHERE order_amount < {AMOUNT_LOW} OR order_amount > {AMOUNT_HIGH}",
                f"SELECT count(*) FROM dirty WHERE order_amount < {AMOUNT_LOW} OR order_amount > {AMOUNT_HIGH}",
            ),
            (COMPARED[2], f"SELECT count(*) FROM dirty WHERE payment_method NOT IN {METHODS_SQL}", "SELECT 0"),
            (
                COMPARED[3],
                "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM dirty WHERE order_id IS NOT NULL"
                " GROUP BY order_id HAVING count(*) > 1)",
                "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM dirty WHERE order_id IS NOT NULL"
                " GROUP BY order_id HAVING count(*) > 1)",
            ),
        )
    ),
)
def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    before = dirty(spark, sf)
    after = apply_fix(before, PROPOSED["not_null on 'customer_id'"][0])
    after = apply_fix(after, Fix("map_values", "payment_method", {"mapping": {"CRYPTO": "CARD"}}))
    return compare(validate(before, COMPARED), validate(after, COMPARED))


@query(
    "failing_keys_diff",
    f"""WITH {DIRTY_SQL}, before AS (SELECT DISTINCT order_id FROM dirty WHERE customer_id IS NULL OR order_amount < 0),
 after AS (SELECT DISTINCT order_id FROM dirty WHERE coalesce(order_amount, -1) < 0)
 SELECT *, 'resolved' AS change FROM (SELECT * FROM before EXCEPT SELECT * FROM after)
 UNION ALL SELECT *, 'new' FROM (SELECT * FROM after EXCEPT SELECT * FROM before)""",
)
def keys_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Filling customers resolves keys; filling amounts with a bad value makes others fail."""
    rules = [not_null("customer_id"), between("order_amount", min=0)]
    before = dirty(spark, sf)
    after = apply_fix(before, Fix("fill_null", "customer_id", {"value": "UNKNOWN"}))
    after = apply_fix(after, Fix("fill_null", "order_amount", {"value": -1}))
    return failing_keys_diff(
        failing_keys(attribute(before, rules, rules), ["order_id"]),
        failing_keys(attribute(after, rules, rules), ["order_id"]),
    )


@query("clean_split", f"WITH {FLAGGED_SQL}\nSELECT {ROW_SQL}, NOT ({ANY_SQL}) AS is_clean FROM flagged")
def clean_split(spark: SparkSession, sf: str) -> DataFrame:
    kept, out = split(flagged_orders(spark, sf))
    return kept.withColumn("is_clean", F.lit(True)).unionByName(
        out.drop("dq_reasons").withColumn("is_clean", F.lit(False))
    )


QUARANTINE_SQL = f'WITH {FLAGGED_SQL}\nSELECT {ROW_SQL}, {reasons_sql()} AS "Reason" FROM flagged WHERE {ANY_SQL}'


@query("quarantine_rows", QUARANTINE_SQL)
def quarantine_rows(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine(flagged_orders(spark, sf))


@query("quarantine_written", QUARANTINE_SQL)
def quarantine_written(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "out")
    write_quarantine(flagged_orders(spark, sf), root, "run-1", 1)
    return read_quarantine(spark, root, "run-1").select(*ORDER_COLUMNS, "k", "Reason")




# -- stop reasons, routed rows, replayed repairs ------------------------------------------

STOP_RULES = [not_null("customer_id"), in_set("payment_method", METHODS)]
STOP_MODES = {
    "clean": ([STOP_RULES[0]], RunOptions(repair_not_drop=True)),
    "no_progress": (STOP_RULES, RunOptions(repair_not_drop=True)),
    "max_loops_reached": (STOP_RULES, RunOptions(repair_not_drop=True, max_loops=1)),
    "single_pass_mode": (STOP_RULES, RunOptions(repair_not_drop=True, loop_until_clean=False)),
}


@query(
    "stop_reasons",
    f"""WITH {DIRTY_SQL}, n AS (SELECT CAST(count(DISTINCT order_id) AS BIGINT) AS left_over FROM dirty
 WHERE payment_method = 'CRYPTO' AND order_id IS NOT NULL)
SELECT 'clean' AS mode, 'clean' AS stop_reason, CAST(1 AS BIGINT) AS loops, CAST(0 AS BIGINT) AS remaining_rows
UNION ALL SELECT 'no_progress', CASE WHEN left_over > 0 THEN 'no_progress' ELSE 'clean' END, CASE WHEN left_over > 0 THEN 2 ELSE 1 END, left_over FROM n
UNION ALL SELECT 'max_loops_reached', CASE WHEN left_over > 0 THEN 'max_loops_reached' ELSE 'clean' END, 1, left_over FROM n
UNION ALL SELECT 'single_pass_mode', CASE WHEN left_over > 0 THEN 'single_pass_mode' ELSE 'clean' END, 1, left_over FROM n""",
)
def stop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Each reason to stop, reached by the suite and the options that lead there."""
    rows = []
    for mode, (rules, options) in STOP_MODES.items():
        registry = Registry(spark, scratch_path(spark, "registry"))
        registry.seed(rules)
        outcome = heal(dirty(spark, sf), ORDERS, registry, mode, options, proposed_fixes=PROPOSED)
        rows.append((mode, outcome.stop_reason, outcome.loops_run, outcome.iterations[-1]["remaining_rows"]))
    return spark.createDataFrame(rows, "mode string, stop_reason string, loops bigint, remaining_rows bigint")


ROUTE_OPTIONS = RunOptions(repair_not_drop=True, quarantine_failures=True)


@query(
    "run_routed",
    f"""WITH {DIRTY_SQL} SELECT coalesce(order_id, '') AS order_id, k, payment_method, payment_method = 'CRYPTO' AS routed,
 CAST(count_if(payment_method = 'CRYPTO') OVER () AS BIGINT) AS routed_rows, 'clean' AS stop_reason FROM dirty""",
)
def run_routed(spark: SparkSession, sf: str) -> DataFrame:
    """A full run that may route rows aside ends clean; the side table holds what was routed."""
    root = scratch_path(spark, "run")
    registry = Registry(spark, f"{root}/registry")
    registry.seed(STOP_RULES)
    result = run(spark, ORDERS, registry, root, df=dirty(spark, sf), options=ROUTE_OPTIONS, proposed_fixes=PROPOSED)
    recorded = read_runs(spark, root).select("run_id", "routed_rows", "stop_reason")
    kept = spark.read.parquet(f"{root}/clean/run_id={result.run_id}").withColumn("routed", F.lit(False))
    out = read_routed(spark, root, result.run_id).withColumn("routed", F.lit(True))
    names = [F.coalesce("order_id", F.lit("")).alias("order_id"), "k", "payment_method", "routed"]
    rows = kept.select(*names).unionByName(out.select(*names)).withColumn("run_id", F.lit(result.run_id))
    return rows.join(F.broadcast(recorded), "run_id").drop("run_id")


@query(
    "run_replayed",
    f"""WITH {DIRTY_SQL}
SELECT 2 AS runs, CAST(1 AS BIGINT) AS fixes_replayed, CAST(count_if(payment_method = 'CRYPTO') AS BIGINT) AS routed_rows,
 CAST(count_if(payment_method <> 'CRYPTO') AS BIGINT) AS clean_rows, CAST(count(*) - count_if(payment_method = 'CRYPTO') AS BIGINT) AS total_rows,
 'clean' AS phase_reached FROM dirty""",
)
def run_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """The next run replays the accepted quarantine repair first and then finds the table clean."""
    root = scratch_path(spark, "run")
    registry = Registry(spark, f"{root}/registry")
    registry.seed([STOP_RULES[1]])
    run(spark, ORDERS, registry, root, df=dirty(spark, sf), options=ROUTE_OPTIONS)
    second = run(spark, ORDERS, registry, root, df=dirty(spark, sf), options=ROUTE_OPTIONS)
    clean = spark.read.parquet(f"{root}/clean/run_id={second.run_id}").count()
    return read_runs(spark, root).filter(F.col("run_id") == second.run_id).select(
        F.lit(read_runs(spark, root).count()).cast("int").alias("runs"), "fixes_replayed", "routed_rows",
        F.lit(clean).cast("bigint").alias("clean_rows"), "total_rows", "phase_reached",
    )
