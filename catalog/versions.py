"""The registry's derived views, on version, event and log tables of any size.

The tables are read off the given ones: every line item is an item of the version named by its
line number, every event a step in the life of the candidate named by its user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixture import query, table
from tablecare.operators.sizing import scratch_path
from tablecare.plans.registry import (
    Registry,
    active,
    as_of,
    candidate_states,
    candidates_by_failure,
    latest_status,
    log_summary,
    rollback_rows,
    suite_diff,
    undecided,
    version_clashes,
    version_sizes,
)
from tablecare.spec import Rule

VERSIONS_SQL = """versions AS (SELECT CAST(l_linenumber AS BIGINT) AS version, CAST(l_suppkey % 5 - 1 AS INTEGER) AS ord,
 'r' || CAST(l_partkey AS VARCHAR) AS item_id, l_returnflag AS kind, l_linestatus AS "column",
 CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS params, l_shipdate AS recorded_at FROM lineitem)"""
ITEM = 'item_id, kind, "column", params'


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "CAST(l_linenumber AS BIGINT) AS version",
        "CAST(l_suppkey % 5 - 1 AS INT) AS ord",
        "concat('r', l_partkey) AS item_id",
        "l_returnflag AS kind",
        "l_linestatus AS `column`",
        "CAST(CAST(l_quantity AS INT) AS STRING) AS params",
        "l_shipdate AS recorded_at",
    )


@query(
    "registry_active",
    f"WITH {VERSIONS_SQL} SELECT * FROM versions WHERE ord > -1 AND version = (SELECT max(version) FROM versions)",
)
def registry_active(spark: SparkSession, sf: str) -> DataFrame:
    return active(versions(spark, sf))


@query(
    "registry_as_of",
    f"""WITH {VERSIONS_SQL}, early AS (SELECT * FROM versions WHERE version <= 4 AND recorded_at <= TIMESTAMP '1998-06-01')
 SELECT * FROM early WHERE ord > -1 AND version = (SELECT max(version) FROM early)""",
)
def registry_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return as_of(versions(spark, sf), version=4, at="1998-06-01")


@query(
    "registry_rollback",
    f"""WITH {VERSIONS_SQL} SELECT * REPLACE (CAST((SELECT max(version) FROM versions) + 1 AS BIGINT) AS version)
 FROM versions WHERE version = 2""",
)
def registry_rollback(spark: SparkSession, sf: str) -> DataFrame:
    return rollback_rows(versions(spark, sf), 2)


@query(
    "suite_diff",
    f"""WITH {VERSIONS_SQL}, a AS (SELECT DISTINCT {ITEM} FROM versions WHERE version = 2 AND ord > -1),
 b AS (SELECT DISTINCT {ITEM} FROM versions WHERE version = 3 AND ord > -1)
 SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
 UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def suites_compared(spark: SparkSession, sf: str) -> DataFrame:
    return suite_diff(versions(spark, sf), 2, 3)


EVENTS_SQL = """cand AS (SELECT user_id AS candidate_id, event_id AS seq, ts AS "at",
 CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'auto_promoted'
  ELSE 'pending' END AS status, CASE WHEN user_id % 2 = 0 THEN 'rule' ELSE 'fix' END AS artifact FROM events)"""


def candidate_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "user_id AS candidate_id",
        "event_id AS seq",
        "ts AS at",
        "CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected'"
        " WHEN 'signup' THEN 'auto_promoted' ELSE 'pending' END AS status",
        "CASE WHEN user_id % 2 = 0 THEN 'rule' ELSE 'fix' END AS artifact",
    )


LATEST_SQL = """latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
 ORDER BY "at" DESC, seq DESC) AS rn FROM cand) WHERE rn = 1)"""


@query("candidate_status", f"WITH {EVENTS_SQL}, {LATEST_SQL} SELECT * FROM latest")
def candidate_status(spark: SparkSession, sf: str) -> DataFrame:
    return latest_status(candidate_events(spark, sf))


@query("candidates_pending", f"WITH {EVENTS_SQL}, {LATEST_SQL} SELECT * FROM latest WHERE status = 'pending'")
def candidates_pending(spark: SparkSession, sf: str) -> DataFrame:
    return latest_status(candidate_events(spark, sf), "pending")


@query(
    "candidates_undecided",
    """SELECT c_custkey AS candidate_id, c_name AS note FROM customer
 WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def candidates_undecided(spark: SparkSession, sf: str) -> DataFrame:
    candidates = table(spark, sf, "customer").selectExpr("c_custkey AS candidate_id", "c_name AS note")
    log = table(spark, sf, "orders").filter("o_orderstatus = 'F'").selectExpr("o_custkey AS candidate_id")
    return undecided(candidates, log)


@query(
    "promotion_log",
    f"""WITH {EVENTS_SQL} SELECT artifact, status AS action, CAST(count(*) AS BIGINT) AS decisions,
 CAST(count(DISTINCT candidate_id) AS BIGINT) AS candidates, min("at") AS first_at, max("at") AS last_at
 FROM cand WHERE status <> 'pending' GROUP BY ALL""",
)
def promotion_log(spark: SparkSession, sf: str) -> DataFrame:
    decisions = candidate_events(spark, sf).filter("status <> 'pending'").withColumnRenamed("status", "action")
    return log_summary(decisions)


@query(
    "candidates_by_failure",
    """WITH c AS (SELECT l_orderkey AS run_id, l_linenumber AS source_rule_id, l_partkey AS candidate_id FROM lineitem),
 d AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS source_rule_id, l_returnflag AS failure_category
  FROM lineitem WHERE l_linestatus = 'F')
 SELECT * FROM c JOIN d USING (run_id, source_rule_id)""",
)
def candidates_with_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    candidates = items.selectExpr(
        "l_orderkey AS run_id", "l_linenumber AS source_rule_id", "l_partkey AS candidate_id"
    )
    diagnoses = (
        items.filter("l_linestatus = 'F'")
        .selectExpr("l_orderkey AS run_id", "l_linenumber AS rule_id", "l_returnflag AS failure_category")
        .distinct()
    )
    return candidates_by_failure(candidates, diagnoses)


@query(
    "version_clashes",
    f"""WITH {VERSIONS_SQL}, heads AS (SELECT version, recorded_at, kind AS actor FROM versions WHERE ord = -1),
c AS (SELECT version, CAST(count(*) AS BIGINT) AS writers FROM heads GROUP BY version HAVING count(*) > 1)
SELECT version, writers, recorded_at, actor FROM c JOIN heads USING (version)
QUALIFY row_number() OVER (PARTITION BY version ORDER BY recorded_at, actor) = 1""",
)
def clashes(spark: SparkSession, sf: str) -> DataFrame:
    return version_clashes(versions(spark, sf).withColumn("actor", F.col("kind")))


# Markets that a suite knows from the start, and statuses that candidates propose, over the given tables.
@query(
    "registry_life_cycle",
    """WITH seeds AS (SELECT count(DISTINCT c_mktsegment) AS n FROM customer),
c AS (SELECT o_orderpriority AS name, row_number() OVER (ORDER BY o_orderpriority) AS i FROM (SELECT DISTINCT o_orderpriority FROM orders)),
a AS (SELECT count_if(i <= 2) AS promoted, count_if(i = 3) AS rejected, count_if(i > 3) AS pending FROM c),
v AS (SELECT 1 AS version, n FROM seeds UNION ALL SELECT 1 + g, n + g FROM seeds, a, range(1, CAST(promoted + 1 AS BIGINT)) t(g)
 UNION ALL SELECT 2 + promoted, n FROM seeds, a)
SELECT 'version' AS record, CAST(version AS VARCHAR) AS name, CAST(n AS BIGINT) AS rows FROM v
UNION ALL SELECT 'in force', 'rule', n FROM seeds
UNION ALL SELECT 'status', 'approved', promoted FROM a WHERE promoted > 0
UNION ALL SELECT 'status', 'rejected', rejected FROM a WHERE rejected > 0
UNION ALL SELECT 'status', 'pending', pending FROM a WHERE pending > 0
UNION ALL SELECT 'log', 'approved', promoted FROM a WHERE promoted > 0
UNION ALL SELECT 'log', 'rejected', rejected FROM a WHERE rejected > 0
UNION ALL SELECT 'log', 'rolled_back', 1""",
)
def registry_life_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Seed, add candidates, promote two one after the other (one twice), reject one, roll back; then read it all."""
    markets = [r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    priorities = [r[0] for r in table(spark, sf, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]
    registry = Registry(spark, scratch_path(spark, "registry"))
    registry.seed([Rule("not_in_set", ("c_mktsegment",), {"values": [m]}) for m in markets])
    proposed = [(Rule("not_in_set", ("o_orderpriority",), {"values": [p]}), "source", True, "") for p in priorities]
    ids = registry.add_candidates("run-1", 1, proposed)
    for candidate in ids[:2]:
        registry.promote(candidate, "user:ann")
    registry.promote(ids[:1], "user:ann")  # a second time changes nothing
    for candidate in ids[2:3]:
        registry.reject(candidate, "user:ben", "too narrow")
    registry.rollback("rule", 1, "user:ann")
    sizes = version_sizes(registry.versions("rule")).select(F.lit("version").alias("record"), F.col("version").cast("string").alias("name"), F.col("items").alias("rows"))
    force = active(registry.versions("rule")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("in force").alias("record"), F.lit("rule").alias("name"), "rows")
    states = candidate_states(registry.events()).select(F.lit("status").alias("record"), F.col("status").alias("name"), F.col("candidates").alias("rows"))
    log = log_summary(registry.log()).select(F.lit("log").alias("record"), F.col("action").alias("name"), F.col("decisions").alias("rows"))
    return sizes.unionByName(force).unionByName(states).unionByName(log)
