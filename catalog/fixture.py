"""Order tables derived from the given ones: a clean baseline and an incoming table with faults.

Faults are injected by arithmetic on the order key, so their number is known at any scale and
the same statement gives the same rows in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.spec import TableSpec, schema_of

ORDER_COLUMNS = [
    "order_id",
    "customer_id",
    "order_amount",
    "customer_email",
    "payment_method",
    "country_code",
    "order_timestamp",
]

ORDERS = TableSpec(
    name="orders",
    primary_key=("order_id",),
    schema=schema_of(
        [
            ("order_id", "string", False),
            ("customer_id", "string"),
            ("order_amount", "double"),
            ("customer_email", "string"),
            ("payment_method", "string"),
            ("country_code", "string"),
            ("order_timestamp", "timestamp_ntz"),
        ]
    ),
    critical_columns=("customer_id", "order_amount", "customer_email", "payment_method", "order_timestamp"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean baseline, with the row origin ``k``."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('ORD-', lpad(CAST(o_orderkey AS STRING), CAST(greatest(6, length(CAST(o_orderkey AS STRING))) AS INT), '0')) AS order_id",
        "concat('C', lpad(CAST(o_custkey AS STRING), CAST(greatest(6, length(CAST(o_custkey AS STRING))) AS INT), '0')) AS customer_id",
        "o_totalprice AS order_amount",
        "concat('user', CAST(o_custkey AS STRING), '@example.com') AS customer_email",
        "CASE o_custkey % 4 WHEN 0 THEN 'CARD' WHEN 1 THEN 'WALLET' WHEN 2 THEN 'TRANSFER' ELSE 'VOUCHER' END"
        " AS payment_method",
        "CASE o_custkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'UK' ELSE 'US' END"
        " AS country_code",
        "o_orderdate AS order_timestamp",
        "o_orderkey AS k",
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incoming table: faults on copy 0, clean duplicates as copy 1, from one scan."""
    copies = F.when(F.col("k") % 700 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = base(spark, sf_dir).withColumn("copy", F.explode(copies))

    def fault(condition: str, value: str, otherwise: str) -> str:
        return f"CASE WHEN copy = 0 AND {condition} THEN {value} ELSE {otherwise} END"

    amount = fault("k % 500 = 9", "NULL", "order_amount")
    amount = fault("k % 500 = 8", "-1.0D", amount)
    amount = fault("k % 500 = 7", "order_amount * 100 + 1000000", amount)
    return rows.selectExpr(
        f"{fault('k % 1000 = 17', 'NULL', 'order_id')} AS order_id",
        f"{fault('k % 10 = 0', 'NULL', 'customer_id')} AS customer_id",
        f"{amount} AS order_amount",
        f"""{fault("k % 400 = 3", "replace(customer_email, '@', '_at_')", "customer_email")} AS customer_email""",
        f"""{fault("k % 500 = 11", "'CRYPTO'", "payment_method")} AS payment_method""",
        "country_code",
        f"{fault('k % 300 = 13', 'order_timestamp + INTERVAL 100 YEAR', 'order_timestamp')} AS order_timestamp",
        "k",
    )


# The same two tables in SQL, as the head of every statement about them.
BASE_SQL = """base AS (
 SELECT concat('ORD-', lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0')) AS order_id,
  concat('C', lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(6, length(CAST(o_custkey AS VARCHAR))) AS INT), '0')) AS customer_id,
  o_totalprice AS order_amount,
  concat('user', CAST(o_custkey AS VARCHAR), '@example.com') AS customer_email,
  CASE o_custkey % 4 WHEN 0 THEN 'CARD' WHEN 1 THEN 'WALLET' WHEN 2 THEN 'TRANSFER' ELSE 'VOUCHER' END AS payment_method,
  CASE o_custkey % 5 WHEN 0 THEN 'CA' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' WHEN 3 THEN 'UK' ELSE 'US' END AS country_code,
  o_orderdate AS order_timestamp, o_orderkey AS k FROM orders)"""
DIRTY_SQL = (
    BASE_SQL
    + """,
dirty AS (
 SELECT CASE WHEN k % 1000 = 17 THEN NULL ELSE order_id END AS order_id,
  CASE WHEN k % 10 = 0 THEN NULL ELSE customer_id END AS customer_id,
  CASE WHEN k % 500 = 7 THEN order_amount * 100 + 1000000 WHEN k % 500 = 8 THEN -1.0
       WHEN k % 500 = 9 THEN NULL ELSE order_amount END AS order_amount,
  CASE WHEN k % 400 = 3 THEN replace(customer_email,'@','_at_') ELSE customer_email END AS customer_email,
  CASE WHEN k % 500 = 11 THEN 'CRYPTO' ELSE payment_method END AS payment_method, country_code,
  CASE WHEN k % 300 = 13 THEN order_timestamp + INTERVAL 100 YEAR ELSE order_timestamp END AS order_timestamp, k
 FROM base
 UNION ALL
 SELECT order_id, customer_id, order_amount, customer_email, payment_method, country_code, order_timestamp, k
 FROM base WHERE k % 700 = 1),
bounds AS (
 SELECT min(order_amount) AS lo, max(order_amount) AS hi,
  min(order_timestamp) - INTERVAL 3 DAY AS t_lo, max(order_timestamp) + INTERVAL 3 DAY AS t_hi FROM base)"""
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where its result can be stated in SQL, that SQL."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
