"""Files in, files out, and files as they arrive."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixture import DIRTY_SQL, ORDER_COLUMNS, ORDERS, dirty, query, table
from tablecare.operators.sizing import scratch_path
from tablecare.plans.registry import Registry
from tablecare.sources.scan import CORRUPT, latest_batch, scan, scan_rejects
from tablecare.sources.sinks import read_report, read_runs
from tablecare.spec import RunOptions, TableSpec, between, in_set, matches, not_null, schema_of, unique
from tablecare.streaming.arrivals import (
    file_digests,
    flag_repeats,
    new_content,
    row_digest,
    run_per_batch,
    stream_reasons,
    unique_within,
)
from tablecare.streaming.key_ledger import KeyLedger
from tablecare.streaming.watch import run_on_arrival

COLUMNS_SQL = ", ".join(ORDER_COLUMNS)


def landed(df: DataFrame, fmt: str) -> str:
    """Write a table where the executors can read it back; returns the path."""
    path = scratch_path(df.sparkSession, f"landing-{fmt}")
    writer = df.write.option("header", "true") if fmt == "csv" else df.write
    writer.format(fmt).save(path)
    return path


# -- scans ---------------------------------------------------------------------------------


@query("scan_declared", f"WITH {DIRTY_SQL} SELECT {COLUMNS_SQL} FROM dirty")
def scan_declared(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, ORDERS, landed(dirty(spark, sf).select(*ORDER_COLUMNS), "csv"))


@query("scan_inferred", f"WITH {DIRTY_SQL} SELECT {COLUMNS_SQL} FROM dirty")
def scan_inferred(spark: SparkSession, sf: str) -> DataFrame:
    undeclared = TableSpec("orders", ("order_id",))
    frame = scan(spark, undeclared, landed(dirty(spark, sf).select(*ORDER_COLUMNS), "csv"))
    if dict(frame.dtypes)["order_amount"] != "double":
        raise AssertionError("amounts are inferred as numbers")
    return frame.withColumn("order_timestamp", F.col("order_timestamp").cast("timestamp_ntz"))


FORMATS = ("csv", "parquet", "json", "orc")


@query(
    "scan_formats",
    f"WITH {DIRTY_SQL}\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{fmt}' AS fmt, CAST(count(*) AS BIGINT) AS row_count, CAST(count(customer_id) AS BIGINT) AS customers,
 min(order_amount) AS low, max(order_amount) AS high, max(order_timestamp) AS latest FROM dirty"""
        for fmt in FORMATS
    ),
)
def scan_formats(spark: SparkSession, sf: str) -> DataFrame:
    rows = dirty(spark, sf).select(*ORDER_COLUMNS)
    parts = None
    for fmt in FORMATS:
        spec = dataclasses.replace(ORDERS, fmt=fmt, options={"header": "true"} if fmt == "csv" else {})
        part = scan(spark, spec, landed(rows, fmt)).agg(
            F.lit(fmt).alias("fmt"),
            F.count(F.lit(1)).alias("row_count"),
            F.count("customer_id").alias("customers"),
            F.min("order_amount").alias("low"),
            F.max("order_amount").alias("high"),
            F.max("order_timestamp").alias("latest"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


LINES = TableSpec(
    "lines", ("k",), schema_of([("k", "long"), ("amount", "double"), ("at", "timestamp_ntz")]), options={}
)
# One line per order; some carry text for a number, some a broken time, some a field too many.
LINE_TEXT = """concat(CAST(o_orderkey AS {text}), ',',
 CASE WHEN o_orderkey % 97 = 5 THEN 'n/a' ELSE CAST(o_orderkey AS {text}) END, ',',
 CASE WHEN o_orderkey % 89 = 7 THEN 'yesterday' ELSE '2024-01-01T00:00:00' END,
 CASE WHEN o_orderkey % 83 = 9 THEN ',more' ELSE '' END)"""


@query(
    "scan_rejects",
    f"""SELECT {LINE_TEXT.format(text="VARCHAR")} AS line FROM orders
 WHERE o_orderkey % 97 = 5 OR o_orderkey % 89 = 7 OR o_orderkey % 83 = 9""",
)
def rejected_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "orders").selectExpr(f"{LINE_TEXT.format(text='STRING')} AS value")
    path = scratch_path(spark, "landing-text")
    lines.write.text(path)
    return scan_rejects(spark, LINES, path).select(F.col(CORRUPT).alias("line"))


@query(
    "scan_malformed_as_null",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS amount,
 CASE WHEN o_orderkey % 89 = 7 THEN NULL ELSE TIMESTAMP '2024-01-01' END AS "at" FROM orders""",
)
def scan_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """What does not parse is null after the scan, for the null rules to find."""
    lines = table(spark, sf, "orders").selectExpr(f"{LINE_TEXT.format(text='STRING')} AS value")
    path = scratch_path(spark, "landing-text")
    lines.write.text(path)
    return scan(spark, LINES, path)


@query(
    "latest_batch",
    f"WITH {DIRTY_SQL} SELECT {COLUMNS_SQL} FROM dirty WHERE k % 3 = 2",
)
def newest_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of several part files land one after the other; all of the newest is read."""
    folder = scratch_path(spark, "landing-batches")
    rows = dirty(spark, sf)
    for i in range(3):
        batch = rows.filter(F.col("k") % 3 == i).select(*ORDER_COLUMNS)
        batch.repartition(4, "order_id").write.option("header", "true").csv(f"{folder}/batch-{i}")
    return scan(spark, ORDERS, latest_batch(spark, ORDERS, folder))


# -- arrivals ------------------------------------------------------------------------------

EVENT_RULES = [
    between("value", 1, 50),
    in_set("event_type", ["view", "click", "purchase", "signup"]),
    matches("props", r'"k": [0-8]'),
]


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drained(stream: DataFrame) -> DataFrame:
    """Work through what is there, write every batch once, and read them as a table."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")

    def keep(batch: DataFrame, batch_id: int) -> None:
        # a batch that is tried again replaces itself
        batch.write.mode("overwrite").parquet(f"{out}/rows/{batch_id}")

    run_per_batch(stream, keep, f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


@query(
    "stream_reasons",
    """SELECT event_id, concat_ws('; ', CASE WHEN value < 1 OR value > 50 THEN 'between on ''value''' END,
 CASE WHEN event_type NOT IN ('view','click','purchase','signup') THEN 'in_set on ''event_type''' END,
 CASE WHEN NOT regexp_matches(props, '"k": [0-8]') THEN 'matches on ''props''' END) AS reasons FROM events""",
)
def streamed_reasons(spark: SparkSession, sf: str) -> DataFrame:
    flagged = stream_reasons(event_stream(spark, sf), EVENT_RULES)
    return drained(flagged.select("event_id", F.concat_ws("; ", "dq_reasons").alias("reasons")))


@query("stream_unique", "SELECT DISTINCT user_id FROM events")
def streamed_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Within one watermark delay that spans the data, every user comes through once."""
    return drained(unique_within(event_stream(spark, sf), ["user_id"], "ts", "60 days").select("user_id"))


@query(
    "ledger_repeats",
    """SELECT event_id, user_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 20)
 AS repeated FROM events WHERE event_type <> 'signup'""",
)
def ledger_repeats(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    batch = events.filter("event_type <> 'signup'").select("event_id", "user_id")
    return flag_repeats(batch, ["user_id"], events.filter("event_type = 'signup' AND value > 20"))


@query(
    "content_dedupe",
    """WITH items AS (SELECT source, doc_id, sha256(text) AS digest FROM documents)
 SELECT source, digest, min(doc_id) AS doc_id FROM items GROUP BY ALL
 HAVING (source, digest) NOT IN (SELECT (source, sha256(text)) FROM documents WHERE lang = 'de')""",
)
def content_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """First document per source and content, without contents already taken in (here: German)."""
    items = table(spark, sf, "documents").select("source", "doc_id", "lang", F.sha2("text", 256).alias("digest"))
    return new_content(items, items.filter("lang = 'de'"), ["source"], "digest", "doc_id")


@query(
    "content_digest",
    "SELECT TRUE AS same_rows, TRUE AS order_free, CAST(count(*) AS BIGINT) AS row_count FROM documents",
)
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    """A table too large to hash as one value: equal rows in another order give the same digest."""
    documents = table(spark, sf, "documents")
    moved = documents.repartition(7, "lang", "doc_id")
    halves = documents.filter("doc_id % 2 = 1").unionByName(documents.filter("doc_id % 2 = 0"))
    digests = [row_digest(f).first()["digest"] for f in (documents, moved, halves)]
    return documents.agg(
        F.lit(digests[0] == digests[1]).alias("same_rows"),
        F.lit(digests[0] == digests[2]).alias("order_free"),
        F.count(F.lit(1)).alias("row_count"),
    )


# Files of the same orders: as they are, again, the other way round, and with a mark that no parser sees.
FILE_KINDS = ("as_is", "again", "reversed", "marked")


@query(
    "file_identity",
    """WITH l AS (SELECT o_orderkey AS k, o_custkey % 3 AS slot, o_orderkey || ',' || o_custkey AS line FROM orders),
f AS (SELECT slot, 'as_is' AS kind, string_agg(line, chr(10) ORDER BY k) AS body FROM l GROUP BY slot
 UNION ALL SELECT slot, 'again', string_agg(line, chr(10) ORDER BY k) FROM l GROUP BY slot
 UNION ALL SELECT slot, 'reversed', string_agg(line, chr(10) ORDER BY k DESC) FROM l GROUP BY slot
 UNION ALL SELECT slot, 'marked', string_agg(CASE WHEN k % 100 = 1 THEN line || ' ' ELSE line END, chr(10) ORDER BY k) FROM l GROUP BY slot)
SELECT CAST(slot AS VARCHAR) AS slot, kind, min(kind) OVER (PARTITION BY sha256(body)) AS same_as FROM f""",
)
def file_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Which of a table's files hold the same bytes, read in many pieces each."""
    folder = scratch_path(spark, "landing-files")
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey % 3 AS slot", "concat(o_orderkey, ',', o_custkey) AS line")
    for kind in FILE_KINDS:
        order = F.desc("k") if kind == "reversed" else F.asc("k")
        line = F.when(F.col("k") % 100 == 1, F.concat("line", F.lit(" "))).otherwise(F.col("line")) if kind == "marked" else F.col("line")
        rows = orders.select("slot", "k", line.alias("value")).repartition("slot").sortWithinPartitions("slot", order)
        rows.drop("k").write.partitionBy("slot").text(f"{folder}/{kind}")
    place = F.regexp_extract("path", r"/(\w+)/slot=(\d+)/", 1), F.regexp_extract("path", r"/(\w+)/slot=(\d+)/", 2)
    digests = file_digests(spark, [f"{folder}/{kind}" for kind in FILE_KINDS], "txt")
    named = digests.select(place[0].alias("kind"), place[1].alias("slot"), "digest")
    first = named.groupBy("digest").agg(F.min("kind").alias("same_as"))
    return named.join(first, "digest").select("slot", "kind", "same_as")


LEDGER_FIRST, LEDGER_SECOND = "event_type = 'signup'", "event_type <> 'signup'"


@query(
    "key_ledger",
    f"""WITH a AS (SELECT DISTINCT user_id FROM events WHERE {LEDGER_FIRST}),
n AS (SELECT CAST(count(*) AS BIGINT) AS first_keys FROM a),
m AS (SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS second_keys FROM events
 WHERE {LEDGER_SECOND} AND user_id NOT IN (SELECT user_id FROM a))
SELECT event_id, user_id, user_id IN (SELECT user_id FROM a) AS repeated, first_keys, second_keys,
 CAST(0 AS BIGINT) AS again_keys, first_keys + second_keys AS ledger_keys
FROM events, n, m WHERE {LEDGER_SECOND}""",
)
def key_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of events: the second is flagged before and after it is committed, with equal results."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    keys = events.select("user_id").schema
    ledger = KeyLedger(spark, scratch_path(spark, "ledger"), "users", keys, buckets=32)
    first, second = events.filter(LEDGER_FIRST), events.filter(LEDGER_SECOND)
    counts = {"first_keys": ledger.commit(first, "batch-1"), "second_keys": ledger.commit(second, "batch-2")}
    counts["again_keys"] = ledger.commit(events, "batch-2")
    flagged = ledger.flag(second.drop("event_type"), "batch-2")
    counts["ledger_keys"] = ledger.frame().count()
    return flagged.withColumns({name: F.lit(n).cast("bigint") for name, n in counts.items()})


ARRIVAL_RULES = [not_null("customer_id"), in_set("payment_method", ["CARD", "TRANSFER", "VOUCHER", "WALLET"]), unique("order_id")]
ARRIVAL_SLOTS = 10
ARRIVAL_ROWS = 250_000  # rows of a landing file, about


def land(rows: DataFrame, folder: str, files: int) -> None:
    """Rows as CSV files, dealt by key and in order, so that equal rows give files of equal bytes."""
    dealt = rows.repartition(files, "k").sortWithinPartitions("k", *ORDER_COLUMNS)
    dealt.select(*ORDER_COLUMNS).write.option("header", "true").csv(folder)


@query(
    "run_on_arrival",
    f"""WITH {DIRTY_SQL},
first AS (SELECT *, count(*) OVER (PARTITION BY order_id) AS n FROM dirty WHERE k % 4 <> 0),
second AS (SELECT *, count(*) OVER (PARTITION BY order_id) AS n FROM dirty WHERE k % 4 = 0 OR k % 50 = 1),
rows AS (
 SELECT 1 AS run, CAST(k % {ARRIVAL_SLOTS} AS VARCHAR) AS slot, customer_id IS NULL OR payment_method = 'CRYPTO'
  OR (order_id IS NOT NULL AND n > 1) AS bad FROM first
 UNION ALL SELECT 2, 'late', customer_id IS NULL OR payment_method = 'CRYPTO' OR (order_id IS NOT NULL AND n > 1)
  OR coalesce(order_id IN (SELECT order_id FROM first WHERE order_id IS NOT NULL), FALSE) FROM second)
SELECT run, slot, CAST(count(*) AS BIGINT) AS row_count, CAST(count_if(bad) AS BIGINT) AS quarantined_rows,
 CAST(sum(count(*)) OVER (PARTITION BY run) AS BIGINT) AS total_rows, CAST(1 AS BIGINT) AS runs
FROM rows GROUP BY run, slot""",
)
def arrivals_run(spark: SparkSession, sf: str) -> DataFrame:
    """Ten folders of files land and go through one run; later a folder with new and with known keys, and a copy."""
    root = scratch_path(spark, "arrival")
    folder, registry = f"{root}/landing", Registry(spark, f"{root}/registry")
    registry.seed(ARRIVAL_RULES)
    ledger = KeyLedger.of(spark, root, ORDERS, buckets=16)
    options = RunOptions(repair_not_drop=True, loop_until_clean=False)
    rows, runs = dirty(spark, sf), []
    # the copy of a folder needs as many files as the folder
    files = 1 + table(spark, sf, "orders").count() // (ARRIVAL_SLOTS * ARRIVAL_ROWS)
    for late in (False, True):
        if late:
            land(rows.filter("k % 4 = 0 OR k % 50 = 1"), f"{folder}/late", 4 * files)
            land(rows.filter(f"k % 4 <> 0 AND k % {ARRIVAL_SLOTS} = 3"), f"{folder}/copy-of-3", files)
        else:
            for slot in range(ARRIVAL_SLOTS):
                land(rows.filter(f"k % 4 <> 0 AND k % {ARRIVAL_SLOTS} = {slot}"), f"{folder}/{slot}", files)
        run_on_arrival(spark, ORDERS, registry, root, folder, key_ledger=ledger, options=options).awaitTermination()
        recorded = read_runs(spark, root).select("run_id", "total_rows").collect()
        runs += [(len(runs) + 1, r["run_id"], r["total_rows"]) for r in recorded if r["run_id"] not in {x[1] for x in runs}]
    known = spark.createDataFrame(runs, "run int, run_id string, total_rows bigint")
    sources = read_report(spark, root, "sources").withColumn("slot", F.regexp_extract("source_file", r"/landing/([^/]+)/", 1))
    counts = [F.sum(c).alias(c) for c in ("row_count", "quarantined_rows")]
    return sources.join(F.broadcast(known), "run_id").groupBy("run", "slot", "total_rows").agg(*counts).select(
        "run", "slot", "row_count", "quarantined_rows", "total_rows", F.lit(len(runs) // 2).cast("bigint").alias("runs")
    )
