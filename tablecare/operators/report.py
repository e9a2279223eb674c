"""What failed, on which values, and why it probably did."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecare.functions.masking import mask_structural, pii_columns
from tablecare.functions.typed import all_of, col
from tablecare.operators.keyflags import BadKeys
from tablecare.operators.profile import ColumnProfile, profile_columns, profiles_frame
from tablecare.operators.sizing import MAX_BROADCAST_BYTES, ROW_OVERHEAD_BYTES, durable, payload_bytes
from tablecare.operators.validate import (
    REASONS,
    Measure,
    Tables,
    attribute,
    bad_keys,
    judged_by_keys,
    measures_frame,
    measures_of,
    validate,
)
from tablecare.spec import DEFAULT_SAMPLE_ROWS, Rule, TableSpec, dedupe_rules

# Diagnosis categories.
CATEGORIES = {
    "not_null": "Upstream System Bug",
    "unique": "Upstream System Bug",
    "foreign_key": "Upstream System Bug",
    "in_set": "Categorical Drift",
    "not_in_set": "Categorical Drift",
    "between_time": "Temporal Anomaly",
    "between": "Sensor Anomaly",
    "zscore_below": "Sensor Anomaly",
    "matches": "Data Entry Error",
    "not_matches": "Data Entry Error",
    "matches_any": "Data Entry Error",
    "like": "Data Entry Error",
    "length_between": "Data Entry Error",
    "castable": "Schema Drift",
    "columns_exist": "Schema Drift",
    "columns_match_ordered": "Schema Drift",
    "columns_match_set": "Schema Drift",
}
OTHER_CATEGORY = "Data Entry Error"


# Groups a reason's rows are dealt into before the last ranking.
SAMPLE_SALTS = 64


def sample_failures(
    flagged: DataFrame,
    primary_key: Sequence[str],
    max_rows: int = DEFAULT_SAMPLE_ROWS,
    mask: bool = True,
    reasons: str = REASONS,
    columns: Sequence[str] | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """At most ``max_rows`` rows per reason, smallest keys first: ``reason``, ``rank``, row columns.

    Reason, key and a digest of the row are ranked in two rounds, first per reason and task group,
    so a rule broken by a third of the table fills no task at any ``max_rows``. Failing rows are
    written once, in place; wide ones only meet the winners, whose size is measured before they are
    broadcast. Equal rows count as often as they occur and are fetched once.
    """
    columns = list(columns or [c for c in flagged.columns if c != reasons])
    hinted = set(pii_columns(flagged.schema, columns)) if mask else set()
    keys = [f"__k{i}" for i in range(len(primary_key))]
    failing = flagged.filter(F.size(reasons) > 0).select(
        reasons,
        F.xxhash64(*[col(c) for c in columns]).alias("__tie"),
        *[col(k).alias(n) for k, n in zip(primary_key, keys, strict=True)],
        *[col(c) for c in columns],
    )
    failing = durable(failing, "failing")  # the rules are evaluated once; below, few columns are read
    narrow = failing.select(
        F.explode(reasons).alias("reason"), "__tie", *keys, F.pmod(F.spark_partition_id(), F.lit(SAMPLE_SALTS)).alias("__salt")
    )
    order = [*[F.col(n).asc_nulls_first() for n in keys], F.col("__tie")]
    place = F.row_number().over(Window.partitionBy("reason", "__salt").orderBy(*order))
    first = narrow.withColumn("__place", place).filter(F.col("__place") <= max_rows)
    rank = F.row_number().over(Window.partitionBy("reason").orderBy(*order))
    winners = first.withColumn("rank", rank).filter(F.col("rank") <= max_rows).select("reason", "rank", "__tie", *keys)
    winners = durable(winners, "samples")
    size = winners.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(payload_bytes(*keys)), F.lit(0)).alias("b")).first()
    wanted = winners.select(F.col("__tie").alias("__t"), *[F.col(n).alias(f"_{n}") for n in keys]).distinct()
    if size["n"] * ROW_OVERHEAD_BYTES + size["b"] <= max_broadcast_bytes:
        winners, wanted = F.broadcast(winners), F.broadcast(wanted)
    same = all_of([F.col("__tie") == F.col("__t"), *[F.col(n).eqNullSafe(F.col(f"_{n}")) for n in keys]])
    found = failing.join(wanted, same, "left_semi").groupBy("__tie", *keys)
    found = found.agg(F.first(F.struct(*[col(c) for c in columns])).alias("__row")).select(
        F.col("__tie").alias("__t"), *[F.col(n).alias(f"_{n}") for n in keys], "__row"
    )
    text = {c for c in hinted if flagged.schema[c].dataType.simpleString() == "string"}
    return found.join(winners, same).select(
        "reason",
        F.col("rank").cast("bigint").alias("rank"),
        *[(mask_structural(F.col("__row")[c]) if c in text else F.col("__row")[c]).alias(c) for c in columns],
    )


def category_column(rule="rule", dtype="dtype"):
    """Diagnosis category from the rule kind and the type of the failing column."""
    kind = F.col(rule)
    on_time = F.col(dtype).startswith("timestamp") | (F.col(dtype) == "date")
    chain = F.when((kind == "between") & on_time, CATEGORIES["between_time"])
    for name, label in CATEGORIES.items():
        if name != "between_time":
            chain = chain.when(kind == name, label)
    return chain.otherwise(OTHER_CATEGORY)


def diagnose(result: DataFrame, profiles: DataFrame) -> DataFrame:
    """One diagnosis per failed rule: category and a sentence built from the counts."""
    types = F.broadcast(profiles.select("column", "dtype"))
    failed = result.filter(~F.col("success")).join(types, "column", "left")
    return failed.select(
        "ord",
        "rule_id",
        "rule",
        "column",
        category_column().alias("failure_category"),
        F.format_string(
            "%d of %d rows break %s on column %s.", "unexpected_count", "evaluated_count", "rule", "column"
        ).alias("explanation"),
    )


def evidence(report: DataFrame, spec: TableSpec) -> DataFrame:
    """One JSON document per failed rule, for any consumer downstream."""
    return report.select(
        "rule_id",
        F.to_json(
            F.struct(
                F.lit(spec.name).alias("table"),
                F.lit(", ".join(spec.primary_key)).alias("primary_key"),
                F.struct("rule", "column", "params").alias("failed_rule"),
                "unexpected_count",
                "element_count",
                F.round("unexpected_percent", 4).alias("unexpected_percent"),
                F.col("profile").alias("column_profile"),
                F.col("samples").alias("sample_failed_rows"),
            )
        ).alias("evidence"),
    )


def failure_report(
    df: DataFrame,
    rules: Sequence[Rule],
    spec: TableSpec,
    measures: Sequence[Measure] | None = None,
    flagged: DataFrame | None = None,
    profiles: Sequence[ColumnProfile] | None = None,
    max_rows: int = DEFAULT_SAMPLE_ROWS,
    mask: bool = True,
    tables: Tables | None = None,
    kept: Mapping[str, BadKeys] | None = None,
) -> DataFrame:
    """One row per failed rule with its counts, column profile, masked samples and category.

    Whatever the caller has computed already is reused: ``measures``, ``profiles``, the bad keys
    ``kept`` with a snapshot, and ``flagged`` from ``attribute`` with the label ``rule_id``. Two
    rules of one kind on one column share their reason text, so samples are matched by rule id.
    """
    spark = df.sparkSession
    names = [f.name for f in spec.fields(df.schema)]
    if measures is None:
        rules = dedupe_rules(rules)
        kept = {**(kept or {}), **{r.rule_id: bad_keys(df, r, tables) for r in rules if judged_by_keys(r) and r.rule_id not in (kept or {})}}
        measures = measures_of(rules, validate(df, rules, tables, kept=kept).collect())
    result = measures_frame(spark, measures)
    if flagged is None:
        failed = [m.rule for m in measures if not m.success]
        flagged = attribute(df, rules, failed, tables, label="rule_id", kept=kept)
    if profiles is None:
        # a profile stands beside each failed rule on one column
        asked = {m.rule.column for m in measures if not m.success}
        profiles = profile_columns(df, [n for n in names if n in asked])

    profile_rows = profiles_frame(spark, profiles)
    described = profile_rows.select("column", "dtype", F.struct(*profile_rows.columns).alias("profile"))
    params = spark.createDataFrame(
        [(r.rule_id, r.params_json) for r in rules], "rule_id string, params string"
    )
    sampled = sample_failures(flagged, spec.primary_key, max_rows, mask, columns=names)
    samples = sampled.withColumnRenamed("reason", "rule_id").groupBy("rule_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*names).alias("row")))).alias("ranked")
    )
    # All sides hold one row per rule or column, plus at most ``max_rows`` samples each.
    return (
        result.filter(~F.col("success"))
        .join(F.broadcast(params), "rule_id")
        .join(F.broadcast(described), "column", "left")
        .join(samples, "rule_id", "left")
        .select(
            "ord",
            "rule_id",
            "rule",
            "column",
            "params",
            "element_count",
            "unexpected_count",
            "unexpected_percent",
            category_column().alias("failure_category"),
            "profile",
            F.transform("ranked", lambda s: s["row"]).alias("samples"),
        )
    )
