"""Derive a rule suite from a trusted table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.typed import col, is_numeric, is_time
from tablecare.operators.profile import iso, number
from tablecare.operators.validate import Measure
from tablecare.spec import (
    EMAIL_REGEX,
    MAX_CATEGORICAL_VALUES,
    TIMESTAMP_BUFFER_DAYS,
    Rule,
    TableSpec,
    between,
    in_set,
    length_between,
    matches,
    not_null,
    unique,
)

# A distinct estimate above this cannot belong to a column with few values: the estimate is
# within a few percent, and near exact for small counts.
SURELY_MANY = 50 * MAX_CATEGORICAL_VALUES

SUITE_SCHEMA = T.StructType(
    [
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("rule_id", T.StringType(), False),
        T.StructField("rule", T.StringType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("params", T.StringType(), False),
    ]
)


def calibrate(df: DataFrame, spec: TableSpec) -> list[Rule]:
    """Key rules first, then per column a null rule where critical and a value rule by type.

    All bounds and cardinality estimates come from one aggregate over one scan; the values of
    columns that may be categorical from a second, whose groups are few by that estimate.
    """
    fields = [f for f in spec.fields(df.schema) if f.name not in spec.primary_key]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType) and "email" not in f.name.lower()]
    ranged = [f for f in fields if is_numeric(f.dataType) or is_time(f.dataType)]

    measures = [F.approx_count_distinct(col(name)).alias(f"d:{name}") for name in text]
    for field in ranged:
        value = col(field.name)
        if is_time(field.dataType):
            buffer = F.expr(f"INTERVAL '{TIMESTAMP_BUFFER_DAYS}' DAY")
            measures += [
                iso(F.min(value) - buffer).alias(f"lo:{field.name}"),
                iso(F.max(value) + buffer).alias(f"hi:{field.name}"),
            ]
        else:
            clean = number(value, field.dataType)
            measures += [F.min(clean).alias(f"lo:{field.name}"), F.max(clean).alias(f"hi:{field.name}")]
    stats = df.agg(*measures).first().asDict() if measures else {}
    values = categorical_values(df, [name for name in text if stats[f"d:{name}"] <= SURELY_MANY])

    rules = [not_null(key) for key in spec.primary_key] + [unique(*spec.primary_key)]
    for field in fields:
        if field.name in spec.critical_columns:
            rules.append(not_null(field.name))
        if field in ranged:
            low, high = stats[f"lo:{field.name}"], stats[f"hi:{field.name}"]
            if low is not None:
                rules.append(between(field.name, low, high))
        elif isinstance(field.dataType, T.StringType) and "email" in field.name.lower():
            rules.append(matches(field.name, EMAIL_REGEX))
        elif field.name in values:
            rules.append(in_set(field.name, values[field.name]))
    return rules


def categorical_values(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted values of the columns that hold at least one and at most the categorical limit.

    Columns are laid under each other and de-duplicated before the shuffle, so a value that fills
    a third of the table is one row per task.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns])
    few = (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .distinct()
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("value")).alias("values"))
        .filter(F.col("n") <= MAX_CATEGORICAL_VALUES)
    )
    return {r["column"]: list(r["values"]) for r in few.collect()}


def related_rules(df: DataFrame, spec: TableSpec) -> Callable[[Measure], Rule | None]:
    """Propose, for a failed rule, another rule that the trusted table supports on the same column.

    Text gets the bounds of its length, any other column without nulls a null rule. One aggregate
    over the trusted table serves every later proposal; the gate on new rules still applies.
    """
    fields = spec.fields(df.schema)
    measures = [F.count_if(col(f.name).isNull()).alias(f"null:{f.name}") for f in fields]
    for field in fields:
        if isinstance(field.dataType, T.StringType):
            length = F.length(col(field.name))
            measures += [F.min(length).alias(f"lo:{field.name}"), F.max(length).alias(f"hi:{field.name}")]
    stats = df.agg(*measures).first().asDict()

    def propose(failure: Measure) -> Rule | None:
        if len(failure.rule.columns) != 1:
            return None
        name = failure.rule.columns[0]
        options = []
        if stats.get(f"lo:{name}") is not None:
            options.append(length_between(name, stats[f"lo:{name}"], stats[f"hi:{name}"]))
        if stats.get(f"null:{name}") == 0:
            options.append(not_null(name))
        return next((rule for rule in options if rule != failure.rule), None)

    return propose


def suite_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A suite in its stored form, one row per rule."""
    rows = [(i, r.rule_id, r.kind, r.column, r.params_json) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, SUITE_SCHEMA)


def suite_from_frame(frame: DataFrame) -> list[Rule]:
    """Rules of a stored suite, in order."""
    return [Rule.load(r["rule"], r["column"], r["params"]) for r in frame.orderBy("ord").collect()]


def calibrated_bounds(suite: DataFrame) -> DataFrame:
    """A stored suite with its parameters spread over typed columns."""
    low, high = F.get_json_object("params", "$.min"), F.get_json_object("params", "$.max")
    values = F.from_json(F.get_json_object("params", "$.values"), "array<string>")
    return suite.select(
        "ord",
        "rule",
        "column",
        low.try_cast("double").alias("min_num"),
        high.try_cast("double").alias("max_num"),
        low.try_cast("timestamp_ntz").alias("min_ts"),
        high.try_cast("timestamp_ntz").alias("max_ts"),
        F.array_join(F.array_sort(values), ",").alias("values"),
        F.get_json_object("params", "$.regex").alias("regex"),
    )
