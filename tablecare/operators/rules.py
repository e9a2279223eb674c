"""Row rules as Boolean columns.

``row_check`` turns a row-level rule into the condition that flags a row and the condition
under which the row counts as evaluated. Both are plain built-in expressions, so any number
of rules shares one scan and stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.typed import all_of, any_of, col, field_of, is_numeric, is_time, listed_values, typed_literal, within
from tablecare.spec import Rule, RuleError


@dataclass(frozen=True)
class RowCheck:
    """``violation`` is never null. ``evaluated`` is null when every row is evaluated."""

    violation: Column
    evaluated: Column | None
    evaluated_key: str


def _need_string(rule: Rule, data_type: T.DataType) -> None:
    if not isinstance(data_type, T.StringType):
        raise RuleError(f"{rule.reason}: needs a string column, not {data_type.simpleString()}")


def _need_flat(rule: Rule, data_type: T.DataType) -> None:
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise RuleError(f"{rule.reason}: nested columns take only null rules")


def _between(rule: Rule, value: Column, data_type: T.DataType) -> Column:
    if not (is_numeric(data_type) or is_time(data_type)):
        raise RuleError(f"{rule.reason}: between takes numeric or time columns, not {data_type.simpleString()}")
    outside = []
    if "min" in rule.params:
        outside.append(value < typed_literal(rule.params["min"], data_type))
    if "max" in rule.params:
        outside.append(value > typed_literal(rule.params["max"], data_type))
    return any_of(outside)


def _single_column_violation(
    rule: Rule, value: Column, data_type: T.DataType, statistics: Mapping[str, tuple[float, float]]
) -> Column:
    params = rule.params
    _need_flat(rule, data_type)
    if rule.kind in ("in_set", "not_in_set"):
        values, value_type = listed_values(params["values"], data_type)
        member = value.isin([F.lit(str(v)).cast(value_type) for v in values])
        return ~member if rule.kind == "in_set" else member
    if rule.kind == "between":
        return _between(rule, value, data_type)
    if rule.kind == "castable":
        _need_string(rule, data_type)
        return value.try_cast(params["type"]).isNull()
    if rule.kind == "zscore_below":
        if rule.columns[0] not in statistics:
            raise RuleError(f"{rule.reason}: needs the mean and deviation of its column")
        mean, stddev = statistics[rule.columns[0]]
        # Without spread nothing can lie far from the mean.
        if not stddev:
            return F.lit(False)
        return F.abs(value - F.lit(mean)) / F.lit(stddev) >= F.lit(params["threshold"])
    _need_string(rule, data_type)
    if rule.kind == "matches":
        return ~value.rlike(params["regex"])
    if rule.kind == "not_matches":
        return value.rlike(params["regex"])
    if rule.kind == "matches_any":
        return ~any_of([value.rlike(regex) for regex in params["regexes"]])
    if rule.kind == "like":
        return ~value.like(params["pattern"])
    if rule.kind == "length_between":
        return ~within(F.length(value), params.get("min"), params.get("max"))
    raise RuleError(f"no row predicate for '{rule.kind}'")


def _pair_violation(rule: Rule, left: Column, right: Column, schema: T.StructType) -> Column:
    if rule.kind == "pair_greater":
        return ~((left >= right) if rule.params.get("or_equal") else (left > right))
    if rule.kind == "pair_equal":
        return left != right
    left_type, right_type = (field_of(schema, c).dataType for c in rule.columns)
    return ~any_of(
        [
            (left == typed_literal(a, left_type)) & (right == typed_literal(b, right_type))
            for a, b in rule.params["values"]
        ]
    )


def row_check(
    rule: Rule, schema: T.StructType, statistics: Mapping[str, tuple[float, float]] | None = None
) -> RowCheck:
    """``statistics`` comes from ``column_statistics`` and is needed by z-score rules only."""
    if rule.level != "row":
        raise RuleError(f"'{rule.kind}' is not a row rule")
    types = [field_of(schema, c).dataType for c in rule.columns]
    values = [col(c) for c in rule.columns]
    if rule.kind == "not_null":
        return RowCheck(values[0].isNull(), None, "*")
    if rule.kind == "is_null":
        return RowCheck(values[0].isNotNull(), None, "*")
    if rule.kind == "where":
        holds = F.expr(rule.params["predicate"])
        return RowCheck(F.coalesce(~holds, F.lit(False)), holds.isNotNull(), f"where:{rule.params['predicate']}")
    evaluated = all_of([v.isNotNull() for v in values])
    if rule.kind == "sum_equals":
        total = sum(values[1:], values[0])
        broken = total != F.lit(rule.params["total"])
    elif len(values) == 2:
        broken = _pair_violation(rule, *values, schema)
    else:
        broken = _single_column_violation(rule, values[0], types[0], statistics or {})
        # castable and the like look at text only where there is some.
        broken = evaluated & broken
    return RowCheck(F.coalesce(broken, F.lit(False)), evaluated, "nn:" + "\u0001".join(rule.columns))


def column_statistics(df: DataFrame, rules: Sequence[Rule]) -> dict[str, tuple[float, float]]:
    """Mean and standard deviation of every column under a z-score rule, from one aggregate.

    The two numbers per column enter the row pass as constants, so no join is needed to
    reach them. Runs no job when no rule asks for it.
    """
    columns = list(dict.fromkeys(r.columns[0] for r in rules if r.kind == "zscore_below"))
    if not columns:
        return {}
    stats = df.agg(
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev(col(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (float(stats[f"m{i}"] or 0.0), float(stats[f"s{i}"] or 0.0)) for i, c in enumerate(columns)}
