"""Repairs as DataFrame transforms, chosen per failure and chained in order."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.typed import any_of, col, field_of, is_numeric, is_time, replacement, typed_literal
from tablecare.operators.keyflags import broadcastable, duplicate_keys, flag_by_keys, kept_keys, keys_present
from tablecare.operators.profile import ColumnProfile
from tablecare.operators.rules import row_check
from tablecare.operators.sizing import MAX_BROADCAST_BYTES
from tablecare.operators.validate import Measure, needs_reference
from tablecare.spec import Fix, FixError, Rule, RuleError, rule_param

logger = logging.getLogger(__name__)

Transform = Callable[[DataFrame], DataFrame]
Transforms = Mapping[str, Transform]


def fix_predicate(df: DataFrame, fix: Fix) -> Column:
    """The rows a fix acts on: its SQL predicate, or the violation of the rule it carries."""
    if "predicate" in fix.params:
        return F.coalesce(F.expr(fix.params["predicate"]), F.lit(False))
    stored = fix.params["rule"]
    rule = Rule.load(stored["kind"], stored["column"], stored["params"])
    if rule.level != "row" or rule.kind == "zscore_below":
        raise FixError(f"'{rule.kind}' has no predicate on a single row")
    return row_check(rule, df.schema).violation


def _new_value(df: DataFrame, fix: Fix) -> Column:
    target = field_of(df.schema, fix.column)
    data_type, value, params = target.dataType, col(fix.column), fix.params
    if fix.action == "impute_median":
        outside = any_of(
            [value < typed_literal(params["min"], data_type), value > typed_literal(params["max"], data_type)]
        )
        return F.when(outside, replacement(params["median"], data_type)).otherwise(value)
    if fix.action == "fill_null":
        return F.coalesce(value, replacement(params["value"], data_type))
    if fix.action == "replace_where":
        return F.when(fix_predicate(df, fix), replacement(params["value"], data_type)).otherwise(value)
    if fix.action == "null_out":
        return F.when(~fix_predicate(df, fix), value)
    if fix.action == "clamp":
        # Null stays null: greatest and least skip nulls, so they are guarded.
        held = value
        if params.get("min") is not None:
            held = F.greatest(held, replacement(params["min"], data_type, up=True))
        if params.get("max") is not None:
            held = F.least(held, replacement(params["max"], data_type, up=False))
        return F.when(value.isNotNull(), held)
    if not isinstance(data_type, T.StringType):
        raise FixError(f"fix '{fix.action}' needs a string column, '{fix.column}' is {data_type.simpleString()}")
    if fix.action == "regex_replace":
        return F.regexp_replace(value, params["pattern"], params["replacement"])
    if fix.action in ("trim", "lower", "upper"):
        return {"trim": F.trim, "lower": F.lower, "upper": F.upper}[fix.action](value)
    if fix.action == "map_values":
        chain = None
        for old, new in params["mapping"].items():
            hit = value == F.lit(old)
            chain = F.when(hit, F.lit(new)) if chain is None else chain.when(hit, F.lit(new))
        return value if chain is None else chain.otherwise(value)
    raise FixError(f"no transform for '{fix.action}'")


def apply_fix(df: DataFrame, fix: Fix, transforms: Transforms | None = None) -> DataFrame:
    """One repair. All but ``keep_first`` and ``custom`` are a projection or a filter."""
    try:
        if fix.action in ("drop_where", "quarantine_where"):
            return df.filter(~fix_predicate(df, fix))
        if fix.action == "keep_first":
            return keep_first(df, fix.params["key"], fix.params["order"])
        if fix.action == "custom":
            name = fix.params["name"]
            if not transforms or name not in transforms:
                raise FixError(f"no transform registered as '{name}'")
            return df.transform(transforms[name])
        data_type = field_of(df.schema, fix.column).dataType
        new_value = _new_value(df, fix).cast(data_type)
        return df.select(
            *[new_value.alias(name) if name == fix.column else col(name) for name in df.columns]
        )
    except RuleError as error:
        raise FixError(str(error)) from error


def keep_first(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Keep the first row of every key; rows without a full key are all kept.

    When the repeated keys fit a broadcast, only their rows are ranked and all others pass through
    unmoved. Else all rows with a key are ranked, so that each moves once. The rank filter is
    applied per task before the shuffle as well, so a key holding a third of the table sends one
    row per task; what breaks ties is one number, so columns that nobody asks for do not move.
    """
    repeated = kept_keys(duplicate_keys(df, key), key)
    if broadcastable(repeated, max_broadcast_bytes):
        flagged = flag_by_keys(df, key, repeated, "__repeated", max_broadcast_bytes)
        rest, ranked = flagged.filter(~F.col("__repeated")), flagged.filter(F.col("__repeated"))
    else:
        rest, ranked = df.filter(~keys_present(key)), df.filter(keys_present(key))
    names = [col(c) for c in df.columns]
    hashable = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ordering = [col(c).asc_nulls_last() for c in order] + [F.col("__tie")]
    first = (
        ranked.withColumn("__tie", F.xxhash64(*hashable))
        .withColumn("__rank", F.row_number().over(Window.partitionBy(*[col(k) for k in key]).orderBy(*ordering)))
        .filter(F.col("__rank") <= 1)
        .select(*names)
    )
    return rest.select(*names).unionByName(first)


def quarantine_where(df: DataFrame, predicate: str) -> tuple[DataFrame, DataFrame]:
    """Route rows out: kept rows and quarantined rows."""
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    return df.filter(~hit), df.filter(hit)


# Column of a side table that names the repair a row was routed by.
FIX_ID = "fix_id"


def routed_rows(df: DataFrame, fix: Fix) -> DataFrame:
    """The second output of ``quarantine_where``: the rows it takes out, with its id."""
    return df.filter(fix_predicate(df, fix)).withColumn(FIX_ID, F.lit(fix.fix_id))


def gathered(routed: Sequence[DataFrame]) -> DataFrame | None:
    """Side tables of several repairs as one; a column that only later ones have is null before."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), routed) if routed else None


@dataclass
class Replay:
    """Result of chaining fixes: what applied, what was skipped and why, and the rows routed aside."""

    df: DataFrame
    applied: list[Fix] = field(default_factory=list)
    skipped: list[tuple[Fix, str]] = field(default_factory=list)
    routed: DataFrame | None = None


def schema_loss(before: T.StructType, after: T.StructType) -> str | None:
    """What a repair broke in the schema, or None. New columns are fine."""
    lost = [f.name for f in before.fields if f.name not in after.names]
    if lost:
        return f"dropped columns {lost}"
    changed = [f.name for f in before.fields if after[f.name].dataType != f.dataType]
    if changed:
        return f"changed the type of {changed}"
    return None


def apply_fixes(df: DataFrame, fixes: Sequence[Fix], transforms: Transforms | None = None) -> Replay:
    """Chain fixes in order. One that no longer fits the table is skipped with a warning."""
    replay, routed = Replay(df), []
    for fix in fixes:
        try:
            out = apply_fix(replay.df, fix, transforms)
            problem = schema_loss(replay.df.schema, out.schema)
        except (FixError, AnalysisException, ParseException) as error:
            out, problem = None, str(error).splitlines()[0]
        if problem is not None:
            logger.warning("fix %s skipped: %s", fix.fix_id, problem)
            replay.skipped.append((fix, problem))
        else:
            if fix.action == "quarantine_where":
                routed.append(routed_rows(replay.df, fix))
            replay.df = out
            replay.applied.append(fix)
    replay.routed = gathered(routed)
    return replay


def template_fix(rule: Rule, profile: ColumnProfile | None) -> Fix | None:
    """Median imputation for a range failure; None unless both bounds and a median are known."""
    if rule.kind != "between" or profile is None or profile.median is None:
        return None
    low, high = rule.params.get("min"), rule.params.get("max")
    if low is None or high is None:
        return None
    return Fix(
        "impute_median",
        rule.columns[0],
        {"min": low, "max": high, "median": profile.median},
        f"values of {rule.column} out of range become its median",
    )


def plan_fixes(
    failures: Sequence[Measure],
    profiles: Sequence[ColumnProfile],
    schema: T.StructType,
    repair_not_drop: bool,
    proposed: Mapping[str, Sequence[Fix]] | None = None,
    order: Sequence[str] = (),
    quarantine_failures: bool = False,
) -> dict[str, list[Fix]]:
    """Repairs to try per failed rule id, best first.

    A proposed repair (by rule id or by reason text) comes first, then what fits the rule. Rows
    are only dropped where that is allowed; a failure without a sound repair gets none, and its
    rows go to quarantine. With ``quarantine_failures`` routing them to a side table is a repair
    of its own, the last one tried.
    """
    proposed = proposed or {}
    by_column = {p.column: p for p in profiles}
    plan: dict[str, list[Fix]] = {}
    for failure in failures:
        rule = failure.rule
        options = list(proposed.get(rule.rule_id, ())) + list(proposed.get(rule.reason, ()))
        if len(rule.columns) == 1 and rule.level == "row":
            column, profile = rule.columns[0], by_column.get(rule.columns[0])
            data_type = field_of(schema, column).dataType
            template = template_fix(rule, profile)
            if template is not None:
                options.append(template)
            if rule.kind == "not_null" and (is_numeric(data_type) or is_time(data_type)):
                if profile is not None and profile.median is not None:
                    options.append(
                        Fix("fill_null", column, {"value": profile.median}, f"missing {column} becomes its median")
                    )
        if not repair_not_drop:
            if rule.level == "row" and rule.kind != "zscore_below":
                options.append(
                    Fix("drop_where", rule.columns[0] if rule.columns else None, {"rule": rule_param(rule)},
                        f"rows breaking {rule.reason} are dropped")
                )
            elif rule.kind == "unique":
                keep = list(order) or [
                    f.name
                    for f in schema.fields
                    if f.name not in rule.columns and not isinstance(f.dataType, (T.MapType, T.VariantType))
                ]
                options.append(
                    Fix("keep_first", None, {"key": list(rule.columns), "order": keep},
                        f"only the first row per {rule.column} is kept")
                )
        if quarantine_failures and rule.level == "row" and rule.kind != "zscore_below" and not needs_reference(rule):
            options.append(
                Fix("quarantine_where", rule.columns[0] if rule.columns else None, {"rule": rule_param(rule)},
                    f"rows breaking {rule.reason} are routed aside")
            )
        plan[rule.rule_id] = list(dict.fromkeys(options))
    return plan
