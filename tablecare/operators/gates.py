"""Gates that a repair or a new rule must pass before it is accepted."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.typed import any_of, col
from tablecare.operators.fixes import Transforms, apply_fix, fix_predicate, schema_loss
from tablecare.operators.keyflags import BadKeys, flag_by_keys
from tablecare.operators.rules import row_check
from tablecare.operators.validate import (
    PROBE,
    Counts,
    Measure,
    Tables,
    bad_keys,
    dry_run,
    judged_by_keys,
    measure,
    measures_of,
    validate,
)
from tablecare.spec import DEFAULT_TRIAL_ROWS, RULE_KINDS, Fix, FixError, Rule, RuleError, dedupe_rules


@dataclass(frozen=True)
class Snapshot:
    """A table's row count, the measures of its suite, and the bad keys of rules judged by keys.

    ``counts`` are what was counted beside the suite, ``keys`` written tables by rule id: they hold
    as long as the table does, so a rule that a repair cannot touch never shuffles its key again.
    """

    rows: int
    measures: Mapping[str, Measure]
    keys: Mapping[str, BadKeys] = field(default_factory=dict)
    counts: Sequence[tuple[int, int, int]] = ()

    def failures(self) -> list[Measure]:
        return [m for m in self.measures.values() if not m.success]

    @property
    def success(self) -> bool:
        return not self.failures()


@dataclass(frozen=True)
class GateResult:
    fix: Fix
    rule: Rule
    passed: bool
    note: str
    before_count: int
    after_count: int | None
    rows_before: int
    rows_after: int | None
    changed_rows: int | None = None
    collateral_rows: int | None = None
    routed_rows: int = 0


def snapshot(
    df: DataFrame,
    rules: Sequence[Rule],
    tables: Tables | None = None,
    evaluate: Sequence[str] = (),
    counts: Sequence[Counts] = (),
) -> Snapshot:
    """Measure a suite and, in the same pass, evaluate the named columns on every row.

    A bare count would not do: columns nobody asks for are never computed. The bad keys of rules
    judged by keys are found first, with one shuffle of their key each, and stay with the snapshot.
    """
    rules = dedupe_rules(rules)
    keys = {r.rule_id: bad_keys(df, r, tables) for r in rules if judged_by_keys(r)}
    rows = validate(df, rules, tables, probe=evaluate, kept=keys, counts=counts).collect()
    by_order = {r["ord"]: r for r in rows}
    beside = [by_order[PROBE - 1 - i] for i in range(len(counts))]
    return Snapshot(
        by_order[PROBE]["element_count"],
        {m.rule.rule_id: m for m in measures_of(rules, rows)},
        keys,
        [(r["element_count"], r["evaluated_count"], r["unexpected_count"]) for r in beside],
    )


# -- what a repair changes -----------------------------------------------------------------

# Values before the repair, and whether the row was one to be repaired, side by side with the new row.
BEFORE, TARGET, COUNTED = "__before", "__target", "__counted"


def _watched(df: DataFrame, fix: Fix, rule: Rule, before: Snapshot) -> DataFrame:
    """The table with what ``_changes`` compares: old values and whether the repair may touch the row.

    A repair answers for the rows its own predicate names, else for those that break its rule. A
    rule about the whole table names no rows, so all of them may change.
    """
    names = df.columns if fix.action == "custom" else [fix.column]
    target: Column = F.lit(True)
    if fix.action == "custom":
        if {"predicate", "rule"} & set(fix.params):
            target = fix_predicate(df, fix)
        elif judged_by_keys(rule) and rule.rule_id in before.keys:
            flagged = flag_by_keys(df, rule.columns, before.keys[rule.rule_id], TARGET)
            return flagged.withColumn(BEFORE, F.struct(*[col(c) for c in names]))
        elif rule.level == "row" and rule.kind != "zscore_below":
            target = F.coalesce(row_check(rule, df.schema).violation, F.lit(False))
    return df.withColumns({TARGET: target, BEFORE: F.struct(*[col(c) for c in names])})


def _changes(df: DataFrame, fix: Fix, rule: Rule, schema: T.StructType) -> Counts:
    """Rows outside the target that are still there, changed rows, and rows changed beside the target."""

    def differs(names: Sequence[str]) -> Column:
        comparable = [c for c in names if not isinstance(schema[c].dataType, (T.MapType, T.VariantType))]
        return any_of([~col(c).eqNullSafe(F.col(BEFORE)[c]) for c in comparable]) if comparable else F.lit(False)

    if fix.action != "custom":
        return F.lit(False), differs([fix.column]), F.lit(False)
    own = [fix.column] if fix.column is not None else list(rule.columns) or schema.names
    others = [c for c in schema.names if c not in own]
    changed = differs(schema.names)
    return ~F.col(TARGET), changed, differs(others) | (changed & ~F.col(TARGET))


def rewritten(df: DataFrame, fixes: Sequence[Fix]) -> list[str]:
    """Columns whose values these repairs compute anew; all, where a repair does not say."""
    if any(f.action == "custom" for f in fixes):
        return df.columns
    return list(dict.fromkeys(f.column for f in fixes if f.column is not None and not f.may_drop_rows))


def touches(rule: Rule, fix: Fix) -> bool:
    """May this repair change what this rule measures?

    Repairs that only rewrite one column cannot move a rule on other columns, which saves
    measuring it again; that matters most for rules that need a shuffle.
    """
    if fix.may_drop_rows or (rule.kind == "where"):
        return True
    return fix.column in rule.columns


def trial(df: DataFrame, fix: Fix, transforms: Transforms | None = None, rows: int = DEFAULT_TRIAL_ROWS) -> str | None:
    """Cheap early exit on a few rows: why the repair cannot run, or None. Never the verdict."""
    try:
        out = apply_fix(df.limit(rows), fix, transforms)
        problem = schema_loss(df.schema, out.schema)
        if problem is None:
            out.write.format("noop").mode("overwrite").save()
        return problem
    except (FixError, PySparkException) as error:
        return f"does not run: {_first_line(error)}"


def _first_line(error: Exception) -> str:
    return (str(error).splitlines() or [type(error).__name__])[0]


def judge(
    fix: Fix,
    rule: Rule,
    before: Snapshot,
    after: Snapshot,
    repair_not_drop: bool,
    protect: bool = True,
    routed: int = 0,
) -> GateResult:
    """Rows kept or routed, nothing changed beside the target, failure reduced, nothing else made worse.

    ``after.counts`` holds the one triple of ``_changes`` where the repair was watched.
    """
    was, now = before.measures[rule.rule_id], after.measures[rule.rule_id]
    others, changed, collateral = after.counts[0] if after.counts else (None, None, None)

    def verdict(passed: bool, note: str) -> GateResult:
        return GateResult(
            fix, rule, passed, note, was.unexpected_count, now.unexpected_count, before.rows, after.rows,
            changed, collateral, routed,
        )

    if fix.action == "quarantine_where":
        if after.rows + routed != before.rows:
            return verdict(False, f"{after.rows} rows kept and {routed} routed of {before.rows}")
    elif repair_not_drop and after.rows < before.rows:
        return verdict(False, f"deleted {before.rows - after.rows} rows, none may be dropped")
    if collateral:
        return verdict(False, f"changed {collateral} rows or values beside its target")
    if fix.action == "custom" and rule.level in ("row", "key") and rule.kind != "zscore_below":
        # rows that did not break the rule are all still there, once each
        good = before.rows - was.unexpected_count
        if others is not None and not {"predicate", "rule"} & set(fix.params) and others != good:
            return verdict(False, f"left {others} of {good} rows beside its target")
    counted = rule.level in ("row", "key")
    if counted and now.unexpected_count >= was.unexpected_count:
        return verdict(False, f"changed nothing: {now.unexpected_count} of {was.unexpected_count} rows still fail")
    # Rules judged by one number have no rows to count: passing, or coming closer, is progress.
    if not counted and not now.success and now.distance >= was.distance:
        return verdict(False, "no closer to the bound")
    if protect:
        worse = [
            m.rule.reason
            for rule_id, m in after.measures.items()
            if rule_id != rule.rule_id and _worse(before.measures[rule_id], m)
        ]
        if worse:
            return verdict(False, f"made worse: {'; '.join(worse)}")
    return verdict(True, "accepted")


def _worse(was: Measure, now: Measure) -> bool:
    if was.rule.level in ("row", "key"):
        return now.unexpected_count > was.unexpected_count
    return was.success and not now.success


def check_fixes(
    df: DataFrame,
    before: Snapshot,
    rules: Sequence[Rule],
    pairs: Sequence[tuple[Fix, Rule]],
    repair_not_drop: bool,
    transforms: Transforms | None = None,
    tables: Tables | None = None,
    protect: bool = True,
) -> tuple[DataFrame, Snapshot, list[GateResult]]:
    """Gate independent repairs (see ``independent``) together: one measuring pass for all.

    Because no rule sees two of the rewritten columns, every rule's count after the joint
    repair is the count after its own repair alone. Returns the table with the passing repairs,
    its snapshot and one result per repair.
    """
    rules = dedupe_rules(rules)
    results: dict[str, GateResult] = {}
    runnable: list[tuple[Fix, Rule]] = []
    candidate = df
    watched: dict[str, int] = {}
    counts: list[Counts] = []
    added: list[str] = []
    routed = 0
    for fix, rule in pairs:
        was = before.measures[rule.rule_id].unexpected_count
        follow = fix.action == "custom" or not fix.may_drop_rows
        try:
            start = candidate
            if follow:
                start = _watched(candidate, fix, rule, before)
            out = apply_fix(start, fix, transforms)
            problem = schema_loss(candidate.schema, out.schema)
            if problem is None and follow and not {BEFORE, TARGET} <= set(out.columns):
                problem = "drops columns that it does not know"
            if problem is None and fix.action == "custom":
                problem = trial(candidate, fix, transforms)
            if problem is None and fix.action == "quarantine_where":
                routed = candidate.filter(fix_predicate(candidate, fix)).count()
        except (FixError, PySparkException) as error:
            out, problem = candidate, f"does not run: {_first_line(error)}"
        if problem is not None:
            results[fix.fix_id] = GateResult(fix, rule, False, problem, was, None, before.rows, None)
        else:
            if follow:
                watched[fix.fix_id] = len(counts)
                names = [f"{COUNTED}{len(counts)}_{k}" for k in range(3)]
                conditions = _changes(out, fix, rule, candidate.schema)
                out = out.withColumns(dict(zip(names, conditions, strict=True))).drop(BEFORE, TARGET)
                counts.append(tuple(F.col(n) for n in names))
                added += names
            candidate = out
            runnable.append((fix, rule))
    if not runnable:
        return df, before, [results[f.fix_id] for f, _ in pairs]

    moved = [r for r in rules if any(touches(r, fix) for fix, _ in runnable)]
    plain = candidate.drop(*added)
    try:
        seen = snapshot(candidate, moved, tables, rewritten(plain, [fix for fix, _ in runnable]), counts)
        candidate = plain
    except PySparkException as error:
        if len(runnable) > 1:
            # One of them breaks on some row; find out which by taking them one at a time.
            current, state, ordered = df, before, []
            for pair in pairs:
                current, state, outcome = check_fixes(
                    current, state, rules, [pair], repair_not_drop, transforms, tables, protect
                )
                ordered += outcome
            return current, state, ordered
        fix, rule = runnable[0]
        was = before.measures[rule.rule_id].unexpected_count
        results[fix.fix_id] = GateResult(
            fix, rule, False, f"does not run: {_first_line(error)}", was, None, before.rows, None
        )
        return df, before, [results[f.fix_id] for f, _ in pairs]

    accepted: list[Fix] = []
    merged, keys = dict(before.measures), dict(before.keys)
    for fix, rule in runnable:
        own = {r.rule_id: seen.measures[r.rule_id] for r in moved if touches(r, fix)}
        own.setdefault(rule.rule_id, before.measures[rule.rule_id])
        counted = [seen.counts[watched[fix.fix_id]]] if fix.fix_id in watched else []
        result = judge(fix, rule, before, Snapshot(seen.rows, own, {}, counted), repair_not_drop, protect, routed)
        results[fix.fix_id] = result
        if result.passed:
            accepted.append(fix)
            merged.update(own)
            keys.update({rule_id: bad for rule_id, bad in seen.keys.items() if rule_id in own})
    ordered = [results[f.fix_id] for f, _ in pairs]
    if not accepted:
        return df, before, ordered
    for fix in accepted if len(accepted) < len(runnable) else []:
        df = apply_fix(df, fix, transforms)
    rows = seen.rows if any(f.may_drop_rows for f in accepted) else before.rows
    return (candidate if len(accepted) == len(runnable) else df), Snapshot(rows, merged, keys), ordered


def independent(pairs: Sequence[tuple[Fix, Rule]], rules: Sequence[Rule]) -> list[tuple[Fix, Rule]]:
    """The longest leading choice of repairs that may be gated together."""
    chosen: list[tuple[Fix, Rule]] = []
    for fix, rule in pairs:
        if fix.may_drop_rows:
            if not chosen:
                return [(fix, rule)]
            continue
        clash = any(
            fix.column == other.column or any(touches(r, fix) and touches(r, other) for r in rules)
            for other, _ in chosen
        )
        if not clash:
            chosen.append((fix, rule))
    return chosen


# -- gates on rules ------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleCheck:
    passed: bool
    note: str


def check_rule(baseline: DataFrame, rule: Rule, tables: Tables | None = None) -> RuleCheck:
    """A new rule must run on the clean baseline and must not flag it."""
    try:
        seen = dry_run(baseline, rule, tables)
    except (RuleError, PySparkException) as error:
        return RuleCheck(False, f"does not run on the baseline: {_first_line(error)}")
    return _baseline_verdict(seen)


def _baseline_verdict(seen: Measure) -> RuleCheck:
    if not seen.success:
        return RuleCheck(
            False, f"would flag the clean baseline: {seen.unexpected_count}/{seen.element_count} rows"
        )
    return RuleCheck(True, "passed the structure check and the clean baseline")


def check_rules(baseline: DataFrame, rules: Sequence[Rule], tables: Tables | None = None) -> list[RuleCheck]:
    """``check_rule`` for many rules in one pass; one by one only if some rule does not run."""
    try:
        seen = {m.rule.rule_id: m for m in measure(baseline, rules, tables)}
    except (RuleError, PySparkException):
        return [check_rule(baseline, rule, tables) for rule in rules]
    return [_baseline_verdict(seen[rule.rule_id]) for rule in rules]


# Names under which rules may arrive in a rule table, next to our own.
RULE_ALIASES = {
    "expect_column_values_to_not_be_null": "not_null",
    "expect_column_values_to_be_null": "is_null",
    "expect_column_values_to_be_unique": "unique",
    "expect_column_values_to_be_in_set": "in_set",
    "expect_column_values_to_not_be_in_set": "not_in_set",
    "expect_column_values_to_be_between": "between",
    "expect_column_values_to_match_regex": "matches",
    "expect_column_values_to_not_match_regex": "not_matches",
    "expect_column_value_lengths_to_be_between": "length_between",
}

# Parameter names that may arrive next to our own.
PARAM_ALIASES = {"min_value": "min", "max_value": "max", "value_set": "values", "regex": "regex", "mostly": "mostly"}


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def resolve_kind(name: str) -> str | None:
    """Our rule kind for a name in snake or Pascal case, or None."""
    plain = snake_case(name)
    kind = RULE_ALIASES.get(plain, plain)
    return kind if kind in RULE_KINDS else None


# Rule kinds that can be stated with the parameters a rule table has room for.
_IMPORTABLE = {
    "not_null": (),
    "is_null": (),
    "unique": (),
    "in_set": ("values",),
    "not_in_set": ("values",),
    "between": ("min", "max"),
    "matches": ("regex",),
    "not_matches": ("regex",),
    "length_between": ("min", "max"),
}


def import_rules(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check a table of foreign rules (``name``, ``column``, ``params`` as JSON text).

    Accepted rows carry the resolved ``rule`` and normalised parameters, rejected rows a
    ``problem``. Works on columns only, so a rule table of any size is checked in place.
    """
    plain = F.lower(F.regexp_replace("name", r"(?<=[a-z0-9])(?=[A-Z])", "_"))
    known = {**{k: k for k in _IMPORTABLE}, **RULE_ALIASES}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    params = F.from_json("params", "map<string,string>")
    renamed = F.transform_keys(
        params,
        lambda k, _: F.coalesce(
            F.try_element_at(F.create_map(*[F.lit(x) for pair in PARAM_ALIASES.items() for x in pair]), k), k
        ),
    )
    staged = table.select(
        *[col(c) for c in table.columns],
        F.try_element_at(names, plain).alias("rule"),
        F.map_filter(renamed, lambda k, _: k != "column").alias("__params"),
    ).withColumn(
        # Accepts ["A"] and ['A']; anything else is no list.
        "__values", F.from_json(F.try_element_at("__params", F.lit("values")), "array<string>")
    )
    value = lambda key: F.try_element_at("__params", F.lit(key))
    allowed = F.create_map(
        *[
            x
            for kind, keys in _IMPORTABLE.items()
            for x in (F.lit(kind), F.array(*[F.lit(k) for k in (*keys, "mostly")]))
        ]
    )
    unknown = F.array_except(F.map_keys("__params"), F.try_element_at(allowed, F.col("rule")))
    low, high, mostly = (value(k).try_cast("double") for k in ("min", "max", "mostly"))
    ranged = F.col("rule").isin("between", "length_between")
    listed = F.col("rule").isin("in_set", "not_in_set")
    problem = (
        F.when(F.col("rule").isNull(), "unknown rule")
        .when(F.col("column").isNull() | (F.col("column") == ""), "no column")
        .when(F.col("__params").isNull(), "parameters are no JSON object")
        .when(F.size(unknown) > 0, "unknown parameter")
        .when(ranged & value("min").isNull() & value("max").isNull(), "no bound")
        .when((F.col("rule") == "length_between") & value("min").isNotNull() & low.isNull(), "bound is no number")
        .when((F.col("rule") == "length_between") & value("max").isNotNull() & high.isNull(), "bound is no number")
        .when(listed & (F.col("__values").isNull() | (F.size("__values") == 0)), "values are no list")
        .when(F.col("rule").isin("matches", "not_matches") & value("regex").isNull(), "no regex")
        .when(value("mostly").isNotNull() & ~F.coalesce(mostly.between(0.0, 1.0), F.lit(False)), "mostly not in 0..1")
    )
    judged = staged.withColumn("problem", problem)
    good = judged.filter(F.col("problem").isNull()).select(
        *[col(c) for c in table.columns if c not in ("name", "params")],
        "rule",
        F.when(listed, F.col("__values")).alias("values"),
        F.when(ranged, value("min")).alias("min"),
        F.when(ranged, value("max")).alias("max"),
        value("regex").alias("regex"),
        F.coalesce(mostly, F.lit(1.0)).alias("mostly"),
    )
    bad = judged.filter(F.col("problem").isNotNull()).select(*[col(c) for c in table.columns], "problem")
    return good, bad


def rules_from_import(good: DataFrame) -> list[Rule]:
    """Accepted rows as rules; a suite is small, so this is a driver-side list."""
    rules = []
    for row in good.collect():
        params: dict = {}
        if row["values"] is not None:
            params["values"] = list(row["values"])
        for key in ("min", "max"):
            if row[key] is not None:
                params[key] = _number_or_text(row[key])
        if row["regex"] is not None:
            params["regex"] = row["regex"]
        rules.append(Rule(row["rule"], tuple(c.strip() for c in row["column"].split(",")), params, row["mostly"]))
    return dedupe_rules(rules)


def _number_or_text(text: str):
    try:
        value = float(text)
    except ValueError:
        return text
    return int(value) if value.is_integer() and "." not in text else value
