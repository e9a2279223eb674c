"""Evaluate a suite of rules: counts per rule, and reasons per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from dataclasses import fields as dataclass_fields

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.typed import (
    col,
    field_of,
    is_time,
    listed_values,
    sql_double,
    sql_name,
    sql_text,
    typed_literal,
)
from tablecare.operators.keyflags import (
    BadKeys,
    duplicate_keys,
    flag_by_keys,
    kept_keys,
    key_counts,
    keys_present,
    orphan_keys,
)
from tablecare.operators.quantiles import exact_quantiles
from tablecare.operators.rules import column_statistics, row_check
from tablecare.operators.sizing import MAX_BROADCAST_BYTES
from tablecare.spec import Rule, RuleError, dedupe_rules

REASONS = "dq_reasons"

Tables = Mapping[str, DataFrame]
# Three conditions whose rows are counted in a validation's pass.
Counts = tuple[Column, Column, Column]

# Longer value lists become a table to join instead of constants in the plan.
# A longer list of values is joined as a table; which plan runs changes no result.
MAX_INLINE_VALUES = 1000

# Order number and rule of the extra result row that a probing validation adds; rows of further
# counts taken in the same pass come below it.
PROBE = -1
ROW_COUNT = Rule("row_count_between", (), {"min": 0})


@dataclass(frozen=True)
class Measure:
    """Outcome of one rule, as it reaches the driver."""

    rule: Rule
    element_count: int
    evaluated_count: int
    unexpected_count: int
    unexpected_percent: float
    observed: float | None
    distance: float
    success: bool


# -- result rows ---------------------------------------------------------------------------
# One result row per rule is a struct over the one-row aggregate. The structs are stated as SQL
# text, because a suite of many rules would otherwise cost thousands of calls into the JVM.


def _entry(
    order: int,
    rule: Rule,
    elements: str,
    evaluated: str,
    unexpected: str,
    observed: str = "NULL",
    distance: str = "0",
    holds: str = "NULL",
) -> str:
    return f"""named_struct(
        'ord', {order},
        'rule_id', {sql_text(rule.rule_id)},
        'rule', {sql_text(rule.kind)},
        'column', {sql_text(rule.column)},
        'mostly', {sql_double(rule.mostly)},
        'element_count', coalesce(CAST({elements} AS BIGINT), 0L),
        'evaluated_count', coalesce(CAST({evaluated} AS BIGINT), 0L),
        'unexpected_count', coalesce(CAST({unexpected} AS BIGINT), 0L),
        'observed', CAST({observed} AS DOUBLE),
        'distance', CAST({distance} AS DOUBLE),
        'holds', CAST({holds} AS BOOLEAN))"""


def _bounded(order: int, rule: Rule, elements: str, observed: str) -> str:
    """A number judged by bounds. Without a number there is nothing to break them."""
    low, high = rule.params.get("min"), rule.params.get("max")
    value = f"CAST({observed} AS DOUBLE)"
    tests, gaps = [], []
    if low is not None:
        tests.append(f"{value} >= {sql_double(low)}")
        gaps.append(f"greatest({sql_double(low)} - {value}, 0D)")
    if high is not None:
        tests.append(f"{value} <= {sql_double(high)}")
        gaps.append(f"greatest({value} - {sql_double(high)}, 0D)")
    holds = f"coalesce({' AND '.join(tests)}, true)"
    return _entry(
        order, rule, elements, elements, f"if({holds}, 0, 1)", observed, f"coalesce({' + '.join(gaps)}, 0D)", holds
    )


def _unfold(one_row: DataFrame, entries: Sequence[str]) -> DataFrame:
    return one_row.selectExpr(f"inline(array({', '.join(entries)}))")


# -- the three kinds of branch -------------------------------------------------------------


def _time_number(value: Column, schema: T.StructType, name: str) -> Column:
    """Aggregate bounds on time columns are judged in seconds since the epoch."""
    if not is_time(field_of(schema, name).dataType):
        return value
    return F.unix_micros(value.cast("timestamp")) / F.lit(1_000_000)


def _shared_pass(
    df: DataFrame,
    rules: list[tuple[int, Rule]],
    tables: Tables,
    probe: Sequence[str] | None = None,
    kept: Mapping[str, BadKeys] | None = None,
    counts: Sequence[Counts] = (),
) -> DataFrame:
    """All row rules and plain aggregates in one aggregate over one scan."""
    measures: dict[str, Column] = {"__n": F.count(F.lit(1))}
    evaluated_names: dict[str, str] = {"*": "__n"}
    statistics = column_statistics(df, [rule for _, rule in rules])
    entries = []
    if probe is not None:
        # A digest of the named columns, so that their expressions are evaluated on every row.
        probed = [col(c) for c in probe if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
        measures["__digest"] = F.bit_xor(F.xxhash64(*probed)) if probed else F.lit(0)
        entries.append(_entry(PROBE, ROW_COUNT, "__n", "__n", "0", "__digest", "0", "true"))
    for i, three in enumerate(counts):
        measures |= {f"__c{i}_{k}": F.count_if(c) for k, c in enumerate(three)}
        entries.append(_entry(PROBE - 1 - i, ROW_COUNT, f"__c{i}_0", f"__c{i}_1", f"__c{i}_2"))
    for order, rule in rules:
        own = f"__m{order}"
        if kept and rule.rule_id in kept:
            # its bad keys are counted already; what is left is a count of full keys
            measures[f"__e{order}"] = F.count_if(keys_present(rule.columns))
            entries.append(_entry(order, rule, "__n", f"__e{order}", f"{kept[rule.rule_id].rows}L"))
        elif rule.level == "row":
            check = row_check(rule, df.schema, statistics)
            if check.evaluated_key not in evaluated_names:
                evaluated_names[check.evaluated_key] = f"__e{order}"
                measures[f"__e{order}"] = F.count_if(check.evaluated)
            measures[own] = F.count_if(check.violation)
            entries.append(_entry(order, rule, "__n", evaluated_names[check.evaluated_key], own))
        elif rule.kind == "row_count_between":
            entries.append(_bounded(order, rule, "__n", "__n"))
        elif rule.kind == "row_count_equals":
            # One number about another table; a count without any column.
            other = _table(tables, rule.params["table"]).count()
            holds = f"__n = {other}L"
            entries.append(
                _entry(order, rule, "__n", "__n", f"if({holds}, 0, 1)", "__n", f"abs(__n - {other}L)", holds)
            )
        elif rule.kind in ("median_between", "quantile_between"):
            value = _exact_quantile(df, rule)
            entries.append(_bounded(order, rule, "__n", "NULL" if value is None else sql_double(value)))
        elif rule.kind == "null_ratio_between":
            measures[own] = F.count_if(col(rule.columns[0]).isNull())
            entries.append(_bounded(order, rule, "__n", f"if(__n > 0, {own} / __n, NULL)"))
        elif rule.kind == "distinct_count_between":
            measures[own] = F.approx_count_distinct(col(rule.columns[0]))
            entries.append(_bounded(order, rule, "__n", own))
        else:
            name = rule.columns[0]
            if rule.kind in ("min_between", "max_between"):
                value = (F.min if rule.kind == "min_between" else F.max)(col(name))
                measures[own] = _time_number(value, df.schema, name)
            else:
                function = {"mean_between": F.avg, "sum_between": F.sum, "stddev_between": F.stddev}[rule.kind]
                whole = rule.kind == "sum_between" and isinstance(field_of(df.schema, name).dataType, T.IntegralType)
                # a sum of whole numbers may leave their type
                measures[own] = F.sum(col(name).cast("decimal(38,0)")).cast("double") if whole else function(col(name))
            entries.append(_bounded(order, rule, "__n", own))
    return _unfold(df.agg(*[expr.alias(name) for name, expr in measures.items()]), entries)


def _exact_quantile(df: DataFrame, rule: Rule) -> float | None:
    name = rule.columns[0]
    value = exact_quantiles(df, [name], float(rule.params.get("q", 0.5)))[name]
    if value is None:
        return None
    data_type = field_of(df.schema, name).dataType
    if isinstance(data_type, T.DateType):
        return float(value) * 86_400
    return float(value) / 1_000_000 if is_time(data_type) else float(value)


def _grouped_pass(df: DataFrame, columns: tuple[str, ...], rules: list[tuple[int, Rule]]) -> DataFrame:
    """Uniqueness and distinct-value rules that share a key: one shuffle of key and count."""
    present = " AND ".join(f"{sql_name(c)} IS NOT NULL" for c in columns)
    measures = {
        "n": "sum(__n)",
        "e": f"sum(__n) FILTER (WHERE {present})",
        "d": f"count_if({present})",
    }
    counts: dict[str, Column] = {}
    entries = []
    for order, rule in rules:
        own = f"m{order}"
        if rule.kind == "unique":
            measures["u"] = f"sum(__n) FILTER (WHERE {present} AND __n > 1)"
            entries.append(_entry(order, rule, "n", "e", "u"))
        elif rule.kind == "distinct_count_between":
            entries.append(_bounded(order, rule, "n", "d"))
        elif rule.kind == "unique_ratio_between":
            entries.append(_bounded(order, rule, "n", "if(e > 0, d / e, NULL)"))
        else:
            data_type = field_of(df.schema, columns[0]).dataType
            wanted = list(dict.fromkeys(rule.params["values"]))
            value = col(columns[0])
            member = value.isNotNull() & value.isin([typed_literal(v, data_type) for v in wanted])
            if rule.kind == "most_common_in_set":
                # Most rows first; of equally common values the smallest.
                rank = F.struct(F.when(value.isNotNull(), -F.col("__n")).otherwise(F.lit(0)), value)
                counts[own] = F.min_by(F.when(member, 0).otherwise(1), rank)
                bad = f"if(d > 0, {own}, 0)"
            else:
                counts[own] = F.count_if(member)
                extra, lacking = f"(d - {own})", f"({len(wanted)} - {own})"
                bad = {
                    "distinct_in_set": extra,
                    "distinct_contain_set": lacking,
                    "distinct_equal_set": f"({extra} + {lacking})",
                }[rule.kind]
            entries.append(_entry(order, rule, "n", "e", bad, "d", bad, f"{bad} = 0"))
    grouped = key_counts(df, columns)
    one_row = grouped.agg(
        *[F.expr(text).alias(name) for name, text in measures.items()],
        *[expr.alias(name) for name, expr in counts.items()],
    )
    return _unfold(one_row, entries)


def needs_reference(rule: Rule) -> bool:
    """Is this rule judged against another table? Long value lists are treated as one."""
    return rule.kind == "foreign_key" or (
        rule.kind == "in_set" and len(rule.params["values"]) > MAX_INLINE_VALUES
    )


def _reference(df: DataFrame, rule: Rule, tables: Tables) -> tuple[DataFrame, Sequence[str]]:
    if rule.kind == "foreign_key":
        return _table(tables, rule.params["table"]), rule.params["ref_columns"]
    values, value_type = listed_values(rule.params["values"], field_of(df.schema, rule.columns[0]).dataType)
    texts = df.sparkSession.createDataFrame([(str(v),) for v in values], "value string")
    return texts.select(F.col("value").cast(value_type).alias("value")), ["value"]


def _reference_pass(df: DataFrame, order: int, rule: Rule, tables: Tables) -> DataFrame:
    keys = rule.columns
    reference, refs = _reference(df, rule, tables)
    known = (
        reference
        .select(*[col(c).alias(f"__r{i}") for i, c in enumerate(refs)])
        .distinct()
        .withColumn("__known", F.lit(True))
    )
    on = [col(k) == F.col(f"__r{i}") for i, k in enumerate(keys)]
    present = keys_present(keys)
    one_row = (
        key_counts(df, keys)
        .join(known, on, "left")
        .agg(
            F.sum("__n").alias("n"),
            F.sum(F.when(present, F.col("__n"))).alias("e"),
            F.sum(F.when(present & F.col("__known").isNull(), F.col("__n"))).alias("u"),
        )
    )
    return _unfold(one_row, [_entry(order, rule, "n", "e", "u")])


def _schema_pass(df: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    """Rules about column names need the schema only, no data."""
    entries = []
    for order, rule in rules:
        have, want = df.columns, list(rule.columns)
        lacking, extra = len(set(want) - set(have)), len(set(have) - set(want))
        if rule.kind == "columns_exist":
            wrong = lacking
        elif rule.kind == "columns_match_set":
            wrong = lacking + extra
        else:
            wrong = sum(a != b for a, b in zip(have, want, strict=False)) + abs(len(have) - len(want))
        entries.append(
            _entry(order, rule, "0", "0", str(wrong), str(len(have)), str(wrong), "true" if wrong == 0 else "false")
        )
    return _unfold(df.sparkSession.range(1), entries)


def _table(tables: Tables, name: str) -> DataFrame:
    if name not in tables:
        raise RuleError(f"rule refers to table '{name}', known: {sorted(tables)}")
    return tables[name]


# -- public operators ----------------------------------------------------------------------


def judged_by_keys(rule: Rule) -> bool:
    """Are rows judged through a table of bad keys?"""
    return rule.kind == "unique" or needs_reference(rule)


def bad_keys(df: DataFrame, rule: Rule, tables: Tables | None = None) -> BadKeys:
    """The keys that break a rule judged by keys, written once."""
    if rule.kind == "unique":
        return kept_keys(duplicate_keys(df, rule.columns), rule.columns)
    return kept_keys(orphan_keys(df, rule.columns, *_reference(df, rule, tables or {})), rule.columns)


def validate(
    df: DataFrame,
    rules: Sequence[Rule],
    tables: Tables | None = None,
    probe: Sequence[str] | None = None,
    kept: Mapping[str, BadKeys] | None = None,
    counts: Sequence[Counts] = (),
) -> DataFrame:
    """One result row per rule, in suite order (column ``ord``).

    ``probe`` adds a row (``ord`` -1) that carries the row count and proves that the columns it
    names can be computed on every row. ``kept`` holds the bad keys of rules, by rule id, that are
    known for this very table; such rules need no shuffle. ``counts`` adds a row each (``ord``
    -2 and below) with the rows of three conditions as elements, evaluated and unexpected.

    Row rules and plain aggregates cost one scan together, rules on key groups one narrow
    shuffle per distinct key, reference rules one join of distinct keys each.
    """
    tables = tables or {}
    rules = dedupe_rules(rules)
    shared: list[tuple[int, Rule]] = []
    grouped: dict[tuple[str, ...], list[tuple[int, Rule]]] = {}
    references: list[tuple[int, Rule]] = []
    schema_only: list[tuple[int, Rule]] = []
    for order, rule in enumerate(rules):
        if rule.level != "schema":
            for name in rule.columns:
                field_of(df.schema, name)
        if rule.level == "schema":
            schema_only.append((order, rule))
        elif kept and rule.rule_id in kept:
            shared.append((order, rule))
        elif needs_reference(rule):
            references.append((order, rule))
        elif rule.kind == "unique" or (rule.level == "group" and not rule.params.get("approximate")):
            grouped.setdefault(rule.columns, []).append((order, rule))
        else:
            shared.append((order, rule))

    parts = []
    if shared or probe is not None or counts:
        parts.append(_shared_pass(df, shared, tables, probe, kept, counts))
    parts += [_grouped_pass(df, columns, members) for columns, members in grouped.items()]
    parts += [_reference_pass(df, order, rule, tables) for order, rule in references]
    if schema_only:
        parts.append(_schema_pass(df, schema_only))
    if not parts:
        parts.append(_shared_pass(df, [(0, ROW_COUNT)], tables).limit(0))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)

    share = "if(evaluated_count > 0, unexpected_count / evaluated_count, 0D)"
    return result.selectExpr(
        "ord",
        "rule_id",
        "rule",
        "column",
        "element_count",
        "evaluated_count",
        "unexpected_count",
        f"100 * {share} AS unexpected_percent",
        "100 * if(element_count > 0, unexpected_count / element_count, 0D) AS unexpected_percent_total",
        "observed",
        "distance",
        f"coalesce(holds, evaluated_count = 0 OR 1 - {share} >= mostly) AS success",
    )


def measure(df: DataFrame, rules: Sequence[Rule], tables: Tables | None = None) -> list[Measure]:
    """``validate`` brought to the driver: one short record per rule."""
    ordered = dedupe_rules(rules)
    return measures_of(ordered, validate(df, ordered, tables).collect()) if ordered else []


def measures_of(rules: Sequence[Rule], rows: Sequence[Row]) -> list[Measure]:
    by_order = {r["ord"]: r for r in rows}
    fields = [f.name for f in dataclass_fields(Measure) if f.name != "rule"]
    return [Measure(rule, *[by_order[i][name] for name in fields]) for i, rule in enumerate(rules)]


MEASURE_SCHEMA = (
    "ord int, rule_id string, rule string, column string, element_count bigint, evaluated_count bigint, "
    "unexpected_count bigint, unexpected_percent double, observed double, success boolean"
)


def measures_frame(spark: SparkSession, measures: Sequence[Measure]) -> DataFrame:
    """Measures as result rows again."""
    rows = [
        (i, m.rule.rule_id, m.rule.kind, m.rule.column, m.element_count, m.evaluated_count, m.unexpected_count,
         m.unexpected_percent, m.observed, m.success)
        for i, m in enumerate(measures)
    ]
    return spark.createDataFrame(rows, MEASURE_SCHEMA)


def dry_run(df: DataFrame, rule: Rule, tables: Tables | None = None) -> Measure:
    """Evaluate a single rule."""
    return measure(df, [rule], tables)[0]


def succeeded(measures: Sequence[Measure]) -> bool:
    return all(m.success for m in measures)


def attribute(
    df: DataFrame,
    rules: Sequence[Rule],
    failed: Sequence[Rule] | None = None,
    tables: Tables | None = None,
    reasons: str = REASONS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    label: str = "reason",
    kept: Mapping[str, BadKeys] | None = None,
) -> DataFrame:
    """Add the array of reasons each row breaks, in suite order.

    ``label`` picks what stands in the array: the readable ``reason`` or the exact ``rule_id``.

    Only failed rules contribute, so rows tolerated through ``mostly`` stay clean. Row rules are
    evaluated again in place, which costs no shuffle; key rules go through ``flag_by_keys``.
    Pass ``failed`` when the suite has been measured already, and in ``kept`` the bad keys found
    then (``Snapshot.keys``), which spares their shuffle.
    """
    tables, kept = tables or {}, kept or {}
    rules = dedupe_rules(rules)
    if failed is None:
        failed = [m.rule for m in measure(df, rules, tables) if not m.success]
    failed_ids = {r.rule_id for r in failed}
    blamed = [r for r in rules if r.rule_id in failed_ids and r.level in ("row", "key")]
    statistics = column_statistics(df, blamed)

    flagged, parts = df, []
    for i, rule in enumerate(blamed):
        if rule.level == "row" and not needs_reference(rule):
            condition = row_check(rule, df.schema, statistics).violation
        else:
            flag = f"__flag{i}"
            bad = kept[rule.rule_id] if rule.rule_id in kept else bad_keys(df, rule, tables)
            flagged = flag_by_keys(flagged, rule.columns, bad, flag, max_broadcast_bytes)
            condition = F.col(flag)
        parts.append(F.when(condition, F.lit(getattr(rule, label))))
    listed = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return flagged.select(*[col(c) for c in df.columns], listed.alias(reasons))


def violations(df: DataFrame, rule: Rule, tables: Tables | None = None) -> DataFrame:
    """The rows one rule flags."""
    flagged = attribute(df, [rule], [rule], tables)
    return flagged.filter(F.size(REASONS) > 0).drop(REASONS)


def failing_keys(flagged: DataFrame, primary_key: Sequence[str], reasons: str = REASONS) -> DataFrame:
    """Distinct keys of the rows with any reason."""
    return flagged.filter(F.size(reasons) > 0).select(*[col(k) for k in primary_key]).distinct()


def reason_counts(flagged: DataFrame, reasons: str = REASONS) -> DataFrame:
    """Rows per reason."""
    return (
        flagged.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("row_count"))
    )


def reason_rollup(flagged: DataFrame, reasons: str = REASONS) -> DataFrame:
    """Reasons per column and rule with subtotals; null marks a total."""
    exploded = flagged.select(F.explode(reasons).alias("reason"))
    parts = F.regexp_extract("reason", r"^(.*?) on '(.*)'$", 1), F.regexp_extract("reason", r"^(.*?) on '(.*)'$", 2)
    named = exploded.select(
        F.when(parts[0] == "", F.col("reason")).otherwise(parts[0]).alias("rule"), parts[1].alias("column")
    )
    return named.rollup("column", "rule").agg(F.count(F.lit(1)).alias("row_count"))


def split(flagged: DataFrame, reasons: str = REASONS) -> tuple[DataFrame, DataFrame]:
    """Clean rows and rows to quarantine: disjoint, and together the input."""
    return (
        flagged.filter(F.size(reasons) == 0).drop(reasons),
        flagged.filter(F.size(reasons) > 0),
    )


def quarantine(flagged: DataFrame, reasons: str = REASONS) -> DataFrame:
    """Rows to quarantine with their reasons as one text column."""
    rows = split(flagged, reasons)[1]
    return rows.select(*[col(c) for c in rows.columns if c != reasons], F.concat_ws("; ", reasons).alias("Reason"))

