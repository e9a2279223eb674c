"""Declarations: the table, the rules that must hold on it, and the repairs allowed on it.

Everything here is plain driver-side data with a JSON form, so rules and repairs can be
stored as rows of a versioned table. Nothing in this module touches Spark data.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import types as T


class RuleError(ValueError):
    """A rule does not fit the table or carries wrong parameters."""


class FixError(ValueError):
    """A repair does not fit the table or carries wrong parameters."""


# The declared column types and their Spark types.
COLUMN_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
    "float": T.FloatType(),
    "short": T.ShortType(),
    "date": T.DateType(),
}

# Run defaults.
DEFAULT_SAMPLE_ROWS = 8
DEFAULT_TRIAL_ROWS = 500
DEFAULT_MAX_LOOPS = 5
MAX_CATEGORICAL_VALUES = 20
TIMESTAMP_BUFFER_DAYS = 3
EMAIL_REGEX = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PII_NAME_HINTS = ("email", "phone", "ssn", "address", "name")


def schema_of(columns: Iterable[tuple[str, str] | tuple[str, str, bool]]) -> T.StructType:
    """Build a schema from ``(name, type)`` or ``(name, type, nullable)`` declarations."""
    fields = []
    for name, kind, *rest in columns:
        if kind not in COLUMN_TYPES:
            raise ValueError(f"column '{name}': unknown type '{kind}', known: {sorted(COLUMN_TYPES)}")
        fields.append(T.StructField(name, COLUMN_TYPES[kind], rest[0] if rest else True))
    return T.StructType(fields)


@dataclass(frozen=True)
class RunOptions:
    """Defaults of one run; a ``TableSpec`` may override any of them."""

    fix_promotion: str = "auto"
    rule_promotion: str = "manual"
    loop_until_clean: bool = True
    max_loops: int = DEFAULT_MAX_LOOPS
    repair_not_drop: bool = False
    export_quarantined: bool = True
    max_sample_rows: int = DEFAULT_SAMPLE_ROWS
    mask_pii: bool = True
    # rows that no other repair settles are routed to a side table
    quarantine_failures: bool = False
    # how a run profiles the columns of failed rules: ``exact``, or ``approx`` within one scan
    profile_distinct: str = "exact"
    profile_median: str = "exact"

    def resolve(self, spec: TableSpec) -> RunOptions:
        unknown = set(spec.overrides) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown run options in spec '{spec.name}': {sorted(unknown)}")
        merged = replace(self, **spec.overrides)
        for mode in (merged.profile_distinct, merged.profile_median):
            if mode not in ("exact", "approx", "none"):
                raise ValueError(f"unknown profile mode '{mode}'")
        for mode in (merged.fix_promotion, merged.rule_promotion):
            if mode not in ("auto", "manual"):
                raise ValueError(f"promotion mode must be 'auto' or 'manual', not '{mode}'")
        return merged


@dataclass(frozen=True)
class TableSpec:
    """One data domain: where it lies, its schema, its key and what it may not lack."""

    name: str
    primary_key: tuple[str, ...]
    schema: T.StructType | None = None
    critical_columns: tuple[str, ...] = ()
    fmt: str = "csv"
    options: Mapping[str, str] = field(default_factory=lambda: {"header": "true"})
    baseline_path: str | None = None
    incoming_path: str | None = None
    overrides: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.primary_key, str):
            object.__setattr__(self, "primary_key", (self.primary_key,))
        if not self.primary_key:
            raise ValueError(f"spec '{self.name}' needs a primary key")
        if self.schema is not None:
            missing = (set(self.primary_key) | set(self.critical_columns)) - set(self.schema.names)
            if missing:
                raise ValueError(f"spec '{self.name}' names undeclared columns {sorted(missing)}")

    def fields(self, df_schema: T.StructType) -> list[T.StructField]:
        """Declared fields with the types the data really has; every field if none is declared."""
        names = self.schema.names if self.schema is not None else df_schema.names
        return [df_schema[name] for name in names]


def _plain(value: Any) -> Any:
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [_plain(v) for v in value]
    return value


def canonical_json(value: Any) -> str:
    return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class RuleKind:
    """How a rule is evaluated and which parameters it takes.

    ``level`` is one of ``row`` (a predicate per row), ``key`` (rows judged through their
    group), ``table`` (one number per table), ``group`` (one number over the distinct
    values) and ``schema`` (no data needed).
    """

    level: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    min_columns: int = 1
    max_columns: int | None = 1


_BOUNDS = ("min", "max")
RULE_KINDS: dict[str, RuleKind] = {
    "not_null": RuleKind("row"),
    "is_null": RuleKind("row"),
    "in_set": RuleKind("row", ("values",)),
    "not_in_set": RuleKind("row", ("values",)),
    "between": RuleKind("row", (), _BOUNDS),
    "matches": RuleKind("row", ("regex",)),
    "not_matches": RuleKind("row", ("regex",)),
    "matches_any": RuleKind("row", ("regexes",)),
    "like": RuleKind("row", ("pattern",)),
    "length_between": RuleKind("row", (), _BOUNDS),
    "castable": RuleKind("row", ("type",)),
    "where": RuleKind("row", ("predicate",), (), 0, None),
    "pair_greater": RuleKind("row", (), ("or_equal",), 2, 2),
    "pair_equal": RuleKind("row", (), (), 2, 2),
    "pair_in_set": RuleKind("row", ("values",), (), 2, 2),
    "sum_equals": RuleKind("row", ("total",), (), 1, None),
    "zscore_below": RuleKind("row", ("threshold",)),
    "unique": RuleKind("key", (), (), 1, None),
    "foreign_key": RuleKind("key", ("table", "ref_columns"), (), 1, None),
    "min_between": RuleKind("table", (), _BOUNDS),
    "max_between": RuleKind("table", (), _BOUNDS),
    "mean_between": RuleKind("table", (), _BOUNDS),
    "sum_between": RuleKind("table", (), _BOUNDS),
    "stddev_between": RuleKind("table", (), _BOUNDS),
    "median_between": RuleKind("table", (), _BOUNDS),
    "quantile_between": RuleKind("table", ("q",), _BOUNDS),
    "null_ratio_between": RuleKind("table", (), _BOUNDS),
    "row_count_between": RuleKind("table", (), _BOUNDS, 0, 0),
    "row_count_equals": RuleKind("table", ("table",), (), 0, 0),
    "distinct_count_between": RuleKind("group", (), (*_BOUNDS, "approximate")),
    "unique_ratio_between": RuleKind("group", (), _BOUNDS),
    "distinct_in_set": RuleKind("group", ("values",)),
    "distinct_equal_set": RuleKind("group", ("values",)),
    "distinct_contain_set": RuleKind("group", ("values",)),
    "most_common_in_set": RuleKind("group", ("values",)),
    "columns_exist": RuleKind("schema", (), (), 1, None),
    "columns_match_ordered": RuleKind("schema", (), (), 1, None),
    "columns_match_set": RuleKind("schema", (), (), 1, None),
}


@dataclass(frozen=True, eq=False)
class Rule:
    """One statement about a table. Equality and identity follow kind, columns and parameters."""

    kind: str
    columns: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    mostly: float = 1.0

    def __post_init__(self):
        if isinstance(self.columns, str):
            object.__setattr__(self, "columns", (self.columns,))
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "params", {k: v for k, v in self.params.items() if v is not None})
        info = RULE_KINDS.get(self.kind)
        if info is None:
            raise RuleError(f"unknown rule '{self.kind}'")
        missing = [p for p in info.required if p not in self.params]
        extra = [p for p in self.params if p not in info.required + info.optional]
        if missing or extra:
            raise RuleError(f"rule '{self.kind}': missing parameters {missing}, unknown parameters {extra}")
        if "min" in info.optional and not {"min", "max"} & set(self.params):
            raise RuleError(f"rule '{self.kind}' needs at least one of min and max")
        if len(self.columns) < info.min_columns or (
            info.max_columns is not None and len(self.columns) > info.max_columns
        ):
            raise RuleError(f"rule '{self.kind}' does not take columns {self.columns}")
        if not 0.0 <= self.mostly <= 1.0:
            raise RuleError(f"mostly must lie in 0..1, got {self.mostly}")

    @property
    def level(self) -> str:
        return RULE_KINDS[self.kind].level

    @property
    def column(self) -> str:
        return ", ".join(self.columns)

    @property
    def params_json(self) -> str:
        body = dict(self.params)
        if self.mostly != 1.0:
            body["mostly"] = self.mostly
        return canonical_json(body)

    @property
    def rule_id(self) -> str:
        digest = hashlib.sha256(canonical_json([self.kind, self.columns, self.params_json]).encode()).hexdigest()
        return f"{self.kind}:{'+'.join(self.columns) or '*'}:{digest[:10]}"

    @property
    def reason(self) -> str:
        return f"{self.kind} on '{self.column}'" if self.columns else self.kind

    def __eq__(self, other):
        return isinstance(other, Rule) and self.rule_id == other.rule_id

    def __hash__(self):
        return hash(self.rule_id)

    @classmethod
    def load(cls, kind: str, column: str, params_json: str) -> Rule:
        """Inverse of the stored form (``kind``, ``column``, ``params_json``)."""
        params = json.loads(params_json or "{}")
        mostly = float(params.pop("mostly", 1.0))
        return cls(kind, tuple(c.strip() for c in column.split(",") if c.strip()), params, mostly)


def dedupe_rules(rules: Sequence[Rule]) -> list[Rule]:
    """First occurrence of every rule, in order."""
    return list(dict.fromkeys(rules))


# -- rule constructors ---------------------------------------------------------------------


def not_null(column: str, mostly: float = 1.0) -> Rule:
    return Rule("not_null", (column,), {}, mostly)


def unique(*columns: str, mostly: float = 1.0) -> Rule:
    return Rule("unique", columns, {}, mostly)


def in_set(column: str, values: Sequence[Any], mostly: float = 1.0) -> Rule:
    return Rule("in_set", (column,), {"values": list(values)}, mostly)


def between(column: str, min: Any = None, max: Any = None, mostly: float = 1.0) -> Rule:  # noqa: A002
    return Rule("between", (column,), {"min": min, "max": max}, mostly)


def matches(column: str, regex: str, mostly: float = 1.0) -> Rule:
    return Rule("matches", (column,), {"regex": regex}, mostly)


def length_between(column: str, min: int | None = None, max: int | None = None, mostly: float = 1.0) -> Rule:  # noqa: A002
    return Rule("length_between", (column,), {"min": min, "max": max}, mostly)


def where(predicate: str, *columns: str, mostly: float = 1.0) -> Rule:
    """Every row must satisfy a SQL predicate; rows where it is null are skipped."""
    return Rule("where", columns, {"predicate": predicate}, mostly)


def foreign_key(columns: str | Sequence[str], table: str, ref_columns: str | Sequence[str], mostly: float = 1.0) -> Rule:
    cols = (columns,) if isinstance(columns, str) else tuple(columns)
    refs = [ref_columns] if isinstance(ref_columns, str) else list(ref_columns)
    if len(cols) != len(refs):
        raise RuleError("foreign_key needs as many reference columns as columns")
    return Rule("foreign_key", cols, {"table": table, "ref_columns": refs}, mostly)


# -- repairs -------------------------------------------------------------------------------

# Fix action -> (required parameters, may drop rows)
FIX_ACTIONS: dict[str, tuple[tuple[str, ...], bool]] = {
    "impute_median": (("min", "max", "median"), False),
    "fill_null": (("value",), False),
    "replace_where": (("value",), False),
    "null_out": ((), False),
    "drop_where": ((), True),
    "quarantine_where": ((), True),
    "regex_replace": (("pattern", "replacement"), False),
    "trim": ((), False),
    "lower": ((), False),
    "upper": ((), False),
    "keep_first": (("key", "order"), True),
    "clamp": ((), False),
    "map_values": (("mapping",), False),
    "custom": (("name",), True),
}


@dataclass(frozen=True, eq=False)
class Fix:
    """One declarative repair: an action, a target column and parameters, never code.

    ``replace_where``, ``null_out``, ``drop_where`` and ``quarantine_where`` take a SQL
    ``predicate`` or a stored ``rule`` whose violation is the predicate. ``quarantine_where`` has two
    outputs: the rows kept, and the rows routed to a side table under the fix's id.
    """

    action: str
    column: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)
    description: str = ""

    def __post_init__(self):
        if self.action not in FIX_ACTIONS:
            raise FixError(f"unknown fix action '{self.action}'")
        required, _ = FIX_ACTIONS[self.action]
        missing = [p for p in required if p not in self.params]
        if missing:
            raise FixError(f"fix '{self.action}' lacks parameters {missing}")
        located = ("replace_where", "null_out", "drop_where", "quarantine_where")
        if self.action in located and not {"predicate", "rule"} & set(self.params):
            raise FixError(f"fix '{self.action}' needs a predicate or a rule")
        if self.action == "clamp" and not {"min", "max"} & set(self.params):
            raise FixError("fix 'clamp' needs min or max")
        if self.column is None and self.action not in ("drop_where", "quarantine_where", "keep_first", "custom"):
            raise FixError(f"fix '{self.action}' needs a target column")

    @property
    def may_drop_rows(self) -> bool:
        return FIX_ACTIONS[self.action][1]

    @property
    def params_json(self) -> str:
        return canonical_json(self.params)

    @property
    def fix_id(self) -> str:
        digest = hashlib.sha256(canonical_json([self.action, self.column, self.params_json]).encode()).hexdigest()
        return f"{self.action}:{self.column or '*'}:{digest[:10]}"

    def __eq__(self, other):
        return isinstance(other, Fix) and self.fix_id == other.fix_id

    def __hash__(self):
        return hash(self.fix_id)

    @classmethod
    def load(cls, action: str, column: str | None, params_json: str, description: str = "") -> Fix:
        return cls(action, column or None, json.loads(params_json or "{}"), description or "")


def rule_param(rule: Rule) -> dict[str, str]:
    """A rule in the form a ``Fix`` carries it."""
    return {"kind": rule.kind, "column": rule.column, "params": rule.params_json}
