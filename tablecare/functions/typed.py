"""Columns and comparison values typed after the column they are compared with."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.spec import RuleError

TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def field_of(schema: T.StructType, name: str) -> T.StructField:
    try:
        return schema[name]
    except KeyError:
        raise RuleError(f"no column '{name}', the table has {schema.names}") from None


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_time(data_type: T.DataType) -> bool:
    return isinstance(data_type, TIME_TYPES)


def typed_literal(value: Any, data_type: T.DataType) -> Column:
    """A constant of the column's type; ISO text becomes a timestamp on time columns."""
    if is_time(data_type):
        text = value.isoformat() if isinstance(value, (datetime, date)) else str(value)
        return F.lit(text).cast(data_type)
    if is_numeric(data_type):
        if isinstance(value, str):
            try:
                value = Decimal(value) if isinstance(data_type, T.DecimalType) else float(value)
            except (ValueError, ArithmeticError):
                raise RuleError(f"'{value}' is no {data_type.simpleString()}") from None
        return F.lit(value)
    return F.lit(value)


def replacement(value: Any, data_type: T.DataType, up: bool | None = None) -> Column:
    """A value to write into a column, in that column's type.

    Typed before it meets the column: next to a wider constant the whole column would be computed
    in the wider type, and large numbers that nobody meant to touch would be rounded. A fraction
    for a whole-number column is cut; ``up`` rounds it up or down instead, as bounds need.
    """
    if isinstance(data_type, T.IntegralType) and isinstance(value, (int, float, Decimal, str)):
        number = Decimal(str(value))
        if up is not None and number.is_finite():
            number = number.to_integral_value(ROUND_CEILING if up else ROUND_FLOOR)
        if number.is_finite():
            return F.lit(int(number)).cast(data_type)
    if isinstance(data_type, T.DecimalType) and isinstance(value, (int, float, Decimal, str)):
        return F.lit(format(Decimal(str(value)), "f")).cast(data_type)
    return typed_literal(value, data_type).cast(data_type)


def listed_values(values: Sequence[Any], data_type: T.DataType) -> tuple[list[Any], T.DataType]:
    """The values of a set rule without nulls, and the type in which they meet the column.

    Fractions meet whole numbers as doubles, so a list compares alike inline and as a table.
    """
    known = [v for v in values if v is not None]
    if is_time(data_type):
        return [v.isoformat() if isinstance(v, (datetime, date)) else v for v in known], data_type
    if is_numeric(data_type):
        exact = all(isinstance(v, (int, Decimal)) or (isinstance(v, float) and v.is_integer()) for v in known)
        if isinstance(data_type, T.DecimalType) and all(isinstance(v, (int, Decimal, str)) for v in known):
            return [format(Decimal(str(v)), "f") for v in known], T.DecimalType(38, data_type.scale)
        if isinstance(data_type, T.IntegralType) and exact and all(Decimal(v) == int(v) and abs(v) < 2**63 for v in known):
            return [int(v) for v in known], T.LongType()
        try:
            return [float(v) for v in known], T.DoubleType()
        except (ValueError, TypeError):
            raise RuleError(f"not all of {known[:5]} are numbers") from None
    return known, data_type


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def within(value: Column, low: Any | None, high: Any | None) -> Column:
    """Inclusive range test where either side may be open."""
    tests = []
    if low is not None:
        tests.append(value >= F.lit(low))
    if high is not None:
        tests.append(value <= F.lit(high))
    return all_of(tests)


def sql_text(value: str) -> str:
    """A string constant in SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(value: float) -> str:
    """A double constant in SQL, infinities and NaN included."""
    return f"double('{float(value)!r}')"


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
