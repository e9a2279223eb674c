"""Exact quantiles of many columns without sorting or shuffling them.

A quantile is narrowed down like a multi-way binary search. Each pass splits the value range
still in question into buckets, counts them with one grouped aggregate (combined before the
shuffle, at most ``buckets`` rows per column and task) and keeps the bucket that holds the
wanted rank, together with the smallest and largest value seen in it. It ends when that bucket
holds a single distinct value, however often that value occurs. Three passes resolve about
10^12 distinct values; each pass reads only the columns still open and, from the second on,
only the row groups whose statistics reach the open range.

A quantile sketch would need one pass, but a global sketch sends one sketch per task to a
single reducer, which is what breaks first with hundreds of thousands of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.typed import col, field_of, is_numeric, is_time
from tablecare.spec import RuleError

# Buckets per pass: about the square root of the rows in question, within these limits.
MIN_BUCKETS, MAX_BUCKETS = 1 << 12, 1 << 14


@dataclass
class _Search:
    column: str
    data_type: T.DataType
    size: int = 0  # values inside the open range
    rank: int = 0  # 1-based rank wanted inside the open range
    low: Any = None
    high: Any = None
    by_magnitude: bool = False  # split by order of magnitude in the next pass

    @property
    def whole(self) -> bool:
        return isinstance(self.data_type, T.IntegralType) or is_time(self.data_type)

    def number(self) -> Column:
        """The column as a number: bigint for integral and time types, double for the rest."""
        value = col(self.column)
        if isinstance(self.data_type, T.DateType):
            return F.unix_date(value).cast("bigint")
        if is_time(self.data_type):
            return F.unix_micros(value.cast("timestamp"))
        if isinstance(self.data_type, T.IntegralType):
            return value.cast("bigint")
        number = value.cast("double")
        return F.when(~F.isnan(number), number)

    def bucket(self, low: Any, high: Any) -> Column:
        """Number of the bucket a value falls into; never falls as the value grows."""
        number, count = self.number(), min(MAX_BUCKETS, max(MIN_BUCKETS, math.isqrt(self.size)))
        if low is None or low == high:
            inner = F.lit(1)
        elif self.whole and high - low < 1 << 62:
            # Whole numbers may lie closer together than doubles can tell apart.
            step = (high - low) // count + 1
            inner = F.floor((number - F.lit(low).cast("bigint")) / F.lit(step).cast("bigint"))
        elif self.by_magnitude:
            inner = F.coalesce(
                F.width_bucket(_magnitude(number), _magnitude(F.lit(low)), _magnitude(F.lit(high)), F.lit(count)),
                F.lit(1),
            )
        else:
            low, high = float(low), float(high)
            # Halved where the width of the range would be infinite otherwise.
            scale = 0.5 if math.isinf(high - low) else 1.0
            inner = F.width_bucket(
                number.cast("double") * scale, F.lit(low * scale), F.lit(high * scale), F.lit(count)
            )
        if self.whole:
            return inner.cast("bigint")
        infinite = F.lit(float("inf"))
        return (
            F.when(number == infinite, count + 2).when(number == -infinite, -1).otherwise(inner).cast("bigint")
        )

    def open_range(self) -> Column:
        # Compared in the column's own type, so the filter reaches the file statistics.
        if self.low is None:
            return col(self.column).isNotNull()
        return col(self.column).between(self._native(self.low), self._native(self.high))

    def _native(self, number: Any) -> Column:
        if isinstance(self.data_type, T.DateType):
            return F.date_from_unix_date(F.lit(int(number)))
        if is_time(self.data_type):
            return F.timestamp_micros(F.lit(int(number))).cast(self.data_type)
        if isinstance(self.data_type, T.IntegralType):
            return F.lit(int(number)).cast(self.data_type)
        return F.lit(float(number))


def open_searches(schema: T.StructType, columns: Sequence[str]) -> list[_Search]:
    """One search per column, to be started from one row of ``start_measures``."""
    searches = []
    for name in dict.fromkeys(columns):
        data_type = field_of(schema, name).dataType
        if not (is_numeric(data_type) or is_time(data_type)):
            raise RuleError(f"no quantile of '{name}' ({data_type.simpleString()})")
        searches.append(_Search(name, data_type))
    return searches


def start_measures(searches: Sequence[_Search]) -> list[Column]:
    """What a search has to know first, as aggregates that can join any other aggregate."""
    return [
        F.struct(
            F.count(s.number()).alias("n"), F.min(_finite(s)).alias("low"), F.max(_finite(s)).alias("high")
        ).alias(f"__start{i}")
        for i, s in enumerate(searches)
    ]


def exact_quantiles(df: DataFrame, columns: Sequence[str], q: float = 0.5) -> dict[str, Any]:
    """Smallest value with at least the share ``q`` of the non-null values at or below it.

    Returns a plain value per column: int or float for numbers, bigint microseconds (days for
    dates) for time columns, ``None`` where the column holds no value.
    """
    searches = open_searches(df.schema, columns)
    if not searches:
        return {}
    return search_quantiles(df, searches, df.agg(*start_measures(searches)).first(), q)


def search_quantiles(df: DataFrame, searches: Sequence[_Search], start: Row | dict, q: float = 0.5) -> dict[str, Any]:
    """Run searches whose ``start_measures`` are known."""
    found: dict[str, Any] = {s.column: None for s in searches}
    bounds, active = {}, []
    for i, search in enumerate(searches):
        row = start[f"__start{i}"]
        if row["n"]:
            search.size = row["n"]
            search.rank = min(row["n"], max(1, _ceil(q * row["n"])))
            bounds[search.column] = (row["low"], row["high"])
            active.append(search)
    while active:
        active = _narrow(df, active, bounds, found)
    return found


def _ceil(x: float) -> int:
    # 0.1 * 30 is 3.0000000000000004; ranks that close to a whole number mean that number.
    nearest = round(x)
    return nearest if abs(x - nearest) < 1e-9 * max(1.0, abs(x)) else -int(-x // 1)


def _magnitude(number: Column) -> Column:
    """Signed order of magnitude: grows with the number, 0 at 0, even for the smallest doubles."""
    size = F.abs(number.cast("double"))
    return F.when(size > 0, F.signum(number) * (F.log2(size) + 1100)).otherwise(0.0)


def _finite(search: _Search) -> Column:
    number = search.number()
    if search.whole:
        return number
    return F.when(F.abs(number) != F.lit(float("inf")), number)


def _narrow(df: DataFrame, active: list[_Search], bounds: dict, found: dict) -> list[_Search]:
    """One pass over all open columns; returns those that need another.

    Every column is a branch of its own, so a branch reads one column and its filter on the open
    range reaches the files.
    """
    branches = []
    for i, search in enumerate(active):
        low, high = ("w0", "w1") if search.whole else ("d0", "d1")
        kind, other = ("bigint", "double") if search.whole else ("double", "bigint")
        histogram = (
            df.filter(search.open_range())
            .select(search.number().alias("v"), search.bucket(*bounds[search.column]).alias("b"))
            .filter(F.col("v").isNotNull())
            .groupBy("b")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias(low), F.max("v").alias(high))
        )
        absent = [name for name in ("w0", "w1", "d0", "d1") if name not in (low, high)]
        branches.append(
            histogram.select(
                F.lit(i).alias("i"),
                "b",
                "n",
                *[F.col(name).cast(kind) for name in (low, high)],
                *[F.lit(None).cast(other).alias(name) for name in absent],
            ).select("i", "b", "n", "w0", "w1", "d0", "d1")
        )
    histograms = reduce(DataFrame.unionAll, branches)
    # At most ``MAX_BUCKETS`` + 4 short rows per column.
    rows = sorted(histograms.collect(), key=lambda r: (r["i"], r["b"]))
    still_open = []
    for i, search in enumerate(active):
        before = 0
        for row in (r for r in rows if r["i"] == i):
            if before + row["n"] >= search.rank:
                low, high = (row["w0"], row["w1"]) if search.whole else (row["d0"], row["d1"])
                if low == high:
                    found[search.column] = low
                else:
                    if (low, high) == bounds[search.column] and not search.by_magnitude:
                        raise RuntimeError(f"cannot split the range {low}..{high} of '{search.column}'")
                    search.rank -= before
                    # Equal steps achieve little where values span many orders of magnitude.
                    search.by_magnitude = not search.by_magnitude and 4 * row["n"] > search.size
                    search.size = row["n"]
                    search.low, search.high = low, high
                    bounds[search.column] = (low, high)
                    still_open.append(search)
                break
            before += row["n"]
    return still_open
