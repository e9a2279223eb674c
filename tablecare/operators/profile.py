"""Column profiles: one short record per column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.typed import col, field_of, is_numeric, is_time
from tablecare.operators.quantiles import exact_quantiles, open_searches, search_quantiles, start_measures

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType(), False),
        T.StructField("dtype", T.StringType(), False),
        T.StructField("row_count", T.LongType(), False),
        T.StructField("null_count", T.LongType(), False),
        T.StructField("null_ratio", T.DoubleType(), False),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("min_num", T.DoubleType()),
        T.StructField("max_num", T.DoubleType()),
        T.StructField("mean_num", T.DoubleType()),
        T.StructField("median_num", T.DoubleType()),
        T.StructField("min_ts", T.StringType()),
        T.StructField("max_ts", T.StringType()),
        T.StructField("median_ts", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ColumnProfile:
    """Numbers as floats, times as ISO text in the session time zone."""

    column: str
    dtype: str
    row_count: int
    null_count: int
    null_ratio: float
    distinct_count: int | None = None
    min_num: float | None = None
    max_num: float | None = None
    mean_num: float | None = None
    median_num: float | None = None
    min_ts: str | None = None
    max_ts: str | None = None
    median_ts: str | None = None

    @property
    def median(self) -> float | str | None:
        return self.median_ts if self.median_ts is not None else self.median_num


def number(value: Column, data_type: T.DataType) -> Column:
    """A numeric column without NaN, which is a value but no number."""
    if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
        return F.when(~F.isnan(value), value)
    return value


def iso(value: Column) -> Column:
    """Time as ISO text, fraction only where there is one."""
    return F.replace(value.cast("string"), F.lit(" "), F.lit("T"))


def time_from_whole(value: int, data_type: T.DataType) -> Column:
    """Inverse of the bigint that ``exact_quantiles`` returns for time columns."""
    if isinstance(data_type, T.DateType):
        return F.date_from_unix_date(F.lit(value))
    return F.timestamp_micros(F.lit(value)).cast(data_type)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Exact number of distinct non-null values per column.

    One two-phase aggregate per column, united into a single job: every branch reads its own
    column only. A single aggregate over all of them would first copy each row once per column.
    """
    if not columns:
        return {}
    parts = [
        df.agg(F.count_distinct(col(name)).alias("n")).select(F.lit(name).alias("column"), "n") for name in columns
    ]
    return {r["column"]: r["n"] for r in reduce(DataFrame.unionAll, parts).collect()}


def profile_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    distinct: str = "exact",
    median: str = "exact",
) -> list[ColumnProfile]:
    """Profile the named columns (all by default).

    Counts, bounds and means come from one aggregate over one scan. ``distinct`` and ``median``
    are ``exact``, ``approx`` (folded into that same aggregate) or ``none``.
    """
    for mode in (distinct, median):
        if mode not in ("exact", "approx", "none"):
            raise ValueError(f"unknown profile mode '{mode}'")
    fields = [field_of(df.schema, name) for name in (columns if columns is not None else df.columns)]
    measures: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, field in enumerate(fields):
        value, data_type = col(field.name), field.dataType
        measures.append(F.count_if(value.isNull()).alias(f"null{i}"))
        if distinct == "approx" and _countable(data_type):
            measures.append(F.approx_count_distinct(value).alias(f"distinct{i}"))
        if is_numeric(data_type):
            clean = number(value, data_type)
            measures += [
                F.min(clean).cast("double").alias(f"min{i}"),
                F.max(clean).cast("double").alias(f"max{i}"),
                F.avg(clean).cast("double").alias(f"mean{i}"),
            ]
            if median == "approx":
                measures.append(F.percentile_approx(clean, 0.5).cast("double").alias(f"median{i}"))
        elif is_time(data_type):
            measures += [iso(F.min(value)).alias(f"min{i}"), iso(F.max(value)).alias(f"max{i}")]
            if median == "approx":
                measures.append(iso(F.percentile_approx(value, 0.5)).alias(f"median{i}"))
    ordered = [f.name for f in fields if is_numeric(f.dataType) or is_time(f.dataType)] if median == "exact" else []
    searches = open_searches(df.schema, ordered)
    row = df.agg(*measures, *start_measures(searches)).first().asDict()
    medians = median_texts(df, search_quantiles(df, searches, row))
    exact = distinct_counts(df, [f.name for f in fields if _countable(f.dataType)]) if distinct == "exact" else {}

    profiles = []
    for i, field in enumerate(fields):
        nulls = row[f"null{i}"]
        middle = medians.get(field.name, row.get(f"median{i}"))
        common = {
            "column": field.name,
            "dtype": field.dataType.simpleString(),
            "row_count": row["n"],
            "null_count": nulls,
            "null_ratio": nulls / row["n"] if row["n"] else 0.0,
            "distinct_count": exact.get(field.name, row.get(f"distinct{i}")),
        }
        if is_numeric(field.dataType):
            common |= {
                "min_num": row[f"min{i}"],
                "max_num": row[f"max{i}"],
                "mean_num": row[f"mean{i}"],
                "median_num": None if middle is None else float(middle),
            }
        elif is_time(field.dataType):
            common |= {"min_ts": row[f"min{i}"], "max_ts": row[f"max{i}"], "median_ts": middle}
        profiles.append(ColumnProfile(**common))
    return profiles


def _countable(data_type: T.DataType) -> bool:
    return not isinstance(data_type, (T.MapType, T.VariantType))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, Any]:
    """Median per column: a number, or ISO text for time columns."""
    return median_texts(df, exact_quantiles(df, columns))


def median_texts(df: DataFrame, raw: dict[str, Any]) -> dict[str, Any]:
    times = {c: v for c, v in raw.items() if v is not None and is_time(df.schema[c].dataType)}
    if not times:
        return raw
    texts = (
        df.sparkSession.range(1)
        .select(*[iso(time_from_whole(v, df.schema[c].dataType)).alias(c) for c, v in times.items()])
        .first()
    )
    return raw | {c: texts[c] for c in times}


def profile(
    df: DataFrame, columns: Sequence[str] | None = None, distinct: str = "exact", median: str = "exact"
) -> DataFrame:
    """``profile_columns`` as a DataFrame, one row per column."""
    return profiles_frame(df.sparkSession, profile_columns(df, columns, distinct, median))


def profiles_frame(spark: SparkSession, profiles: Sequence[ColumnProfile]) -> DataFrame:
    """Column profiles as rows; there is one per column of a table."""
    names = PROFILE_SCHEMA.names
    rows = [tuple(getattr(p, n) for n in names) for p in profiles]
    frame = spark.createDataFrame(rows, PROFILE_SCHEMA)
    return frame.select(
        *[F.col(n).cast("timestamp_ntz").alias(n) if n.endswith("_ts") else F.col(n) for n in names]
    )
