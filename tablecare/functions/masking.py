"""Structural masking: letters and digits are hidden, the shape of the text stays visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.spec import PII_NAME_HINTS


def mask_structural(column: Column) -> Column:
    """Every ASCII letter and every decimal digit becomes ``x``; punctuation and length stay.

    A digit is first marked ``N`` and the letter pass then turns that marker into ``x`` as
    well, so one replacement over both classes gives the same text.
    """
    return F.regexp_replace(column, r"[A-Za-z\p{Nd}]", "x")


def pii_columns(schema: T.StructType, names: list[str] | None = None) -> list[str]:
    """Columns whose name hints at personal data."""
    return [n for n in (names or schema.names) if any(hint in n.lower() for hint in PII_NAME_HINTS)]


def mask_table(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Mask the hinted string columns, leave every other column untouched."""
    hinted = set(pii_columns(df.schema, names))
    return df.select(
        *[
            mask_structural(F.col(f"`{f.name}`")).alias(f.name)
            if f.name in hinted and isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
