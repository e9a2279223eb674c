"""Flag rows through a table of keys without shuffling wide rows where that can be avoided.

Used for every rule that judges a row by its key group (uniqueness, references). The table of
bad keys is narrow: one row per key. Three regimes, picked from its measured size:

* nothing bad: a constant, no join;
* small: broadcast, the wide rows do not move;
* large: keys heavy enough to unbalance a shuffle are few by arithmetic (each holds at least
  one ``HOT_KEY_SHARE``-th of all rows) and are settled by a broadcast; the others are joined by
  a shuffle in which settled rows and null keys are spread by their input partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.functions.typed import all_of, any_of, col
from tablecare.operators.sizing import MAX_BROADCAST_BYTES, ROW_OVERHEAD_BYTES, durable, payload_bytes

HOT_KEY_SHARE = 2000


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key. The count is combined before the shuffle, so a hot key costs one row per task."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))


def keys_present(keys: Sequence[str]):
    return all_of([col(k).isNotNull() for k in keys])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count. Null keys are no duplicates."""
    return key_counts(df.filter(keys_present(keys)), keys).filter(F.col("__n") > 1)


def orphan_keys(df: DataFrame, keys: Sequence[str], ref: DataFrame, ref_columns: Sequence[str]) -> DataFrame:
    """Keys without a partner in ``ref``, with their row count.

    The table is reduced to one row per key before it meets the reference, so the join carries
    no skew from it.
    """
    known = ref.select(*[col(c).alias(f"__r{i}") for i, c in enumerate(ref_columns)]).distinct()
    on = all_of([col(k) == F.col(f"__r{i}") for i, k in enumerate(keys)])
    return key_counts(df.filter(keys_present(keys)), keys).join(known, on, "left_anti")


@dataclass(frozen=True)
class BadKeys:
    """A written table of keys (``keys`` + ``__n``): how many, how many rows hold them, their width."""

    frame: DataFrame
    keys: int
    rows: int
    payload: int


def kept_keys(bad: DataFrame, keys: Sequence[str]) -> BadKeys:
    """Write a table of keys once, so that everyone who asks for it later reads it."""
    saved = durable(bad, "keys")
    size = saved.agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(payload_bytes(*keys)), F.lit(0)).alias("payload"),
    ).first()
    return BadKeys(saved, size["keys"], size["rows"], size["payload"])


def broadcastable(size: BadKeys, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    return size.keys * ROW_OVERHEAD_BYTES + size.payload <= max_broadcast_bytes


def flag_by_keys(
    df: DataFrame,
    keys: Sequence[str],
    bad: DataFrame | BadKeys,
    flag: str,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add a Boolean column: does the row's key appear in ``bad`` (``keys`` + ``__n``)?"""
    size = bad if isinstance(bad, BadKeys) else kept_keys(bad, keys)
    saved = size.frame
    if size.keys == 0:
        return df.withColumn(flag, F.lit(False))

    renamed = [col(k).alias(f"__b{i}") for i, k in enumerate(keys)]
    on = all_of([col(k) == F.col(f"__b{i}") for i, k in enumerate(keys)])
    if broadcastable(size, max_broadcast_bytes):
        small = F.broadcast(saved.select(*renamed, F.lit(True).alias("__hit")))
        return df.join(small, on, "left").select(
            *[col(c) for c in df.columns], F.coalesce("__hit", F.lit(False)).alias(flag)
        )

    return _flag_by_shuffle(df, keys, saved, flag)


def heavy_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that hold at least one ``HOT_KEY_SHARE``-th of all rows; there are at most that many."""
    rows = df.agg(F.count(F.lit(1))).first()[0]
    return key_counts(df.filter(keys_present(keys)), keys).filter(F.col("__n") >= max(2, -(-rows // HOT_KEY_SHARE)))


def _flag_by_shuffle(df: DataFrame, keys: Sequence[str], bad: DataFrame, flag: str) -> DataFrame:
    width = range(len(keys))
    # Heavy keys are settled by a broadcast whether they are bad or not: a good key that fills a
    # third of the table would unbalance the shuffle just as much.
    heavy = durable(heavy_keys(df, keys), "heavy").select(*[col(k).alias(f"__b{i}") for i, k in enumerate(keys)])
    on = all_of([col(k) == F.col(f"__b{i}") for i, k in enumerate(keys)])
    heavy_bad = durable(bad.join(F.broadcast(heavy), on, "left_semi"), "heavy-bad").select(
        *[col(k).alias(f"__h{i}") for i, k in enumerate(keys)], F.lit(True).alias("__known_bad")
    )
    same = all_of([F.col(f"__b{i}") == F.col(f"__h{i}") for i in width])
    hot = heavy.join(F.broadcast(heavy_bad), same, "left").select(
        *[F.col(f"__b{i}") for i in width], F.coalesce("__known_bad", F.lit(False)).alias("__hot")
    )
    settled = F.col("__hot").isNotNull() | any_of([col(k).isNull() for k in keys])
    routed = df.join(F.broadcast(hot), on, "left").select(
        *[col(c) for c in df.columns],
        "__hot",
        *[F.when(~settled, col(k)).alias(f"__j{i}") for i, k in enumerate(keys)],
        # Settled rows match nothing below; the number of their input partition spreads them.
        F.when(settled, F.spark_partition_id() + 1).otherwise(0).alias("__salt"),
    )
    cold = bad.select(
        *[col(k).alias(f"__c{i}") for i, k in enumerate(keys)],
        # Always 0, but not a constant the optimizer could fold out of the join key.
        F.least(F.col("__n"), F.lit(0)).cast("int").alias("__csalt"),
        F.lit(True).alias("__cold"),
    )
    meet = all_of([F.col(f"__j{i}") == F.col(f"__c{i}") for i in width]) & (F.col("__salt") == F.col("__csalt"))
    return routed.join(cold, meet, "left").select(
        *[col(c) for c in df.columns], F.coalesce("__hot", "__cold", F.lit(False)).alias(flag)
    )
