"""Keys that earlier batches brought, as an append-only table partitioned by key hash."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.typed import col
from tablecare.operators.keyflags import flag_by_keys, key_counts, keys_present
from tablecare.operators.sizing import durable
from tablecare.operators.validate import REASONS
from tablecare.sources.sinks import empty_where_missing
from tablecare.spec import TableSpec

BUCKET, BATCH = "key_bucket", "batch_id"
COMMIT_SCHEMA = "batch_id string, new_keys bigint, at timestamp"
DEFAULT_BUCKETS = 256


class KeyLedger:
    """The distinct keys of all batches that went through.

    A key lies in the folder of its batch and of its hash bucket. A batch asks only for the buckets
    its own keys fall into, so what is read shrinks with the batch; buckets are fixed for a ledger's
    life. A batch is committed after it went through: its new keys are written, then one commit row.
    Committing a batch id again adds nothing, and a batch that is tried again never meets its own
    keys, since those of its id are left out when it asks. Keys with a null part are no keys.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, keys: T.StructType, buckets: int = DEFAULT_BUCKETS):
        taken = {BUCKET, BATCH} & set(keys.names)
        if taken:
            raise ValueError(f"a ledger cannot hold keys named {sorted(taken)}")
        self.spark, self.keys, self.buckets = spark, list(keys.names), buckets
        self.types = {f.name: f.dataType for f in keys.fields}
        self.path = f"{root.rstrip('/')}/key_ledger/{name}"
        fields = [T.StructField(f.name, f.dataType) for f in keys.fields]
        self.schema = T.StructType([*fields, T.StructField(BATCH, T.StringType()), T.StructField(BUCKET, T.IntegerType())])

    @classmethod
    def of(cls, spark: SparkSession, root: str, spec: TableSpec, buckets: int = DEFAULT_BUCKETS) -> KeyLedger:
        """The ledger of a table's primary key."""
        if spec.schema is None:
            raise ValueError("a key ledger needs a declared schema")
        return cls(spark, root, spec.name, T.StructType([spec.schema[k] for k in spec.primary_key]), buckets)

    @property
    def reason(self) -> str:
        return f"unique on '{', '.join(self.keys)}' across batches"

    def frame(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(f"{self.path}/keys")
        except AnalysisException as error:
            return empty_where_missing(self.spark, error, self.schema)

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.path}/commits")
        except AnalysisException as error:
            return empty_where_missing(self.spark, error, COMMIT_SCHEMA)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _counted(self, batch: DataFrame) -> DataFrame:
        """One row per key of a batch with its row count and bucket, written once."""
        typed = batch.select(*[col(k).cast(self.types[k]).alias(k) for k in self.keys])
        counted = key_counts(typed.filter(keys_present(self.keys)), self.keys)
        return durable(counted.withColumn(BUCKET, self._bucket()), "batch-keys")

    def before(self, batch_id: str, keys: DataFrame | None = None) -> DataFrame:
        """Keys of other batches; of the buckets alone that ``keys`` (with bucket) fall into, if given.

        At most one number per bucket reaches the driver, and the files of other buckets are not read.
        """
        others = self.frame().filter(F.col(BATCH) != F.lit(batch_id))
        if keys is None:
            return others
        touched = sorted(r[BUCKET] for r in keys.select(BUCKET).distinct().collect())
        return others if len(touched) == self.buckets else others.filter(F.col(BUCKET).isin(touched))

    def flag(self, batch: DataFrame, batch_id: str, flag: str = "repeated") -> DataFrame:
        """Mark the rows whose key an earlier batch brought, at any distance in time.

        The batch is reduced to one row per key before it meets the ledger, so a key that fills a
        third of the batch unbalances nothing.
        """
        counted = self._counted(batch)
        known = self.before(batch_id, counted).select(*[col(k) for k in self.keys]).distinct()
        seen = counted.join(known, self.keys, "left_semi").select(*[col(k) for k in self.keys], "__n")
        return flag_by_keys(batch, self.keys, seen, flag)

    def add_reason(self, flagged: DataFrame, batch_id: str, reasons: str = REASONS) -> DataFrame:
        """Rows with the ledger's reason behind their own where an earlier batch brought their key."""
        marked = self.flag(flagged, batch_id, "__repeated")
        more = F.when(F.col("__repeated"), F.array(F.lit(self.reason))).otherwise(F.array().cast("array<string>"))
        return marked.withColumn(reasons, F.concat(reasons, more)).drop("__repeated")

    def commit(self, batch: DataFrame, batch_id: str) -> int:
        """Add the batch's keys that are new; how many. A batch id that is committed adds nothing."""
        if not self.commits().filter(F.col(BATCH) == F.lit(batch_id)).isEmpty():
            return 0
        counted = self._counted(batch)
        known = self.before(batch_id, counted).select(*[col(k) for k in self.keys])
        new = counted.join(known, self.keys, "left_anti").withColumn(BATCH, F.lit(batch_id))
        # what an attempt that broke off left under this id is replaced, not added to
        new.select(*[col(k) for k in self.keys], BATCH, BUCKET).repartition(BUCKET).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(BATCH, BUCKET).parquet(f"{self.path}/keys")
        added = self.frame().filter(F.col(BATCH) == F.lit(batch_id)).count()
        row = self.spark.createDataFrame([(batch_id, added, datetime.now(timezone.utc))], COMMIT_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return added
