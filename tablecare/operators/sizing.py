"""Where intermediate results are kept, and when one may be broadcast.

Anything kept goes to a written table in the shared folder named by ``spark.checkpoint.dir``,
so losing executors costs no recomputation and no machine-local state is involved.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A frame is broadcast only when its measured size stays below this.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Cost of one hashed row beside its payload.
ROW_OVERHEAD_BYTES = 64

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where the master is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tablecare-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tablecare/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "frame") -> DataFrame:
    """Write a frame once and read it back: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def payload_bytes(*names: str):
    """Estimated width of the named columns, as text, for size checks."""
    parts = [F.coalesce(F.octet_length(F.col(f"`{n}`").cast("string")), F.lit(0)) for n in names]
    return sum(parts[1:], parts[0])
