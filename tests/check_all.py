"""Run queries against their SQL from the command line: ``check_all.py sf_dir [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from __spark_entry__ import oracle_sql, queries
from tests.oracle import connect, difference

if __name__ == "__main__":
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            frame = fn(spark, sf_dir)
            problem = difference(frame, con, oracles[name]) if name in oracles else f"(no SQL) {frame.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None and not problem.startswith("(no SQL)")
        print(f"{time.time() - started:6.2f}s {name}: {problem or 'ok'}", flush=True)
    print("differences:", bad)
