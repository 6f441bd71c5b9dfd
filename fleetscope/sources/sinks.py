"""Sinks: fact tables laid out for pruning, and versioned table writes.

Facts are written partitioned by (snapshot type, snapshot date) and sorted by
(instance, time) inside each file, so time-range and type filters prune
directories and row groups. Maintained tables (dimensions, retained headers)
are written as a new version directory and then read from the newest complete
version: a job that dies half-way leaves the previous version intact, and a
re-run simply writes the version again.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeops import trunc_ntz

_SUCCESS = "_SUCCESS"


def write_facts(df: DataFrame, path: str, time: str = "snapshot_time", type_col: str = "snapshot_type_id",
                instance: str = "sql_instance", mode: str = "append") -> None:
    """Append facts under ``path`` partitioned by type and date, clustered by instance and time.

    The rebalance brings the rows of a directory together and lets the planner
    split a directory that is large (one type and day of the whole fleet) over
    several tasks, each of which writes a file of it.
    """
    out = df.withColumn("snapshot_date", F.to_date(trunc_ntz("day", time)))
    (out.hint("rebalance", F.col(type_col), F.col("snapshot_date"))
        .sortWithinPartitions(instance, time)
        .write.mode(mode).partitionBy(type_col, "snapshot_date").parquet(path))


def write_version(df: DataFrame, base: str, version: str | None = None) -> str:
    """Write ``df`` as a new version under ``base`` and return its path."""
    version = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = os.path.join(base, f"v={version}")
    df.write.mode("overwrite").parquet(path)
    return path


def latest_version(spark: SparkSession, base: str) -> DataFrame:
    """Read the newest complete version under ``base`` (one with a success marker)."""
    jvm = spark._jvm  # Hadoop FileSystem listing works for any cluster file system
    hpath = jvm.org.apache.hadoop.fs.Path(base)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(st.getPath().getName() for st in fs.listStatus(hpath)
                      if st.isDirectory() and st.getPath().getName().startswith("v=")
                      and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), _SUCCESS)))
    if not versions:
        raise FileNotFoundError(f"no complete version under {base}")
    return spark.read.parquet(os.path.join(base, versions[-1]))
