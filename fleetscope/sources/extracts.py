"""The shipped extracts (S11): a catalogue, a stored watermark for each extract, and a sink that is idempotent per window.

A run writes the rows of (last run, now] to the folder of its window, then acknowledges the window by a version of the
extract's window table. Readers see acknowledged windows only. A run that dies in between is repeated: its window
begins at the same watermark, and whatever it left is not acknowledged. A run up to a time that is
acknowledged writes nothing. Extracts without a time are whole relations, written anew on each run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import extract
from .sinks import write_version

_STAMP = "%Y%m%dT%H%M%S%f"
FIRST_RUN = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Extract:
    name: str
    columns: tuple[str, ...]  # none: all columns of the view
    time: str | None = "snapshot_time"


# The seven shipped extracts with their columns.
EXTRACTS = (
    Extract("performance_counters", ("sql_instance", "object_name", "counter_name", "instance_name", "cntr_value_calculated", "snapshot_time")),
    Extract("os_volume", (), None),
    Extract("checks", ("sql_instance", "snapshot_time", "check_name", "check_value", "check_status", "status_change")),
    Extract("file_stats", (
        "database_name", "file_name", "file_type_desc", "file_physical_name", "size_on_disk_bytes", "sql_instance", "num_of_reads_delta",
        "num_of_bytes_read_delta", "io_stall_read_ms_delta", "num_of_writes_delta", "num_of_bytes_written_delta", "io_stall_write_ms_delta",
        "size_on_disk_bytes_delta", "io_latency_read", "io_latency_write", "bytes_written_per_second", "bytes_read_per_second", "snapshot_time")),
    Extract("wait_stats", ("sql_instance", "wait_type", "waiting_tasks_count_delta", "wait_time_ms_delta", "max_wait_time_ms_delta",
                           "signal_wait_time_ms_delta", "wait_category", "snapshot_time")),
    Extract("instance", ("sql_instance", "service_name", "local_net_address", "local_tcp_port", "utc_offset_minutes", "sql_version"), None),
    Extract("agent_history", ("sql_instance", "job_name", "step_name", "run_duration_s", "run_date", "run_status_desc", "end_date", "snapshot_time"), "run_date"),
)
CATALOGUE = {e.name: e for e in EXTRACTS}


def windows(spark: SparkSession, base: str, name: str) -> list[tuple[dt.datetime, dt.datetime]]:
    """The acknowledged windows of an extract, oldest first."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{base}/_windows/{name}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    done = sorted(st.getPath().toString() for st in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))
    if not done:
        return []
    rows = spark.read.parquet(*done).collect()  # one row for each run
    return sorted((r.window_from, r.window_to) for r in rows)


def run_extract(view: DataFrame, definition: Extract, base: str, now: dt.datetime) -> tuple[dt.datetime, dt.datetime] | None:
    """Write the rows of ``view`` since the last run; returns the window, or None if ``now`` is not after the last one."""
    spark = view.sparkSession
    known = windows(spark, base, definition.name)
    last = known[-1][1] if known else FIRST_RUN
    if now <= last:
        return None
    rows = extract(view, definition.time, last, now) if definition.time else view
    rows = rows.select(*definition.columns) if definition.columns else rows
    rows.write.mode("overwrite").parquet(f"{base}/{definition.name}/window={now.strftime(_STAMP)}")
    done = spark.createDataFrame([(last, now)], "window_from timestamp_ntz, window_to timestamp_ntz")
    write_version(done.coalesce(1), f"{base}/_windows/{definition.name}", now.strftime(_STAMP))
    return last, now


def run_extracts(views: Mapping[str, Callable[[], DataFrame]], base: str, now: dt.datetime) -> dict[str, tuple[dt.datetime, dt.datetime] | None]:
    """Run the extracts of the catalogue whose views are given."""
    return {name: run_extract(views[name](), CATALOGUE[name], base, now) for name in CATALOGUE if name in views}


def read_extract(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of all acknowledged windows (of a whole relation: of the last one)."""
    known = windows(spark, base, name)
    if not known:
        raise FileNotFoundError(f"no window of {name} under {base}")
    own = known if CATALOGUE[name].time else known[-1:]
    parts = [f"{base}/{name}/window={to.strftime(_STAMP)}" for _, to in own]
    return spark.read.parquet(*parts).withColumn("_extract", F.lit(name)).drop("_extract", "window")
