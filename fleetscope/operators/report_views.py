"""Report views of facts and dimensions: disk facts, process memory, agent jobs and
steps, indexes; and the application log's retention (K5).

A fact view joins samples to the snapshot header on (instance, type, time) and to its
dimensions on (instance, member). A hot instance is dealt over its snapshot times in the
first join; the dimensions are broadcast behind the size check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import star_join, with_header
from .timeseries import _ts
from .windows import series_previous

# Fixed value: days that the application log is kept.
APP_LOG_DAYS = 7


def fact_view(samples: DataFrame, header: DataFrame, dims: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Samples of registered snapshots and known members, with report time and member attributes."""
    return with_header(star_join(samples, dims), header)


def disk_database_facts(samples: DataFrame, header: DataFrame, databases: DataFrame) -> DataFrame:
    """Sizes of databases with the name of the database."""
    keys = ["sql_instance", "database_id"]
    return fact_view(samples, header, {"database": (databases.select(*keys, "database_name"), keys)})


def disk_volume_facts(samples: DataFrame, header: DataFrame, volumes: DataFrame) -> DataFrame:
    """Free and total space of volumes with the name of the volume."""
    keys = ["sql_instance", "volume_id"]
    return fact_view(samples, header, {"volume": (volumes.select(*keys, "volume_name"), keys)})


def disk_table_facts(samples: DataFrame, header: DataFrame, tables: DataFrame, databases: DataFrame,
                     measures: Sequence[str] = ("row_count", "total_pages", "used_pages")) -> DataFrame:
    """Sizes of tables with ``<measure>_delta`` against the table's previous snapshot (NULL at the first)
    and the names of table and database. Deltas are taken before members are looked up, so a table that
    joins no dimension changes no other."""
    keys = ["sql_instance", "database_id", "table_id"]
    with_prev = series_previous(samples, keys, "snapshot_time", list(measures), bucket="year")
    deltas = with_prev.select(*samples.columns, *[(F.col(m) - F.col(f"prev_{m}")).alias(f"{m}_delta") for m in measures])
    return fact_view(deltas, header, {
        "table": (tables.select(*keys, "table_name"), keys),
        "database": (databases.select(*keys[:2], "database_name", "database_create_date"), keys[:2])})


def process_memory_facts(samples: DataFrame, header: DataFrame) -> DataFrame:
    """Process memory samples of registered snapshots with their report time."""
    return with_header(samples, header)


def dim_agent_job(jobs: DataFrame) -> DataFrame:
    """Jobs that are not marked as deleted (an unset mark counts as not deleted)."""
    return jobs.filter(~F.coalesce(F.col("is_record_deleted"), F.lit(False)))


def app_log_retention(log: DataFrame, now, days: int = APP_LOG_DAYS, time: str = "event_time") -> DataFrame:
    """Log rows to keep (K5): a row goes when it is older than ``days``; rows without a time are kept."""
    return log.filter(~F.coalesce(F.col(time) < F.timestamp_add("DAY", F.lit(-days), _ts(now)), F.lit(False)))
