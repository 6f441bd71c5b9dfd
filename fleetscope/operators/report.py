"""Report-star compositions: server dimension, app version, replica
states, missing-index facts, queue and error-log counts, failed-job report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import enums
from ..functions.scalars import parsename
from .joins import broadcast_if_small


def active_instances(df: DataFrame, config: DataFrame, local_instance: str, key: str = "sql_instance") -> DataFrame:
    """Rows of the local instance, and of remote instances whose collector is active."""
    c = broadcast_if_small(config.select(key, "repo_collector_is_active"))
    j = df.join(c, key, "inner")
    return j.filter((F.col(key) == local_instance) | F.col("repo_collector_is_active")).drop("repo_collector_is_active")


def dim_server(servers: DataFrame, config: DataFrame, local_instance: str) -> DataFrame:
    """Server dimension joined with its configuration, inactive remotes dropped (dim_server, J2 + F14)."""
    c = config.select("sql_instance", "environment", "sql_instance_user_alias", "repo_collector_is_active")
    j = servers.join(broadcast_if_small(c), "sql_instance")
    active = F.when(F.col("sql_instance") != local_instance, True).otherwise(False) == F.col("repo_collector_is_active")
    return j.filter(active).drop("repo_collector_is_active")


def app_version(versions: DataFrame) -> DataFrame:
    """The latest installed version with its dotted parts (A14 + parsename)."""
    latest = versions.agg(F.max_by(F.struct(*versions.columns), F.col("install_sequence")).alias("_v"))
    v = latest.select("_v.*")
    return v.select("*", parsename("version", 4).alias("major"), parsename("version", 3).alias("minor"),
                    parsename("version", 2).alias("patch"), parsename("version", 1).alias("build"))


def replica_states(samples: DataFrame) -> DataFrame:
    """Replica-state samples with every state code decoded."""
    dec = enums.decode_or_code
    return samples.select(
        "*",
        dec("availability_mode", enums.AVAILABILITY_MODE).alias("availability_mode_desc"),
        dec("failover_mode", enums.FAILOVER_MODE).alias("failover_mode_desc"),
        dec("synchronization_state", enums.SYNC_STATE).alias("synchronization_state_desc"),
        dec("synchronization_health", enums.SYNC_HEALTH).alias("synchronization_health_desc"),
        dec("database_state", enums.DATABASE_STATE).alias("database_state_desc"),
        dec("suspend_reason", enums.SUSPEND_REASON).alias("suspend_reason_desc"))


def _unbracket(c):
    return F.regexp_replace(c, r"^\[|\]$", "")


def missing_index_facts(samples: DataFrame, databases: DataFrame, tables: DataFrame,
                        statement_col: str = "statement") -> DataFrame:
    """Missing-index samples joined to database and table dimensions through the
    dotted object name '[db].[schema].[table]' (M18, J2)."""
    s = samples.select("*", _unbracket(parsename(statement_col, 3)).alias("database_name"),
                       F.concat(_unbracket(parsename(statement_col, 2)), F.lit("."),
                                _unbracket(parsename(statement_col, 1))).alias("table_name"))
    return s.join(databases, "database_name").join(tables, ["database_name", "table_name"])


def status_count(df: DataFrame, keys: Sequence[str], status_col: str = "exec_status") -> DataFrame:
    """Row count per status."""
    return df.groupBy(*keys, status_col).agg(F.count(F.lit(1)).alias("items"))


def errorlog_counts(lines: DataFrame) -> DataFrame:
    """Records per (log time, attribute, text, keyword)."""
    return lines.groupBy("log_date", "attribute_value", "text", "keyword_id").agg(
        F.count(F.lit(1)).alias("record_count"))


def failed_jobs(history: DataFrame, since) -> DataFrame:
    """Failed runs per job since ``since`` with the failed steps in order."""
    from .timeseries import _ts

    f = history.filter((F.col("run_status") == 0) & (F.col("run_start_utc") > _ts(since)))
    return f.groupBy("job_id", "job_name").agg(
        F.count(F.lit(1)).alias("failures"), F.max("run_start_utc").alias("last_failure"),
        F.array_join(F.array_sort(F.collect_set(F.col("step_id").cast("string"))), ",").alias("failed_steps"))


def sys_databases(databases: DataFrame, replicas: DataFrame) -> DataFrame:
    """Databases worth collecting from: online, not snapshots, and if part of an availability
    group either the primary or a readable secondary (report-star ``sys_databases``)."""
    r = replicas.select("replica_id", "role_desc", "secondary_role_allow_connections_desc")
    j = databases.join(broadcast_if_small(r), "replica_id", "left")
    role_ok = (F.col("role_desc").isNull() | (F.col("role_desc") == "PRIMARY")
               | ((F.col("role_desc") == "SECONDARY")
                  & F.col("secondary_role_allow_connections_desc").isin("READ_ONLY", "ALL")))
    keep = (F.col("state_desc") == "ONLINE") & role_ok & F.col("source_database_id").isNull()
    return j.filter(keep).select(*databases.columns)


def table_sizes(partitions: DataFrame, keys: Sequence[str] = ("schema_name", "table_name", "data_compression_desc")) -> DataFrame:
    """Rows and megabytes per table from the pages (8 KB) of its partitions."""
    mb = lambda pages: F.round(pages.cast("decimal(28,0)") * 8 / F.lit(1024), 2).cast("decimal(28,2)")
    g = partitions.groupBy(*keys).agg(F.sum("rows").alias("row_count"), F.sum("total_pages").alias("_t"), F.sum("used_pages").alias("_u"))
    return g.select(*keys, "row_count", mb(F.col("_t")).alias("total_space_mb"), mb(F.col("_u")).alias("used_space_mb"),
                    mb(F.col("_t") - F.col("_u")).alias("unused_space_mb"))


def sys_configurations(settings: DataFrame, versions: DataFrame) -> DataFrame:
    """Server settings with the product version as one more setting, id -1 (report-star ``sys_configurations``)."""
    number = F.replace("product_version", F.lit("."), F.lit("")).cast("bigint")
    version = versions.select("sql_instance", F.lit(-1).alias("configuration_id"), F.lit("version").alias("name"),
                              number.alias("value"), number.alias("value_in_use"),
                              F.lit("Version as integer: xx.x.xxxx.xx").alias("description"))
    return settings.select(*version.columns).unionByName(version)


def fact_check(history: DataFrame, header: DataFrame, checks: DataFrame) -> DataFrame:
    """Check results with report time and the check's name and description (report-star ``fact_check``)."""
    j = history.join(header, ["sql_instance", "snapshot_type_id", "snapshot_time"])
    j = j.join(broadcast_if_small(checks), "check_id")
    return j.select("sql_instance", "snapshot_time", "check_id", "check_name", "check_value", "check_status",
                    "check_exec_time_ms", "report_time", "status_change", "snapshot_type_id", "check_description")
