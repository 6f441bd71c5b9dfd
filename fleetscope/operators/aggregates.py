"""Aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_counts(df: DataFrame, keys: Sequence[str], status_col: str, statuses: Mapping[str, str]) -> DataFrame:
    """Conditional counts per group, one column per status (A2)."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(status_col) == v).alias(name)
                                   for name, v in statuses.items()])


def avg_of_sums(df: DataFrame, outer: Sequence[str], inner: Sequence[str], value: str,
                alias: str = "avg_of_sums") -> DataFrame:
    """Average over inner groups of the per-inner-group sums (A10)."""
    s = df.groupBy(*inner).agg(F.sum(value).alias("_s"))
    return s.groupBy(*outer).agg(F.avg("_s").alias(alias))


def ratio_of_avgs(df: DataFrame, keys: Sequence[str], value: str, num_when: Column, den_when: Column,
                  alias: str = "ratio") -> DataFrame:
    """avg(value where num) / avg(value where den), 0 unless the denominator is positive."""
    g = df.groupBy(*keys).agg(F.avg(F.when(num_when, F.col(value))).alias("_n"),
                              F.avg(F.when(den_when, F.col(value))).alias("_d"))
    return g.select(*keys, F.when(F.col("_d") > 0, F.col("_n") / F.col("_d")).otherwise(F.lit(0.0)).alias(alias))


def distinct_count(df: DataFrame, keys: Sequence[str], value: str, alias: str, approx: bool = False,
                   rsd: float = 0.05) -> DataFrame:
    """count(distinct) per group; ``approx`` uses HyperLogLog++ (A4)."""
    agg = F.approx_count_distinct(value, rsd) if approx else F.countDistinct(value)
    return df.groupBy(*keys).agg(agg.alias(alias))


def listagg(df: DataFrame, keys: Sequence[str], value: str, alias: str, sep: str = ",",
            distinct: bool = True) -> DataFrame:
    """Ordered string aggregation per group (A15). Groups are bounded by the number
    of distinct values (column names, index columns), not by row count."""
    coll = F.collect_set(value) if distinct else F.collect_list(value)
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(coll), sep).alias(alias))


def failure_stats_anonymised(df: DataFrame, instance: str, process: str, time: str, now,
                             hours: int = 24) -> DataFrame:
    """Failures per md5(instance) and process in the last ``hours`` before ``now``."""
    from .timeseries import _ts

    recent = df.filter(F.col(time) > F.timestamp_add("HOUR", F.lit(-hours), _ts(now)))
    return recent.groupBy(F.md5(F.col(instance)).alias("instance_hash"), F.col(process)) \
                 .agg(F.count(F.lit(1)).alias("failures"))


def backup_age(databases: DataFrame, backup_sets: DataFrame, now, key: str = "database_id") -> DataFrame:
    """Backup age per database (A20): latest data (full 'D' or differential 'I')
    and log ('L') backup, days/minutes since (boundary counts; 9999 when there
    is none), and whether a full backup is missing. Backup sets are reduced
    per database before the join."""
    from ..functions.timeops import datediff_boundary
    from .timeseries import _ts

    b = backup_sets.groupBy(key).agg(
        F.max(F.when(F.col("type").isin("D", "I"), F.col("backup_finish_date"))).alias("last_data_backup"),
        F.max(F.when(F.col("type") == "D", F.col("backup_finish_date"))).alias("_last_full"),
        F.max(F.when(F.col("type") == "L", F.col("backup_finish_date"))).alias("last_log_backup"))
    j = databases.select(key).join(b, key, "left")
    now_c = _ts(now)
    return j.select(key, "last_data_backup", "last_log_backup",
                    F.coalesce(datediff_boundary("day", "last_data_backup", now_c), F.lit(9999))
                    .alias("data_backup_age_days"),
                    F.coalesce(datediff_boundary("minute", "last_log_backup", now_c), F.lit(9999))
                    .alias("log_backup_age_minutes"),
                    F.col("_last_full").isNull().alias("missing_full_backup"))
