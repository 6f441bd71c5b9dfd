"""Retention (K1-K5): cut-offs per instance and type, retained headers, orphan
purge, last-seen purge and queue retention.

Retention is expressed as the *retained set* (a filter / semi join) rather
than batched deletes: the caller writes the retained version of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import broadcast_if_small, spread_join
from .timeseries import _ts

# Default retention of the action queue, days.
QUEUE_OK_DAYS, QUEUE_FAILED_DAYS = 7, 30
# Fixed value: days after which unseen dimension rows are purged.
LAST_SEEN_PURGE_DAYS = 7


def retention_cutoffs(policy: DataFrame, header: DataFrame, now) -> DataFrame:
    """Cut-off time per (instance, snapshot type) present in the header (K1).

    ``now - retention_days`` for positive days; for 0 or negative (keep the
    latest only) the latest snapshot time of that instance and type. Only
    pairs that have snapshots need a cut-off, so the per-pair latest time
    (an aggregate of the header) is joined to the policy on the type -- no
    instances x types grid is materialised.
    """
    latest = header.groupBy("sql_instance", "snapshot_type_id").agg(F.max("snapshot_time").alias("_latest"))
    j = latest.join(broadcast_if_small(policy.select("snapshot_type_id", "retention_days")), "snapshot_type_id")
    cut = F.when(F.col("retention_days") > 0,
                 F.timestamp_add("DAY", -F.col("retention_days"), _ts(now))).otherwise(F.col("_latest"))
    return j.select("sql_instance", "snapshot_type_id", "retention_days", cut.alias("cutoff_time"))


def retention_apply(header: DataFrame, cutoffs: DataFrame, baseline_times: DataFrame | None = None) -> DataFrame:
    """Headers to keep (K2): not older than their cut-off, or a baseline snapshot
    of their instance. Types without a cut-off are kept."""
    j = spread_join(header, cutoffs.select("sql_instance", "snapshot_type_id", "cutoff_time"),
                    ["sql_instance", "snapshot_type_id"], "snapshot_time")
    old = F.coalesce(F.col("snapshot_time") < F.col("cutoff_time"), F.lit(False))
    if baseline_times is not None:
        b = baseline_times.select("sql_instance", "snapshot_time").distinct().withColumn("_base", F.lit(True))
        j = j.join(b, ["sql_instance", "snapshot_time"], "left")
        old = old & ~F.coalesce(F.col("_base"), F.lit(False))
        return j.filter(~old).drop("cutoff_time", "_base")
    return j.filter(~old).drop("cutoff_time")


def orphan_purge(fact: DataFrame, header: DataFrame,
                 keys=("sql_instance", "snapshot_type_id", "snapshot_time")) -> DataFrame:
    """Fact rows that still have a header (K3, the cascade of a header delete)."""
    return fact.join(header.select(*keys).distinct(), list(keys), "left_semi")


def last_seen_purge(dim: DataFrame, now, days: int = LAST_SEEN_PURGE_DAYS,
                    seen_col: str = "date_last_seen") -> DataFrame:
    """Dimension rows seen within ``days`` (rows never stamped are kept) (K4)."""
    return dim.filter(F.col(seen_col).isNull()
                      | (F.col(seen_col) >= F.timestamp_add("DAY", F.lit(-days), _ts(now))))


def queue_retention(queue: DataFrame, now, ok_days: int = QUEUE_OK_DAYS,
                    failed_days: int = QUEUE_FAILED_DAYS) -> DataFrame:
    """Queue items to keep (K5): non-failed items for ``ok_days``, failed ones for
    ``failed_days``. An item without a status is held to the failed rule (a
    NULL comparison falls through to the second branch)."""
    limit = F.when(F.col("exec_status") != "FAILED", F.timestamp_add("DAY", F.lit(-ok_days), _ts(now))) \
             .otherwise(F.timestamp_add("DAY", F.lit(-failed_days), _ts(now)))
    # a row is deleted only when the comparison is true; NULL times are kept
    return queue.filter(~F.coalesce(F.col("time_queued") < limit, F.lit(False)))


def expire_trends(trend: DataFrame, now) -> DataFrame:
    """Trend rows still valid at ``now`` (K5)."""
    return trend.filter(~F.coalesce(_ts(now) > F.col("valid_until"), F.lit(False)))
