"""Trend roll-ups and raw-plus-trend series.

Roll-ups aggregate per (key, n-minute bucket): a hash aggregation with a
map-side partial step, so a busy instance is pre-aggregated on every
executor before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import time_group
from .timeseries import _ts

# Trend tiers as (interval minutes, days kept).
TREND_TIERS = ((1, 7), (5, 90), (60, 720))


def trend_rollup(df: DataFrame, keys: Sequence[str], value: str, minutes: int, valid_days: int, now,
                 time: str = "snapshot_time", existing: DataFrame | None = None) -> DataFrame:
    """avg/min/max/sum of ``value`` per key and n-minute bucket, with expiry.

    ``existing`` is the trend table already written; buckets present there are
    not emitted again (insert-if-absent on key, bucket and interval).
    """
    bucket = time_group(time, minutes)
    g = (df.groupBy(*keys, bucket.alias(time))
         .agg(F.avg(value).alias("value_avg"), F.min(value).alias("value_min"),
              F.max(value).alias("value_max"), F.sum(value).alias("value_sum"),
              F.count(value).alias("value_count")))
    out = g.select("*", F.lit(minutes).alias("interval_minutes"),
                   F.timestamp_add("DAY", F.lit(valid_days), _ts(now)).alias("valid_until"))
    if existing is not None:
        out = out.join(existing.select(*keys, time, "interval_minutes"),
                       list(keys) + [time, "interval_minutes"], "left_anti")
    return out


def trend_partials(df: DataFrame, keys: Sequence[str], value: str, minutes: int, time: str = "snapshot_time",
                   tie: str | None = None) -> DataFrame:
    """Mergeable roll-up of raw rows: sum, count, min, max and the last value with its time, per key and bucket.

    ``tie`` orders rows of equal time. Rows without a value count for nothing; a bucket without any is absent."""
    order = F.struct(F.col(time).alias("t"), (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("tie"))
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, time_group(time, minutes).alias(time))
            .agg(F.sum(value).alias("value_sum"), F.count(value).alias("value_count"), F.min(value).alias("value_min"),
                 F.max(value).alias("value_max"), F.max_by(value, order).alias("value_last"), F.max(order).alias("last_at")))


def merge_partials(partials: DataFrame, keys: Sequence[str], minutes: int, time: str = "snapshot_time") -> DataFrame:
    """Partials of a coarser bucket from finer ones: nothing is read from the raw rows again."""
    return (partials.groupBy(*keys, time_group(time, minutes).alias(time))
            .agg(F.sum("value_sum").alias("value_sum"), F.sum("value_count").alias("value_count"), F.min("value_min").alias("value_min"),
                 F.max("value_max").alias("value_max"), F.max_by("value_last", "last_at").alias("value_last"), F.max("last_at").alias("last_at")))


def trend_tiers(df: DataFrame, keys: Sequence[str], value: str, now, time: str = "snapshot_time", tie: str | None = None,
                existing: DataFrame | None = None, tiers: Sequence[tuple[int, int]] = TREND_TIERS) -> DataFrame:
    """Trend rows of all tiers (M14): the first from the raw rows, each other one from the tier before it.

    The minutes of a tier are a multiple of those before, so buckets nest and the partials merge without loss; each tier
    expires after its own days. Buckets that ``existing`` has already are not emitted again (insert if absent on key, bucket and
    interval), though they count in the coarser tiers.
    """
    if any(b % a for (a, _), (b, _) in zip(tiers, tiers[1:], strict=False)):
        raise ValueError("the minutes of a tier must be a multiple of those of the tier before")
    out, partials = None, None
    for minutes, days in tiers:
        partials = (trend_partials(df, keys, value, minutes, time, tie) if partials is None
                    else merge_partials(partials, keys, minutes, time))
        rows = partials.select(*keys, time, F.lit(minutes).alias("interval_minutes"),
                               F.try_divide(F.col("value_sum").cast("double"), F.col("value_count")).alias("value_avg"),
                               "value_min", "value_max", "value_sum", "value_count", "value_last",
                               F.timestamp_add("DAY", F.lit(days), _ts(now)).alias("valid_until"))
        out = rows if out is None else out.unionByName(rows)
    if existing is not None:
        on = [*keys, time, "interval_minutes"]
        out = out.join(existing.select(*on), on, "left_anti")
    return out


def union_counters(raw: DataFrame, trend: DataFrame, keys: Sequence[str], value: str,
                   time: str = "snapshot_time") -> DataFrame:
    """Raw samples (interval 0) stacked with trend rows (their interval), flagged."""
    r = raw.select(*keys, time, F.col(value).cast("double").alias(value),
                   F.lit(0).alias("aggregation_interval"), F.lit(False).alias("is_trend"))
    t = trend.select(*keys, time, F.col("value_avg").cast("double").alias(value),
                     F.col("interval_minutes").alias("aggregation_interval"), F.lit(True).alias("is_trend"))
    return r.unionByName(t)
