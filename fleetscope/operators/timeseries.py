"""Time-axis operators over snapshot headers and facts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import auto_interval, datediff_boundary, time_group, us_week_of_year
from .joins import spread_join


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (dt.datetime, str)):
        return F.lit(str(value)).cast("timestamp_ntz")
    raise TypeError(value)


def time_intervals(header: DataFrame, now, report_hours: float | None = 4, minutes: int | None = None,
                   snapshot_type_id: int | None = None, time: str = "snapshot_time") -> DataFrame:
    """Report intervals over the snapshots of the last ``report_hours`` before ``now``.

    One row per (instance, type, interval) with first/last snapshot time,
    interval start/end, the interval width, the age of the interval end in
    hours (boundary count) and a per-(instance, type) collection sequence.
    """
    n = minutes if minutes is not None else auto_interval(report_hours)
    hours = 4 if report_hours is None else report_hours
    now_c = _ts(now)
    h = header
    if snapshot_type_id is not None:
        h = h.filter(F.col("snapshot_type_id") == snapshot_type_id)
    h = h.filter((F.col(time) >= F.timestamp_add("MINUTE", F.lit(int(-hours * 60)), now_c))
                 & (F.col(time) <= now_c))
    start = time_group(time, n)
    g = (h.groupBy("sql_instance", "snapshot_type_id", start.alias("snapshot_interval_start"))
         .agg(F.min(time).alias("first_snapshot_time"), F.max(time).alias("last_snapshot_time")))
    end = F.timestamp_add("MINUTE", F.lit(n), F.col("snapshot_interval_start"))
    w = Window.partitionBy("sql_instance", "snapshot_type_id").orderBy("first_snapshot_time")
    return g.select(
        "sql_instance", "snapshot_type_id", "first_snapshot_time", "last_snapshot_time",
        "snapshot_interval_start", end.alias("snapshot_interval_end"),
        F.lit(n).alias("report_time_interval_minutes"),
        datediff_boundary("hour", end, now_c).alias("snapshot_age_hours"),
        F.row_number().over(w).cast("bigint").alias("snapshot_collection_sequence"),
    )


def dim_time(header: DataFrame, report_col: str = "report_time", time: str = "snapshot_time") -> DataFrame:
    """Calendar attributes, 5/15/60-minute buckets and shifted baseline times.

    Names are English, weeks are Sunday-based (fixed formula, not locale dependent),
    ``year_month`` is zero-padded ``yyyy-MM``.
    """
    r = F.col(report_col)
    return header.select(
        "*",
        F.to_date(r).alias("date"), F.year(r).alias("year"), F.month(r).alias("month"),
        F.dayofmonth(r).alias("day"), F.hour(r).alias("hour"), F.minute(r).alias("minute"),
        F.date_format(r, "HH:mm:ss").alias("time"),
        F.date_format(r, "MMMM").alias("month_name"),
        us_week_of_year(r).alias("week_number"),
        F.date_format(r, "EEEE").alias("week_day"),
        F.dayofyear(r).alias("day_of_year"),
        F.date_format(r, "yyyy-MM").alias("year_month"),
        F.dayofweek(r).alias("day_of_week"),
        F.concat(F.year(r).cast("string"), F.lit("-WK"), F.lpad(us_week_of_year(r).cast("string"), 2, "0"))
         .alias("year_week"),
        time_group(r, 5).alias("interval_minutes_5"),
        time_group(r, 15).alias("interval_minutes_15"),
        time_group(r, 60).alias("interval_minutes_60"),
        F.timestamp_add("DAY", F.lit(-1), r).alias("baseline_1_report_time"),
        F.timestamp_add("WEEK", F.lit(-1), r).alias("baseline_2_report_time"),
        F.timestamp_add("MONTH", F.lit(-1), r).alias("baseline_3_report_time"),
        F.timestamp_add("DAY", F.lit(-1), F.col(time)).alias("baseline_1_snapshot_time"),
        F.timestamp_add("WEEK", F.lit(-1), F.col(time)).alias("baseline_2_snapshot_time"),
        F.timestamp_add("MONTH", F.lit(-1), F.col(time)).alias("baseline_3_snapshot_time"),
    )


def freshness(header: DataFrame, now, time: str = "snapshot_time",
              keys: Sequence[str] = ("sql_instance", "snapshot_type_id")) -> DataFrame:
    """Latest snapshot per (instance, type) and its age in minutes and hours."""
    now_c = _ts(now)
    g = header.groupBy(*keys).agg(F.max(time).alias("last_snapshot_time"))
    return g.select("*",
                    datediff_boundary("minute", "last_snapshot_time", now_c).alias("snapshot_age_minutes"),
                    datediff_boundary("hour", "last_snapshot_time", now_c).alias("snapshot_age_hours"))


def freshness_wide(facts: Mapping[str, DataFrame], key: str = "sql_instance",
                   time: str = "snapshot_time") -> DataFrame:
    """One row per instance, one column per fact table: its latest snapshot time.

    Each fact is reduced to (instance, max time) before the union, so the
    pivot only sees instances x tables rows.
    """
    parts = [f.groupBy(key).agg(F.max(time).alias("_t")).withColumn("_table", F.lit(name))
             for name, f in facts.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(key).pivot("_table", list(facts)).agg(F.max("_t"))


def flag_latest(df: DataFrame, keys: Sequence[str], time: str = "snapshot_time",
                flag: str = "is_latest") -> DataFrame:
    """Flag rows at the latest time of their key group.

    The per-group maximum is a (groups)-sized aggregate joined back by a spread
    join; no window, so a large group never lands in one task.
    """
    latest = df.groupBy(*keys).agg(F.max(time).alias("_max_t"))
    j = spread_join(df, latest, keys, time)
    return j.withColumn(flag, F.col(time) == F.col("_max_t")).drop("_max_t")


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """First and latest value per key in one aggregation."""
    return df.groupBy(*keys).agg(
        F.min(time).alias("first_snapshot_time"), F.max(time).alias("last_snapshot_time"),
        F.min_by(value, time).alias(f"first_{value}"), F.max_by(value, time).alias(f"last_{value}"),
        F.coalesce(F.max_by(value, time), F.min_by(value, time)).alias(f"latest_{value}"),
    )


def stalest(df: DataFrame, keys: Sequence[str], time: str, n: int) -> DataFrame:
    """The ``n`` keys seen least recently, oldest first (O1); ties broken by key."""
    g = df.groupBy(*keys).agg(F.max(time).alias("last_seen"))
    return g.orderBy(F.col("last_seen"), *[F.col(k) for k in keys]).limit(n)
