"""Counter cooking, latency, throughput and derived rates.

All divisions are guarded (a zero or NULL denominator gives 0 or NULL as
documented per operator) because ANSI mode makes a plain division by zero fail
the whole job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .deltas import INSTANCE_TYPE, join_previous

# Performance counter types (.NET PerformanceCounterType codes).
RAW_VALUE = 65792            # instantaneous value
RATE_PER_SECOND = 272696576  # difference counter per second
RAW_FRACTION = 537003264     # value / base, as percent
AVERAGE_BULK = 1073874176    # delta / base delta, per second
AVERAGE_BASE = 1073939712    # base rows of the fraction/average types
# Fixed value: counter object whose values are cooked as plain positive deltas.
BATCH_RESP_OBJECT = "Batch Resp Statistics"


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def guarded_ratio(num, den, zero=0.0) -> Column:
    """num / den when den > 0, else ``zero`` (use ``None`` for NULL)."""
    den_c = F.col(den) if isinstance(den, str) else den
    z = F.lit(zero).cast("double") if zero is not None else F.lit(None).cast("double")
    return F.when(F.coalesce(den_c, F.lit(0)) > 0, _d(num) / _d(den_c)).otherwise(z)


def cook_counters(samples: DataFrame, keys: Sequence[str], time: str = "snapshot_time",
                  header: DataFrame | None = None, type_col: str = "cntr_type",
                  object_col: str = "object_name", out: str = "cntr_value_calculated",
                  header_cols: Sequence[str] = ()) -> DataFrame:
    """Turn raw counter samples into meaningful values by counter type (M4).

    * object 'Batch Resp Statistics': positive delta since the previous snapshot
    * 65792: the value (NULL -> 0)
    * 272696576: positive delta / elapsed seconds (0 without growth)
    * 537003264: 100 * value / base (0 when base is 0 or NULL)
    * 1073874176: positive delta / base delta / elapsed seconds (0 when undefined)
    * anything else: the raw value
    """
    j = join_previous(samples, keys, time, ["cntr_value", "base_cntr_value"], header, INSTANCE_TYPE,
                      header_cols=header_cols)
    cur, prev = F.col("cntr_value"), F.col("prev_cntr_value")
    base, prev_base = F.col("base_cntr_value"), F.col("prev_base_cntr_value")
    secs = F.timestamp_diff("SECOND", F.col("prev_snapshot_time"), F.col(time)).cast("double")
    grew = F.col("has_prev") & (cur > prev)
    cooked = (
        F.when(F.col(object_col) == BATCH_RESP_OBJECT,
               F.when(grew, _d(cur - prev)).otherwise(F.lit(0.0)))
        .when(F.col(type_col) == RAW_VALUE, F.coalesce(_d(cur), F.lit(0.0)))
        .when(F.col(type_col) == RATE_PER_SECOND,
              F.when(grew, F.try_divide(_d(cur - prev), secs)).otherwise(F.lit(0.0)))
        .when(F.col(type_col) == RAW_FRACTION,
              F.coalesce(F.try_divide(F.lit(100.0) * _d(cur), _d(F.nullif(base, F.lit(0)))), F.lit(0.0)))
        .when(F.col(type_col) == AVERAGE_BULK,
              F.when(grew, F.coalesce(
                  F.try_divide(F.try_divide(_d(cur - prev), _d(F.nullif(base - prev_base, F.lit(0)))), secs),
                  F.lit(0.0))).otherwise(F.lit(0.0)))
        .otherwise(_d(cur))
    )
    return j.select(*[F.col(c) for c in samples.columns], *header_cols, cooked.alias(out))


def cpu_split(df: DataFrame, keys: Sequence[str], process_col: str, idle_col: str) -> DataFrame:
    """Emit CPU counters: process, idle and system = 100 - idle - process (M5)."""
    system = (F.lit(100) - F.col(idle_col) - F.col(process_col))
    return df.select(*keys, F.col(process_col).alias("_p"), F.col(idle_col).alias("_i"),
                     system.alias("_s")) \
             .unpivot(list(keys), ["_p", "_i", "_s"], "counter_name", "cntr_value") \
             .withColumn("counter_name",
                         F.when(F.col("counter_name") == "_p", "Processor Time %")
                          .when(F.col("counter_name") == "_i", "Idle Time %")
                          .otherwise("System Time %"))


def io_latency(df: DataFrame) -> DataFrame:
    """Read/write latency per operation and throughput per second (M8)."""
    return df.select(
        "*",
        guarded_ratio("io_stall_read_ms_delta", "num_of_reads_delta").alias("io_latency_read"),
        guarded_ratio("io_stall_write_ms_delta", "num_of_writes_delta").alias("io_latency_write"),
        guarded_ratio("num_of_bytes_read_delta", "delta_seconds").alias("bytes_read_per_second"),
        guarded_ratio("num_of_bytes_written_delta", "delta_seconds").alias("bytes_written_per_second"),
    )


def wait_rate(df: DataFrame, wait_type_col: str = "wait_type") -> DataFrame:
    """Wait milliseconds per second (NULL without elapsed time) and category (M9)."""
    from ..functions.patterns import wait_category

    return df.select(
        "*",
        F.try_divide(_d("wait_time_ms_delta"), _d(F.nullif(F.col("delta_seconds"), F.lit(0))))
         .alias("wait_time_ms_per_second"),
        wait_category(wait_type_col).alias("wait_category"),
    )


def per_exec(df: DataFrame, cols: Sequence[str], count_col: str = "execution_count_delta") -> DataFrame:
    """Per-execution averages of delta columns; NULL when nothing executed."""
    den = _d(F.nullif(F.col(count_col), F.lit(0)))
    return df.select("*", *[F.try_divide(_d(c), den).alias(f"{c}_per_exec") for c in cols])


def index_ratios(df: DataFrame) -> DataFrame:
    """Update ratio and scan-to-seek ratio, on totals and on deltas."""
    def ratio(num, parts):
        total = None
        for p in parts:
            total = F.col(p) if total is None else total + F.col(p)
        return guarded_ratio(num, total)

    return df.select(
        "*",
        ratio("user_updates", ["user_seeks", "user_lookups", "user_scans", "user_updates"]).alias("update_ratio"),
        ratio("user_scans", ["user_seeks", "user_scans", "user_lookups"]).alias("scan_to_seek_ratio"),
        ratio("user_updates_delta", ["user_seeks_delta", "user_lookups_delta", "user_scans_delta",
                                     "user_updates_delta"]).alias("update_ratio_delta"),
        ratio("user_scans_delta", ["user_seeks_delta", "user_scans_delta", "user_lookups_delta"])
        .alias("scan_to_seek_ratio_delta"),
    )


# Derived rates as (name, numerator counter, denominator counter).
DERIVED_RATES = [
    ("Full Scan Rate", "Full Scans/sec", "Index Searches/sec"),
    ("SQL Compilations Rate", "SQL Compilations/sec", "Batch Requests/Sec"),
    ("SQL Re-Compilation Rate", "SQL Re-Compilations/sec", "SQL Compilations/sec"),
    ("Page Split Rate", "Page Splits/sec", "Batch Requests/Sec"),
    ("Page Lookups Rate", "Page lookups/sec", "Batch Requests/Sec"),
]


def counter_rates(df: DataFrame, keys: Sequence[str], name_col: str = "counter_name",
                  value_col: str = "cntr_value_calculated") -> DataFrame:
    """Derived rates from cooked counters: pivot avg, guarded ratios, unpivot.

    The pivot list is fixed, so the plan is one aggregation with conditional
    averages; rows whose rate is NULL are dropped, as SQL UNPIVOT does.
    """
    needed = sorted({c for _, a, b in DERIVED_RATES for c in (a, b)})
    pv = df.filter(F.col(name_col).isin(needed)).groupBy(*keys).pivot(name_col, needed).avg(value_col)
    rates = [F.when(F.col(f"`{den}`") > 0, F.col(f"`{num}`") / F.col(f"`{den}`")).otherwise(F.lit(0.0))
             .alias(name) for name, num, den in DERIVED_RATES]
    wide = pv.select(*keys, *rates)
    long = wide.unpivot(list(keys), [n for n, _, _ in DERIVED_RATES], name_col, value_col)
    return long.filter(F.col(value_col).isNotNull())


BUFFER_POOL_CLERK = "MEMORYCLERK_SQLBUFFERPOOL"  # fixed value: its committed memory is counted as pages already


def memory_clerk_totals(clerks: DataFrame, part: Sequence[str], share: float = 0.05, other: str = "OTHER") -> DataFrame:
    """Total and allocated kilobytes per memory clerk of a snapshot, small ones regrouped as ``other``.

    ``clerks``: ``part`` (instance, time), type, memory_node_id, single_pages_kb, multi_pages_kb,
    virtual_memory_committed_kb, shared_memory_committed_kb. A row's total is its pages, its shared committed memory
    and, except for the buffer pool, its committed virtual memory; the share test is per row (clerk and node) against
    the total of the snapshot, which is bounded by the number of clerks.
    """
    pages = F.col("single_pages_kb") + F.col("multi_pages_kb")
    virtual = F.when(F.col("type") != BUFFER_POOL_CLERK, F.col("virtual_memory_committed_kb")).otherwise(0)
    rows = clerks.withColumn("_total", pages + virtual + F.col("shared_memory_committed_kb")).withColumn("_pages", pages)
    whole = F.sum("_total").over(Window.partitionBy(*part))
    name = F.when(F.try_divide(_d("_total"), _d(whole)) > share, F.col("type")).otherwise(F.lit(other))
    return (rows.select(*part, name.alias("clerk_name"), "_total", "_pages").groupBy(*part, "clerk_name")
            .agg(F.sum("_total").alias("total_kb"), F.sum("_pages").alias("allocated_kb")))


def minor_bucket(df: DataFrame, part: Sequence[str], key: str, value: str, share: float = 0.05,
                 other: str = "OTHER") -> DataFrame:
    """Regroup members holding no more than ``share`` of their part's total as ``other``.

    The part total is a window sum over the part (one snapshot of one
    instance: bounded by the number of members, e.g. memory clerks). A part
    whose total is 0 has no share to show, so all its members are ``other``.
    """
    w = Window.partitionBy(*part)
    total = F.sum(value).over(w)
    keyed = df.withColumn(key, F.when(F.try_divide(_d(value), _d(total)) > share, F.col(key)).otherwise(F.lit(other)))
    return keyed.groupBy(*part, key).agg(F.sum(value).alias(value))
