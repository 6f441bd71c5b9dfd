"""Checks (L1-L9, L14, L17): threshold parsing and matching, statuses, baselines,
flapping, due checks, dynamic thresholds, status runs.

Thresholds are text like '>80', '<=0.1', '<>2'. Values and thresholds are
compared as decimal(28,5); variance widens '>'/'>=' thresholds upwards and
'<'/'<=' downwards by a percentage, '=' and '<>' have none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col
from ..functions.timeops import datediff_boundary
from .joins import broadcast_if_small, spread_join
from .timeseries import _ts
from .windows import running_sum, series_previous, series_previous_rows

DEC = "decimal(28,5)"
LAST_CHECK_VALUE = "{LAST_CHECK_VALUE}"
# Statuses.
OK, WARNING, CRITICAL, CHECK_ERROR = "OK", "WARNING", "CRITICAL", "CHECK ERROR"
# Default variance percentages.
DEFAULT_VARIANCE = 1
BASELINE_VARIANCE = 20
DEFAULT_RELAXED_VARIANCE = 10
# Flapping band, look-back rows and hours.
FLAP_LOW, FLAP_HIGH, FLAP_ROWS, FLAP_HOURS = 0.35, 0.65, 12, 6
# Fixed value: minutes after which an errored check is retried at the latest.
ERROR_RETRY_MINUTES = 60


def threshold_comparator(threshold) -> Column:
    """Leading comparator of a threshold text, NULL when there is none (L2)."""
    c = F.regexp_extract(col(threshold), r"^(<=|>=|<>|<|>|=)", 1)
    return F.when(c != "", c)


def threshold_value(threshold) -> Column:
    """Numeric part of a threshold as decimal(28,5); NULL without a comparator (L2)."""
    t = col(threshold)
    return F.replace(t, threshold_comparator(t), F.lit("")).try_cast(DEC)


def _mult(variance, up: bool) -> Column:
    v = F.lit(variance).cast("decimal(10,2)") if not isinstance(variance, Column) else variance.cast("decimal(10,2)")
    factor = (F.lit(1).cast("decimal(10,2)") + v / 100) if up else (F.lit(1).cast("decimal(10,2)") - v / 100)
    return factor.cast("decimal(10,2)")


def threshold_match(value, threshold, variance=DEFAULT_VARIANCE) -> Column:
    """True when ``value`` breaches ``threshold`` allowing ``variance`` percent (L3)."""
    v = col(value).cast(DEC)
    cmp, tv = threshold_comparator(threshold), threshold_value(threshold)
    up, down = tv * _mult(variance, True), tv * _mult(variance, False)
    m = (F.when(cmp == "<=", v <= down).when(cmp == ">=", v >= up).when(cmp == "<>", v != tv)
         .when(cmp == "<", v < down).when(cmp == ">", v > up).when(cmp == "=", v == tv)
         .otherwise(v == tv))
    return F.coalesce(m, F.lit(False))


def threshold_deviation(threshold, variance) -> Column:
    """The effective threshold after variance (used in messages) (L3)."""
    cmp, tv = threshold_comparator(threshold), threshold_value(threshold)
    frac = F.lit(variance).cast("decimal(10,2)") / 100
    return (F.when(F.left(cmp, F.lit(1)) == "<",
                   F.when(tv == 0, F.lit(0) - frac).otherwise(tv * (F.lit(1) - frac)))
            .when(F.left(cmp, F.lit(1)) == ">",
                  F.when(tv == 0, F.lit(0) + frac).otherwise(tv * (F.lit(1) + frac)))
            .otherwise(tv)).cast(DEC)


def status_of(value, critical, warning, variance=DEFAULT_VARIANCE) -> Column:
    """CHECK ERROR for a NULL value; OK while a dynamic threshold is unresolved;
    else CRITICAL, WARNING or OK by threshold match (L4, L8)."""
    unresolved = (F.coalesce(col(critical).contains(LAST_CHECK_VALUE), F.lit(False))
                  | F.coalesce(col(warning).contains(LAST_CHECK_VALUE), F.lit(False)))
    return (F.when(col(value).isNull(), F.lit(CHECK_ERROR))
            .when(unresolved, F.lit(OK))
            .when(threshold_match(value, critical, variance), F.lit(CRITICAL))
            .when(threshold_match(value, warning, variance), F.lit(WARNING))
            .otherwise(F.lit(OK)))


def check_status(df: DataFrame, value: str = "check_value", critical: str = "check_threshold_critical",
                 warning: str = "check_threshold_warning", variance=DEFAULT_VARIANCE,
                 out: str = "check_status") -> DataFrame:
    return df.withColumn(out, status_of(value, critical, warning, variance))


def dynamic_threshold(history: DataFrame, keys: Sequence[str] = ("sql_instance", "check_id"),
                      time: str = "snapshot_time", value: str = "check_value",
                      thresholds: Sequence[str] = ("check_threshold_warning", "check_threshold_critical")) -> DataFrame:
    """Replace ``{LAST_CHECK_VALUE}`` in thresholds by the previous check value.

    The previous value is rendered as decimal(28,5) text; with no previous
    value the token stays and the status evaluates to OK.
    """
    p = series_previous(history, keys, time, [value])
    prev_txt = F.col(f"prev_{value}").cast(DEC).cast("string")
    out = p
    for t in thresholds:
        out = out.withColumn(t, F.when(F.col(t).contains(LAST_CHECK_VALUE) & prev_txt.isNotNull(),
                                       F.replace(F.col(t), F.lit(LAST_CHECK_VALUE), prev_txt))
                             .otherwise(F.col(t)))
    return out.drop(f"prev_{value}", f"prev_{time}")


def status_change(history: DataFrame, keys: Sequence[str] = ("sql_instance", "check_id"),
                  time: str = "snapshot_time", status: str = "check_status",
                  keep_previous: Sequence[str] = ()) -> DataFrame:
    """``status_change`` = 1 when the status differs from the previous one (W6); first row 1.

    ``keep_previous`` columns are returned with their previous values as
    ``prev_<c>`` (one pass for later operators that need them).
    """
    carried = [status] + [c for c in keep_previous if c != status]
    p = series_previous(history, keys, time, carried)
    chg = F.when(F.coalesce(F.col(status), F.lit("")) != F.coalesce(F.col(f"prev_{status}"), F.lit("")), 1) \
           .otherwise(0)
    drop = [f"prev_{time}"] + ([] if status in keep_previous else [f"prev_{status}"])
    return p.withColumn("status_change", chg).drop(*drop)


def flapping(history: DataFrame, keys: Sequence[str] = ("sql_instance", "check_id"),
             time: str = "snapshot_time", change: str = "status_change", rows: int = FLAP_ROWS,
             hours: int = FLAP_HOURS, low: float = FLAP_LOW, high: float = FLAP_HIGH,
             ignore_col: str | None = None) -> DataFrame:
    """``is_flapping``: the average status change over the previous ``rows`` results
    within ``hours`` of this one lies in [low, high] (L6)."""
    p = series_previous_rows(history, keys, time, [change], rows, bucket="day")
    since = F.timestamp_add("HOUR", F.lit(-hours), F.col(time))
    recent = F.filter("prev_rows", lambda r: r[time] > since)
    avg = F.try_divide(F.aggregate(recent, F.lit(0).cast("double"), lambda acc, r: acc + r[change].cast("double")),
                       F.size(recent).cast("double"))
    flap = F.coalesce(avg.between(low, high), F.lit(False))
    if ignore_col:
        flap = flap & ~F.coalesce(F.col(ignore_col), F.lit(False))
    return p.withColumn("change_ratio", avg).withColumn("is_flapping", flap).drop("prev_rows")


def status_runs(history: DataFrame, keys: Sequence[str] = ("sql_instance", "check_id"),
                time: str = "snapshot_time", status: str = "check_status", change: str = "status_change",
                mode: str = "bounded", now=None) -> DataFrame:
    """Runs of unchanged status.

    ``bounded``: each run (island) starts at a status change and ends at its
    last check before the next change; ``check_count`` counts the unchanged
    checks after the start. ``reference``: end and count run over *all* later
    unchanged checks of the key, regardless of later changes (the original
    report's behaviour); a run with no later unchanged check ends at ``now``.
    """
    keys = list(keys)
    if mode == "bounded":
        isl = running_sum(history.withColumn("_chg", F.col(change).cast("bigint")), keys, time, "_chg",
                          "_island", bucket="month")
        g = isl.groupBy(*keys, "_island").agg(
            F.min_by(status, time).alias(status), F.min(time).alias("status_start_time"),
            F.max(time).alias("status_end_time"), (F.count(F.lit(1)) - 1).alias("check_count"))
        return g.drop("_island")
    # For each start: the unchanged checks after it = all unchanged checks of the key minus those up
    # to it (a bucketed running count), instead of pairing every start with every later check.
    unchanged = (F.col(change) == 0).cast("bigint")
    upto = running_sum(history.withColumn("_z", unchanged), keys, time, "_z", "_cum", bucket="month")
    z = history.groupBy(*keys).agg(F.sum(unchanged).alias("_n0"),
                                   F.max(F.when(F.col(change) == 0, F.col(time))).alias("_last0"))
    starts = spread_join(upto.filter(F.col(change) == 1), z, keys, time)
    later = F.coalesce(F.col("_n0"), F.lit(0)) - F.coalesce(F.col("_cum"), F.lit(0))
    end = F.when(later > 0, F.col("_last0")).otherwise(_ts(now) if now is not None else F.lit(None))
    return starts.select(*keys, status, F.col(time).alias("status_start_time"), end.alias("status_end_time"),
                         later.alias("check_count"))


def due_checks(checks: DataFrame, now, freq: str = "check_frequency_minutes",
               last: str = "last_check_date", last_status: str = "last_check_status",
               error_cap: int = ERROR_RETRY_MINUTES) -> DataFrame:
    """Checks whose frequency has elapsed; errored checks are retried within ``error_cap``."""
    since = datediff_boundary("minute", F.coalesce(F.col(last), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")),
                              _ts(now))
    f = F.coalesce(F.col(freq), F.lit(0))
    need = F.when((F.col(last_status) == CHECK_ERROR) & (f > error_cap), F.lit(error_cap)).otherwise(f)
    return checks.filter(since >= need)


def baseline_membership(header: DataFrame, baselines: DataFrame, time: str = "snapshot_time") -> DataFrame:
    """Snapshots inside a baseline window of their instance, inclusive.

    Baselines are configuration (a handful of windows per instance): the
    range join runs with the baseline side broadcast behind a size check.
    """
    b = broadcast_if_small(baselines.select("baseline_id", F.col("sql_instance").alias("_b_inst"),
                                            "baseline_start", "baseline_end", "is_default"))
    cond = ((header["sql_instance"] == F.col("_b_inst"))
            & F.col(time).between(F.col("baseline_start"), F.col("baseline_end")))
    return header.join(b, cond, "inner").drop("_b_inst")


def baseline_values(history: DataFrame, membership: DataFrame, keys: Sequence[str] = ("sql_instance", "check_id"),
                    time: str = "snapshot_time", value: str = "check_value", default_only: bool = True) -> DataFrame:
    """Baseline per (instance, check): average check value over baseline snapshots."""
    m = membership
    if default_only:
        m = m.filter(F.col("is_default"))
    m = m.select("sql_instance", time).distinct()
    # Average in integer units of 1e-5 (each value rounded half-up to five
    # decimals, the mean rounded half-up): exact and independent of the order
    # in which partial sums are combined.
    total, count = exact_mean(value)
    g = (history.join(m, ["sql_instance", time], "left_semi")
         .groupBy(*keys).agg(total.alias("_s"), count.alias("_n")))
    return g.select(*keys, exact_mean_value("_s", "_n").cast(DEC).alias("check_baseline"))


def baseline_status(df: DataFrame, baselines: DataFrame, keys: Sequence[str] = ("sql_instance", "check_id"),
                    value: str = "check_value", critical: str = "check_threshold_critical",
                    strict: bool = False, baseline_variance: int = BASELINE_VARIANCE,
                    default_variance: int = DEFAULT_RELAXED_VARIANCE) -> DataFrame:
    """Status against a baseline.

    The baseline threshold is the critical comparator followed by the
    baseline value. Strict: CRITICAL when the baseline threshold is breached
    (variance 1 %). Relaxed: OK when either the baseline threshold (with
    ``baseline_variance``) or the default critical threshold (with
    ``default_variance``) is not breached, else CRITICAL. Rows without a
    baseline fall back to the plain critical/warning status.
    """
    j = spread_join(df, baselines, keys, value)
    bthr = F.when(F.col("check_baseline").isNotNull(),
                  F.concat(F.coalesce(threshold_comparator(critical), F.lit("")),
                           F.col("check_baseline").cast("string")))
    j = j.withColumn("baseline_threshold", bthr)
    if strict:
        st = F.when(threshold_match(value, "baseline_threshold", 1), CRITICAL).otherwise(OK)
    else:
        st = F.when(~threshold_match(value, "baseline_threshold", baseline_variance)
                    | ~threshold_match(value, critical, default_variance), OK).otherwise(CRITICAL)
    return j.withColumn("baseline_status", F.when(F.col("baseline_threshold").isNotNull(), st))


def check_values(metrics: DataFrame, checks: DataFrame, metric_col: str = "metric",
                 time: str = "snapshot_time", value: str = "value") -> DataFrame:
    """One value per (check, instance): the check's aggregate of its metric over
    (last_check_time, check_time] (L1).

    ``checks``: check_id, metric, agg ('avg'|'min'|'max'|'sum'|'count'),
    window_start, window_end. Checks are configuration and broadcast; all
    aggregates are computed in one pass and the configured one is selected.
    """
    c = broadcast_if_small(checks)
    j = metrics.join(c, (metrics[metric_col] == c["metric"])
                     & (metrics[time] > c["window_start"]) & (metrics[time] <= c["window_end"]))
    g = j.groupBy("check_id", "sql_instance", "agg").agg(
        F.avg(value).alias("_avg"), F.min(value).alias("_min"), F.max(value).alias("_max"),
        F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    pick = (F.when(F.col("agg") == "avg", F.col("_avg")).when(F.col("agg") == "min", F.col("_min"))
            .when(F.col("agg") == "max", F.col("_max")).when(F.col("agg") == "sum", F.col("_sum"))
            .when(F.col("agg") == "count", F.col("_count")))
    return g.select("check_id", "sql_instance", pick.cast("double").alias("check_value"))


def check_exec_stats(history: DataFrame, checks: DataFrame, exec_col: str = "check_exec_time_ms") -> DataFrame:
    """Check dimension with execution statistics."""
    st = history.groupBy("check_id").agg(
        F.min(exec_col).alias("min_exec_ms"), F.max(exec_col).alias("max_exec_ms"),
        F.avg(exec_col).alias("avg_exec_ms"), F.count(F.lit(1)).alias("check_count"),
        F.max("snapshot_time").alias("last_check_time"))
    return checks.join(st, "check_id", "left")


# The shipped check catalogue as
# (check name, frequency minutes, warning threshold, critical threshold, expand by, use baseline).
SHIPPED_CHECKS = [
    ("Database {DATABASE} AUTO_CLOSE", 1440, None, ">0", "Database", False),
    ("Database {DATABASE} PAGE_VERIFY", 1440, None, "<>2", "Database", False),
    ("Database {DATABASE} AUTO_SHRINK", 1440, None, ">0", "Database", False),
    ("Database {DATABASE} STATE", 60, None, ">0", "Database", False),
    ("Database {DATABASE} USER ACCESS", 60, None, ">0", "Database", False),
    ("Job {JOB} failure count", 10, None, ">0", "Job", False),
    ("Disk {DISK} free space %", 360, "<0.1", "<0.05", "Disk", False),
    ("Disk {DISK} days left until full", 1440, "<7", "<3", "Disk", False),
    ("Database {Database} Log Backup Age", 10, ">10", ">60", "Database", False),
    ("Database {Database} Data Backup Age", 720, ">1", ">7", "Database", False),
    ("CPU Utilistaion", 5, ">60", ">80", None, True),
    ("Full Scan Rate", 15, ">0.001", ">0.01", None, True),
    ("SQL Compilations Rate", 15, ">0.10", ">0.15", None, True),
    ("SQL Re-Compilations Rate", 15, ">0.10", ">0.15", None, True),
    ("Page Split Rate", 15, ">0.20", ">0.25", None, True),
    ("Free list stalls/sec", 15, ">2", ">5", None, True),
    ("Lazy writes/sec", 15, ">20", ">25", None, True),
    ("Page reads/sec", 15, ">90", ">120", None, True),
    ("Page Lookups Rate", 15, ">100", ">120", None, True),
    ("Page writes/sec", 15, ">90", ">120", None, True),
    ("Average Wait Time (ms)", 15, ">500", ">1000", None, True),
    ("Lock Requests/sec", 15, ">1000", ">1200", None, True),
    ("Lock Timeouts/sec", 15, ">0", ">1", None, True),
    ("Lock Waits/sec", 15, ">0.1", ">=1", None, True),
    ("Readahead pages/sec", 15, ">20", ">25", None, True),
    ("Number of Deadlocks/sec", 15, ">0", ">1", None, True),
    ("Memory Grants Outstanding", 15, ">0", ">1", None, True),
    ("Memory Grants Pending", 15, ">0", ">1", None, True),
    ("Buffer cache hit ratio", 15, "<95", "<90", None, True),
    ("Page life expectancy", 15, "<300", "<200", None, True),
    ("Logins/sec", 15, ">2", ">5", None, True),
    ("Errors/sec", 15, ">0", ">1", None, False),
    ("Log Growths", 15, None, ">{LAST_CHECK_VALUE}", None, False),
    ("dbachecks failed", 60, None, ">0", None, False),
    ("Queued actions not processed", 15, None, ">0", None, False),
    ("Action queue pending items", 15, None, ">10", None, False),
    ("Action queue failed items", 15, None, ">5", None, False),
    ("Check execution time", 15, None, ">1000", None, False),
    ("Blocked Process", None, None, ">0", None, False),
]


def shipped_checks(spark) -> DataFrame:
    """The shipped check catalogue as a configuration DataFrame."""
    return spark.createDataFrame(
        SHIPPED_CHECKS, "check_name string, check_frequency_minutes int, check_threshold_warning string, "
                        "check_threshold_critical string, expand_by string, use_baseline boolean")


def exact_mean(value, scale: int = 5) -> tuple[Column, Column]:
    """(sum, count) aggregate parts for a mean rounded half-up at ``scale`` decimals,
    computed in integer units so it does not depend on the order partial sums are
    combined. Use with ``exact_mean_value``."""
    value = F.col(value) if isinstance(value, str) else value
    units = F.round(value * (10 ** scale)).cast("decimal(28,0)")
    return F.sum(units), F.count(units)


def exact_mean_value(sum_col: str, count_col: str, scale: int = 5) -> Column:
    # floor((2 sum + n) / 2n) in exact integers: the remainder is taken off before the division
    total = F.col(sum_col).cast("decimal(38,0)")
    count = F.col(count_col).cast("decimal(20,0)")
    top, bottom = total + total + count, count + count
    rest = F.pmod(top, bottom)
    mean_units = F.when(count > 0, F.try_divide(top - rest, bottom))
    return (mean_units.cast("decimal(28,0)") * F.lit(10.0 ** -scale).cast(f"decimal({scale + 1},{scale})")) \
        .cast(f"decimal(28,{scale})")


def evaluate_checks(values: DataFrame, catalogue: DataFrame, name_col: str = "check_name",
                    template_col: str = "check_template") -> DataFrame:
    """Statuses for check values against a catalogue of thresholds (L1 + L4).

    ``values``: sql_instance, check_template (catalogue name), check_name
    (expanded), check_value. The catalogue is configuration and broadcast.
    """
    cat = broadcast_if_small(catalogue.withColumnRenamed(name_col, template_col))
    j = values.join(cat, template_col)
    return j.withColumn("check_status", status_of("check_value", "check_threshold_critical",
                                                  "check_threshold_warning"))
