"""Queries on the time axis: intervals, calendar, freshness, latest rows, trends, baselines shifts, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import wait_category_sql
from ..functions.timeops import datediff_boundary, report_time, time_group, trunc_ntz
from ..operators.deltas import counter_delta
from ..operators.timeseries import (
    dim_time, flag_latest, freshness, freshness_wide, latest_per_key, stalest, time_intervals,
)
from ..operators.trends import trend_rollup, union_counters
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .config import WAIT_TYPES
from .fixture_sql import with_fixtures
from .q_rates import HP, pos_delta_sql, prev_join
from .registry import register
from .sqlbits import NOW, NOW_PY, tg_sql, week_sql

K = fx.SAMPLE_KEYS
T = "snapshot_time"


# --- T2 / W1 -------------------------------------------------------------------------------------

@register("time_intervals", oracle=with_fixtures(f"""
    SELECT sql_instance, snapshot_type_id, MIN(snapshot_time) AS first_snapshot_time,
           MAX(snapshot_time) AS last_snapshot_time,
           {tg_sql('snapshot_time', 1440)} AS snapshot_interval_start,
           {tg_sql('snapshot_time', 1440)} + INTERVAL 1440 MINUTE AS snapshot_interval_end,
           1440 AS report_time_interval_minutes,
           date_diff('hour', {tg_sql('snapshot_time', 1440)} + INTERVAL 1440 MINUTE, {NOW}) AS snapshot_age_hours,
           row_number() OVER (PARTITION BY sql_instance, snapshot_type_id ORDER BY MIN(snapshot_time))
               AS snapshot_collection_sequence
    FROM fx_header
    WHERE snapshot_time >= {NOW} - INTERVAL 744 HOUR AND snapshot_time <= {NOW}
    GROUP BY sql_instance, snapshot_type_id, {tg_sql('snapshot_time', 1440)}""", "fx_header"))
def q_time_intervals(spark, sf_dir):
    return time_intervals(fx.fx_header(spark, sf_dir), NOW_PY, report_hours=744)


# --- T4 ------------------------------------------------------------------------------------------------

@register("report_time", oracle="""
    SELECT event_id, date_trunc('second', ts) AS snapshot_time,
           CAST((user_id % 4) * 60 - 120 AS INTEGER) AS utc_offset_minutes,
           date_trunc('minute', date_trunc('second', ts) + INTERVAL 59 SECOND)
               + to_minutes(CAST((user_id % 4) * 60 - 120 AS BIGINT)) AS report_time
    FROM events""")
def q_report_time(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    h = ev.select("event_id", trunc_ntz("second", "ts").alias("snapshot_time"),
                  ((F.col("user_id") % 4) * 60 - 120).cast("int").alias("utc_offset_minutes"))
    return h.withColumn("report_time", report_time("snapshot_time", "utc_offset_minutes"))


# --- T6 ------------------------------------------------------------------------------------------------

@register("datediff_boundary", oracle="""
    SELECT event_id, ts, b,
           date_diff('second', ts, b) AS seconds, date_diff('minute', ts, b) AS minutes,
           date_diff('hour', ts, b) AS hours, date_diff('day', ts, b) AS days
    FROM (SELECT event_id, ts, ts + to_seconds(CAST(round(value * 1000) AS BIGINT)) AS b FROM events) e""")
def q_datediff_boundary(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "value")
    e = ev.select("event_id", "ts",
                  F.timestamp_add("SECOND", F.round(F.col("value") * 1000).cast("bigint"), F.col("ts")).alias("b"))
    return e.select("event_id", "ts", "b",
                    *[datediff_boundary(u, "ts", "b").alias(a) for u, a in
                      (("second", "seconds"), ("minute", "minutes"), ("hour", "hours"), ("day", "days"))])


# --- T3 -------------------------------------------------------------------------------------------------

@register("dim_time", oracle=with_fixtures(f"""
    SELECT sql_instance, snapshot_type_id, snapshot_time, report_time,
      CAST(report_time AS DATE) AS date, CAST(year(report_time) AS INTEGER) AS year,
      CAST(month(report_time) AS INTEGER) AS month, CAST(day(report_time) AS INTEGER) AS day,
      CAST(hour(report_time) AS INTEGER) AS hour, CAST(minute(report_time) AS INTEGER) AS minute,
      strftime(report_time, '%H:%M:%S') AS time,
      monthname(report_time) AS month_name, {week_sql('report_time')} AS week_number,
      dayname(report_time) AS week_day, CAST(dayofyear(report_time) AS INTEGER) AS day_of_year,
      strftime(report_time, '%Y-%m') AS year_month,
      CAST(dayofweek(report_time) + 1 AS INTEGER) AS day_of_week,
      concat(CAST(year(report_time) AS VARCHAR), '-WK', lpad(CAST({week_sql('report_time')} AS VARCHAR), 2, '0'))
          AS year_week,
      {tg_sql('report_time', 5)} AS interval_minutes_5, {tg_sql('report_time', 15)} AS interval_minutes_15,
      {tg_sql('report_time', 60)} AS interval_minutes_60,
      report_time - INTERVAL 1 DAY AS baseline_1_report_time,
      report_time - INTERVAL 7 DAY AS baseline_2_report_time,
      report_time - INTERVAL 1 MONTH AS baseline_3_report_time,
      snapshot_time - INTERVAL 1 DAY AS baseline_1_snapshot_time,
      snapshot_time - INTERVAL 7 DAY AS baseline_2_snapshot_time,
      snapshot_time - INTERVAL 1 MONTH AS baseline_3_snapshot_time
    FROM (SELECT *, snapshot_time + to_minutes(CAST(CAST(right(sql_instance, 1) AS INTEGER) * 90 AS BIGINT))
                    AS report_time FROM fx_header) h""", "fx_header"))
def q_dim_time(spark, sf_dir):
    h = fx.fx_header(spark, sf_dir)
    h = h.withColumn("report_time", F.timestamp_add(
        "MINUTE", (F.substring("sql_instance", -1, 1).cast("int") * 90).cast("bigint"), F.col(T)))
    return dim_time(h)


# --- T7 / A9 ---------------------------------------------------------------------------------------------

@register("freshness", oracle=with_fixtures(f"""
    SELECT sql_instance, snapshot_type_id, MAX(snapshot_time) AS last_snapshot_time,
           date_diff('minute', MAX(snapshot_time), {NOW}) AS snapshot_age_minutes,
           date_diff('hour', MAX(snapshot_time), {NOW}) AS snapshot_age_hours
    FROM fx_header GROUP BY sql_instance, snapshot_type_id""", "fx_header"))
def q_freshness(spark, sf_dir):
    return freshness(fx.fx_header(spark, sf_dir), NOW_PY)


@register("freshness_wide", oracle=with_fixtures("""
    SELECT sql_instance,
           MAX(CASE WHEN t = 'perf_counters' THEN m END) AS perf_counters,
           MAX(CASE WHEN t = 'checks' THEN m END) AS checks,
           MAX(CASE WHEN t = 'volumes' THEN m END) AS volumes
    FROM (SELECT sql_instance, 'perf_counters' AS t, MAX(snapshot_time) AS m FROM fx_sample GROUP BY 1
          UNION ALL SELECT sql_instance, 'checks', MAX(snapshot_time) FROM fx_check GROUP BY 1
          UNION ALL SELECT concat('srv', CAST(volume_id % 4 AS VARCHAR)), 'volumes', MAX(snapshot_time)
                    FROM fx_volume GROUP BY 1) u
    GROUP BY sql_instance""", "fx_sample", "fx_check", "fx_volume"))
def q_freshness_wide(spark, sf_dir):
    vol = fx.fx_volume(spark, sf_dir).withColumn(
        "sql_instance", F.concat(F.lit("srv"), (F.col("volume_id") % 4).cast("string")))
    return freshness_wide({"perf_counters": fx.fx_sample(spark, sf_dir),
                           "checks": fx.fx_check(spark, sf_dir), "volumes": vol})


# --- J11 / A14 / M17 / O1 ---------------------------------------------------------------------------------

@register("is_latest", oracle=with_fixtures("""
    SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time, cntr_value,
           snapshot_time = MAX(snapshot_time) OVER (PARTITION BY sql_instance, snapshot_type_id) AS is_latest
    FROM fx_sample""", "fx_sample"))
def q_is_latest(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir).drop("base_cntr_value")
    return flag_latest(s, ["sql_instance", "snapshot_type_id"], T)


@register("latest_per_key", oracle=with_fixtures("""
    SELECT sql_instance, instance_name, snapshot_type_id,
           MIN(snapshot_time) AS first_snapshot_time, MAX(snapshot_time) AS last_snapshot_time,
           arg_min(cntr_value, snapshot_time) AS first_cntr_value,
           arg_max(cntr_value, snapshot_time) AS last_cntr_value,
           COALESCE(arg_max(cntr_value, snapshot_time), arg_min(cntr_value, snapshot_time)) AS latest_cntr_value
    FROM fx_sample GROUP BY sql_instance, instance_name, snapshot_type_id""", "fx_sample"))
def q_latest_per_key(spark, sf_dir):
    return latest_per_key(fx.fx_sample(spark, sf_dir), K, T, "cntr_value")


@register("stalest_topk", oracle="""
    SELECT p_partkey, MAX(l_shipdate) AS last_seen FROM lineitem JOIN part ON p_partkey = l_partkey
    GROUP BY p_partkey ORDER BY last_seen, p_partkey LIMIT 20""")
def q_stalest_topk(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate")
    p = read_table(spark, sf_dir, "part", "p_partkey")
    # reduce the fact to its latest time per part before joining the dimension
    last = li.groupBy("l_partkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    j = last.join(p, last.l_partkey == p.p_partkey).select("p_partkey", "l_shipdate")
    return stalest(j, ["p_partkey"], "l_shipdate", 20)


# --- M14 / M15 -----------------------------------------------------------------------------------------------

_DELTA_CTE = ("dl", f"""SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time,
                        {pos_delta_sql('cntr_value')} AS cntr_value_delta {prev_join('fx_sample')}""")

_TREND_SQL = f"""
    SELECT sql_instance, instance_name, snapshot_type_id, {tg_sql('snapshot_time', 360)} AS snapshot_time,
           AVG(cntr_value_delta) AS value_avg, MIN(cntr_value_delta) AS value_min,
           MAX(cntr_value_delta) AS value_max, CAST(SUM(cntr_value_delta) AS BIGINT) AS value_sum,
           COUNT(cntr_value_delta) AS value_count, 360 AS interval_minutes,
           {NOW} + INTERVAL 90 DAY AS valid_until
    FROM dl GROUP BY sql_instance, instance_name, snapshot_type_id, {tg_sql('snapshot_time', 360)}"""


def _deltas(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir).drop("base_cntr_value")
    return counter_delta(s, K, T, ["cntr_value"], header=fx.fx_header(spark, sf_dir)).drop("delta_seconds")


@register("trend_rollup", headline=True,
          oracle=with_fixtures(_TREND_SQL, "fx_sample", "fx_header", extra=[HP, _DELTA_CTE]))
def q_trend_rollup(spark, sf_dir):
    return trend_rollup(_deltas(spark, sf_dir), K, "cntr_value_delta", 360, 90, NOW_PY)


@register("union_counters", oracle=with_fixtures(f"""
    SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time,
           CAST(cntr_value_delta AS DOUBLE) AS cntr_value_delta, 0 AS aggregation_interval, FALSE AS is_trend
    FROM dl
    UNION ALL
    SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time, value_avg, interval_minutes, TRUE
    FROM ({_TREND_SQL}) t""", "fx_sample", "fx_header", extra=[HP, _DELTA_CTE]))
def q_union_counters(spark, sf_dir):
    d = _deltas(spark, sf_dir).drop("cntr_value")
    t = trend_rollup(d, K, "cntr_value_delta", 360, 90, NOW_PY)
    return union_counters(d, t, K, "cntr_value_delta")


# --- E10 / dashboards ----------------------------------------------------------------------------------------

@register("events_per_time", oracle=f"""
    SELECT {tg_sql('ts', 60)} AS time_bucket, event_type, COUNT(*) AS events,
           CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS sum_v100
    FROM events GROUP BY ALL""")
def q_events_per_time(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "ts", "event_type", "value")
    return (ev.groupBy(time_group("ts", 60).alias("time_bucket"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("sum_v100")))


@register("dash_checks", oracle=with_fixtures(f"""
    SELECT sql_instance, check_id, {tg_sql('snapshot_time', 360)} AS time_bucket,
           MAX(CASE check_status WHEN 'OK' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'CRITICAL' THEN 2 ELSE 3 END)
               AS status_level,
           COUNT(*) AS checks
    FROM fx_check GROUP BY ALL""", "fx_check"))
def q_dash_checks(spark, sf_dir):
    c = fx.fx_check(spark, sf_dir)
    level = (F.when(F.col("check_status") == "OK", 0).when(F.col("check_status") == "WARNING", 1)
             .when(F.col("check_status") == "CRITICAL", 2).otherwise(3))
    return (c.groupBy("sql_instance", "check_id", time_group(T, 360).alias("time_bucket"))
            .agg(F.max(level).alias("status_level"), F.count(F.lit(1)).alias("checks")))


@register("dash_volume", oracle=with_fixtures(f"""
    SELECT volume_id, {tg_sql('snapshot_time', 1440)} AS time_bucket,
           MIN(free_bytes) AS min_free_bytes, MAX(total_bytes) AS total_bytes,
           CAST(MIN(free_bytes) AS DOUBLE) / CAST(NULLIF(MAX(total_bytes), 0) AS DOUBLE) AS min_free_ratio
    FROM fx_volume GROUP BY ALL""", "fx_volume"))
def q_dash_volume(spark, sf_dir):
    v = fx.fx_volume(spark, sf_dir)
    g = v.groupBy("volume_id", time_group(T, 1440).alias("time_bucket")).agg(
        F.min("free_bytes").alias("min_free_bytes"), F.max("total_bytes").alias("total_bytes"))
    return g.withColumn("min_free_ratio", F.try_divide(F.col("min_free_bytes").cast("double"), F.col("total_bytes").cast("double")))


@register("dash_io", oracle=with_fixtures(f"""
    SELECT sql_instance, {tg_sql('snapshot_time', 360)} AS time_bucket,
           CAST(SUM(d) AS BIGINT) AS stall_ms, CAST(SUM(n) AS BIGINT) AS reads,
           CASE WHEN SUM(n) > 0 THEN CAST(SUM(d) AS DOUBLE) / CAST(SUM(n) AS DOUBLE) ELSE 0.0 END AS avg_latency_ms,
           MAX(CASE WHEN n > 0 THEN CAST(d AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0 END) AS max_latency_ms
    FROM (SELECT s.sql_instance, s.snapshot_time, {pos_delta_sql('cntr_value')} AS d,
                 {pos_delta_sql('base_cntr_value')} AS n {prev_join('fx_sample')}) x
    GROUP BY ALL""", "fx_sample", "fx_header", extra=[HP]))
def q_dash_io(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir)
    d = counter_delta(s, K, T, ["cntr_value", "base_cntr_value"], header=fx.fx_header(spark, sf_dir))
    lat = F.when(F.col("base_cntr_value_delta") > 0,
                 F.col("cntr_value_delta").cast("double") / F.col("base_cntr_value_delta").cast("double")
                 ).otherwise(F.lit(0.0))
    g = d.groupBy("sql_instance", time_group(T, 360).alias("time_bucket")).agg(
        F.sum("cntr_value_delta").alias("stall_ms"), F.sum("base_cntr_value_delta").alias("reads"),
        F.max(lat).alias("max_latency_ms"))
    return g.withColumn("avg_latency_ms", F.when(F.col("reads") > 0, F.col("stall_ms").cast("double")
                                                 / F.col("reads").cast("double")).otherwise(F.lit(0.0)))


# --- more dashboard panels -----------------------------------------------------------------------------

@register("dash_waits", oracle=with_fixtures(f"""
    SELECT {tg_sql('s.snapshot_time', 360)} AS time_bucket,
           {wait_category_sql('w.wait_type')} AS wait_category,
           CAST(SUM({pos_delta_sql('cntr_value')}) AS BIGINT) AS wait_time_ms
    {prev_join('fx_sample')}
    JOIN ({WAIT_TYPES.sql()}) w
      ON w.snapshot_type_id = s.snapshot_type_id AND w.instance_name = s.instance_name
    GROUP BY 1, 2""", "fx_sample", "fx_header", extra=[HP]))
def q_dash_waits(spark, sf_dir):
    """Wait time per wait category and 6-hour bucket across the fleet."""
    from ..functions.patterns import wait_category
    from ..operators.joins import broadcast_if_small

    s = fx.fx_sample(spark, sf_dir).drop("base_cntr_value")
    d = counter_delta(s, K, T, ["cntr_value"], header=fx.fx_header(spark, sf_dir))
    d = d.join(broadcast_if_small(WAIT_TYPES.df(spark)), ["snapshot_type_id", "instance_name"])
    return (d.groupBy(time_group(T, 360).alias("time_bucket"), wait_category("wait_type").alias("wait_category"))
            .agg(F.sum("cntr_value_delta").alias("wait_time_ms")))


@register("dash_drive", oracle="""
    SELECT upper(left(path, 3)) AS drive, COUNT(*) AS files, CAST(SUM(length(html)) AS BIGINT) AS bytes
    FROM (SELECT html, CASE page_id % 2 WHEN 0 THEN 'c:\\' ELSE 'e:\\' END
                       || replace(regexp_replace(url, '^[a-z]+://', ''), '/', '\\') AS path FROM pages) p
    GROUP BY 1""")
def q_dash_drive(spark, sf_dir):
    """File count and size per drive, the drive being the first three characters of the path."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    path = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("c:\\")).otherwise(F.lit("e:\\")),
                    F.replace(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit("\\")))
    return (p.select(F.upper(F.substring(path, 1, 3)).alias("drive"), F.length("html").alias("len"))
            .groupBy("drive").agg(F.count(F.lit(1)).alias("files"), F.sum("len").cast("bigint").alias("bytes")))


@register("dash_counters", oracle=with_fixtures(f"""
    SELECT sql_instance, snapshot_type_id, {tg_sql('snapshot_time', 1440)} AS time_bucket,
           AVG(cntr_value) AS avg_value, MAX(cntr_value) AS max_value
    FROM fx_sample GROUP BY 1, 2, 3""", "fx_sample"))
def q_dash_counters(spark, sf_dir):
    """Counter average and maximum per instance, type and day."""
    s = fx.fx_sample(spark, sf_dir)
    return (s.groupBy("sql_instance", "snapshot_type_id", time_group(T, 1440).alias("time_bucket"))
            .agg(F.avg("cntr_value").alias("avg_value"), F.max("cntr_value").alias("max_value")))


@register("dash_file_size", oracle=with_fixtures("""
    SELECT sql_instance, instance_name AS database_name, snapshot_type_id AS file_id,
           MAX(snapshot_time) AS last_snapshot_time, arg_max(cntr_value, snapshot_time) AS size_bytes
    FROM fx_sample GROUP BY 1, 2, 3""", "fx_sample"))
def q_dash_file_size(spark, sf_dir):
    """Latest size per database file (a counter type stands for a file)."""
    s = fx.fx_sample(spark, sf_dir)
    return (s.groupBy("sql_instance", F.col("instance_name").alias("database_name"),
                      F.col("snapshot_type_id").alias("file_id"))
            .agg(F.max(T).alias("last_snapshot_time"), F.max_by("cntr_value", T).alias("size_bytes")))


@register("trend_expiry", oracle=with_fixtures(f"""
    SELECT * FROM (
      SELECT sql_instance, instance_name, snapshot_type_id, {tg_sql('snapshot_time', 60)} AS snapshot_time,
             CAST(SUM(cntr_value_delta) AS BIGINT) AS value_sum, 60 AS interval_minutes,
             {NOW} + INTERVAL 7 DAY AS valid_until
      FROM dl GROUP BY 1, 2, 3, 4
      UNION ALL
      SELECT sql_instance, instance_name, snapshot_type_id, {tg_sql('snapshot_time', 360)},
             CAST(SUM(cntr_value_delta) AS BIGINT), 360, {NOW} + INTERVAL 90 DAY
      FROM dl GROUP BY 1, 2, 3, 4) t
    WHERE NOT (TIMESTAMP '2024-02-10 00:00:00' > valid_until)""", "fx_sample", "fx_header", extra=[HP, _DELTA_CTE]))
def q_trend_expiry(spark, sf_dir):
    """Trend tiers with their own expiry (7 and 90 days) evaluated ten days later: only
    the long-lived tier remains (K5)."""
    from ..operators.retention import expire_trends

    d = _deltas(spark, sf_dir)
    tiers = [trend_rollup(d, K, "cntr_value_delta", m, days, NOW_PY) for m, days in ((60, 7), (360, 90))]
    t = tiers[0].unionByName(tiers[1]).select(*K, T, "value_sum", "interval_minutes", "valid_until")
    return expire_trends(t, "2024-02-10 00:00:00")
