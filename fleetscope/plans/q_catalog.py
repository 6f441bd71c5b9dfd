"""Query: the shipped check catalogue evaluated over the fleet.

Check families computed from the derived telemetry: cooked counters and
derived rates (mean since the last check), check execution time, action-queue
counts, disk free space and days until full (expanded per volume) and blocked
processes. Values are exact means in 1e-5 units.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators.growth import growth
from ..operators.joins import broadcast_if_small
from ..operators.rates import cook_counters
from ..sources import fixtures as fx
from .config import COUNTER_DIM, Relation
from .fixture_sql import with_fixtures
from .q_dims import _QUEUE_CTE, _queue
from .q_checks import status_sql
from .q_rates import _COOK_CTE, _COOK_SQL_VALUE, _MEAN_COUNTER, _RATES_BODY, HP, prev_join, q_counter_rates
from .registry import register

T = "snapshot_time"
WINDOW_START = "2024-01-30 00:00:00"
WINDOW_END = "2024-01-31 00:00:00"
EDGE_SINCE = "2001-01-01 00:00:00"

CATALOGUE = Relation("check_name string, check_threshold_warning string, check_threshold_critical string",
                     [(n, w, c) for n, _f, w, c, _e, _b in ck.SHIPPED_CHECKS])
# Rate name -> catalogue name where they differ.
RATE_TO_CHECK = {"SQL Re-Compilation Rate": "SQL Re-Compilations Rate"}


def _mean_sql(v: str) -> str:
    return (f"CAST(CAST(floor((2 * SUM(CAST(round({v} * 100000) AS BIGINT)) + COUNT({v})) / (2 * COUNT({v}))) "
            f"AS DECIMAL(28,0)) * CAST(0.00001 AS DECIMAL(6,5)) AS DECIMAL(28,5))")


def _values(spark, sf_dir):
    in_window = (F.col(T) > F.lit(WINDOW_START).cast("timestamp_ntz")) & \
                (F.col(T) <= F.lit(WINDOW_END).cast("timestamp_ntz"))
    s, n = ck.exact_mean("cntr_value_calculated")
    # cooked counters
    samples = fx.fx_sample(spark, sf_dir).join(broadcast_if_small(COUNTER_DIM.df(spark)), "snapshot_type_id")
    cooked = cook_counters(samples, fx.SAMPLE_KEYS, T, header=fx.fx_header(spark, sf_dir)).filter(in_window)
    counters = (cooked.groupBy("sql_instance", F.col("counter_name").alias("check_template"))
                .agg(s.alias("_s"), n.alias("_n")))
    # derived rates
    rates = q_counter_rates(spark, sf_dir).filter(in_window)
    rate_name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RATE_TO_CHECK.items() for x in kv]),
                                        F.col("counter_name")), F.col("counter_name"))
    rates = rates.groupBy("sql_instance", rate_name.alias("check_template")).agg(s.alias("_s"), n.alias("_n"))
    means = counters.unionByName(rates).select(
        "sql_instance", "check_template", F.col("check_template").alias("check_name"),
        ck.exact_mean_value("_s", "_n").alias("check_value"))
    # check execution time
    exec_t = (fx.fx_check(spark, sf_dir).filter(in_window).groupBy("sql_instance")
              .agg(F.max("n").cast("decimal(28,5)").alias("check_value"))
              .select("sql_instance", F.lit("Check execution time").alias("check_template"),
                      F.lit("Check execution time").alias("check_name"), "check_value"))
    # action queue
    q = _queue(spark, sf_dir)
    queue = q.groupBy("sql_instance").agg(
        F.count_if(F.col("exec_status").isNull()).alias("Queued actions not processed"),
        F.count_if(F.col("exec_status") == "RETRYING").alias("Action queue pending items"),
        F.count_if(F.col("exec_status") == "FAILED").alias("Action queue failed items"))
    names = ["Queued actions not processed", "Action queue pending items", "Action queue failed items"]
    queue = queue.unpivot(["sql_instance"], names, "check_template", "check_value") \
                 .select("sql_instance", "check_template", F.col("check_template").alias("check_name"),
                         F.col("check_value").cast("decimal(28,5)").alias("check_value"))
    # disks, expanded per volume
    g = growth(fx.fx_volume(spark, sf_dir), ["volume_id"], T, "free_bytes", total="total_bytes", direction=-1,
               remaining="free_bytes")
    inst = F.concat(F.lit("srv"), (F.col("volume_id") % 4).cast("string"))
    vol = F.concat(F.lit("vol"), F.col("volume_id").cast("string"))
    disks = g.select(inst.alias("sql_instance"), F.lit("Disk {DISK} free space %").alias("check_template"),
                     F.replace(F.lit("Disk {DISK} free space %"), F.lit("{DISK}"), vol).alias("check_name"),
                     F.col("free_ratio").cast("decimal(28,5)").alias("check_value")).unionByName(
        g.select(inst.alias("sql_instance"), F.lit("Disk {DISK} days left until full").alias("check_template"),
                 F.replace(F.lit("Disk {DISK} days left until full"), F.lit("{DISK}"), vol).alias("check_name"),
                 F.col("days_until_full").cast("decimal(28,5)").alias("check_value")))
    # blocked processes since the last check
    e = fx.fx_edge(spark, sf_dir).filter(F.col("event_time") >= F.lit(EDGE_SINCE).cast("timestamp_ntz"))
    blocked = (e.groupBy(F.concat(F.lit("srv"), (F.col("monitor_loop") % 4).cast("string")).alias("sql_instance"))
               .agg(F.countDistinct("monitor_loop", "blocked_spid").cast("decimal(28,5)").alias("check_value"))
               .select("sql_instance", F.lit("Blocked Process").alias("check_template"),
                       F.lit("Blocked Process").alias("check_name"), "check_value"))
    return means.unionByName(exec_t).unionByName(queue).unionByName(disks).unionByName(blocked)


def _catalogue_sql() -> str:
    rate_case = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RATE_TO_CHECK.items())
    win = f"snapshot_time > TIMESTAMP '{WINDOW_START}' AND snapshot_time <= TIMESTAMP '{WINDOW_END}'"
    body = f"""
    SELECT v.sql_instance, v.check_template, v.check_name, v.check_value,
           c.check_threshold_warning, c.check_threshold_critical,
           {status_sql('v.check_value', 'c.check_threshold_critical', 'c.check_threshold_warning')} AS check_status
    FROM (
      SELECT sql_instance, counter_name AS check_template, counter_name AS check_name,
             {_mean_sql('cntr_value_calculated')} AS check_value
      FROM (SELECT s.sql_instance, s.snapshot_time, s.counter_name, {_COOK_SQL_VALUE} AS cntr_value_calculated
            {prev_join('cs')}) x
      WHERE {win} GROUP BY 1, 2, 3
      UNION ALL
      SELECT sql_instance, CASE counter_name {rate_case} ELSE counter_name END,
             CASE counter_name {rate_case} ELSE counter_name END, {_mean_sql('cntr_value_calculated')}
      FROM rates WHERE {win} GROUP BY 1, 2, 3
      UNION ALL
      SELECT sql_instance, 'Check execution time', 'Check execution time', CAST(MAX(n) AS DECIMAL(28,5))
      FROM fx_check WHERE {win} GROUP BY 1
      UNION ALL
      SELECT sql_instance, 'Queued actions not processed', 'Queued actions not processed',
             CAST(COUNT(*) FILTER (WHERE exec_status IS NULL) AS DECIMAL(28,5)) FROM q GROUP BY 1
      UNION ALL
      SELECT sql_instance, 'Action queue pending items', 'Action queue pending items',
             CAST(COUNT(*) FILTER (WHERE exec_status = 'RETRYING') AS DECIMAL(28,5)) FROM q GROUP BY 1
      UNION ALL
      SELECT sql_instance, 'Action queue failed items', 'Action queue failed items',
             CAST(COUNT(*) FILTER (WHERE exec_status = 'FAILED') AS DECIMAL(28,5)) FROM q GROUP BY 1
      UNION ALL
      SELECT 'srv' || CAST(volume_id % 4 AS VARCHAR), 'Disk {{DISK}} free space %',
             'Disk vol' || CAST(volume_id AS VARCHAR) || ' free space %',
             CAST(CAST(arg_max(free_bytes, snapshot_time) AS DOUBLE) / CAST(arg_max(total_bytes, snapshot_time) AS DOUBLE)
                  AS DECIMAL(28,5))
      FROM fx_volume GROUP BY volume_id
      UNION ALL
      SELECT 'srv' || CAST(volume_id % 4 AS VARCHAR), 'Disk {{DISK}} days left until full',
             'Disk vol' || CAST(volume_id AS VARCHAR) || ' days left until full',
             CAST(CASE WHEN gpd > 0 THEN cur // gpd ELSE 9999 END AS DECIMAL(28,5))
      FROM (SELECT volume_id, arg_max(free_bytes, snapshot_time) AS cur,
                   CASE WHEN date_diff('day', MIN(snapshot_time), MAX(snapshot_time)) > 0
                         AND arg_min(free_bytes, snapshot_time) - arg_max(free_bytes, snapshot_time) > 0
                        THEN (arg_min(free_bytes, snapshot_time) - arg_max(free_bytes, snapshot_time))
                             // date_diff('day', MIN(snapshot_time), MAX(snapshot_time)) ELSE 0 END AS gpd
            FROM fx_volume GROUP BY volume_id) g
      UNION ALL
      SELECT 'srv' || CAST(monitor_loop % 4 AS VARCHAR), 'Blocked Process', 'Blocked Process',
             CAST(COUNT(DISTINCT (monitor_loop, blocked_spid)) AS DECIMAL(28,5))
      FROM fx_edge WHERE event_time >= TIMESTAMP '{EDGE_SINCE}' GROUP BY 1
    ) v JOIN ({CATALOGUE.sql()}) c ON c.check_name = v.check_template"""
    return with_fixtures(body, "fx_sample", "fx_header", "fx_check", "fx_volume", "fx_edge",
                         extra=[HP, _COOK_CTE, _MEAN_COUNTER, ("rates", _RATES_BODY), _QUEUE_CTE])


@register("shipped_checks", oracle=_catalogue_sql())
def q_shipped_checks(spark, sf_dir):
    return ck.evaluate_checks(_values(spark, sf_dir), CATALOGUE.df(spark))
