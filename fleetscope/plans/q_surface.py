"""Queries: SQL functions, trend tiers, baseline rules, shipped extracts, stored events through the event source."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.sql_surface import register_functions
from ..functions.timeops import trunc_ntz
from ..operators import dims
from ..operators.trends import trend_tiers
from ..session import scratch_path
from ..sources import event_source, extracts
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .fixture_sql import with_fixtures
from .registry import register
from .sqlbits import tg_sql


@register("sql_functions", oracle="""
    SELECT o_orderkey, (o_orderkey % 240000) // 10000 * 3600 + (o_orderkey % 240000) // 100 % 100 * 60 + o_orderkey % 240000 % 100 AS seconds,
           CAST(o_orderdate AS TIMESTAMP) - to_minutes(CAST(o_custkey % 700 AS BIGINT)) AS utc,
           date_diff('day', CAST(o_orderdate AS TIMESTAMP) - to_minutes(CAST(o_custkey % 700 AS BIGINT)), TIMESTAMP '1998-12-31 23:59:00') AS days,
           md5(o_clerk) AS clerk
    FROM (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority AS o_clerk FROM orders) o""")
def q_sql_functions(spark, sf_dir):
    register_functions(spark, ["hhmmss_to_seconds", "to_utc", "datediff_day", "anonymise"], prefix="fleet_")
    read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").createOrReplaceTempView("fleet_orders")
    return spark.sql("""
        SELECT o_orderkey, fleet_hhmmss_to_seconds(CAST(o_orderkey % 240000 AS INT)) AS seconds,
               fleet_to_utc(CAST(o_orderdate AS TIMESTAMP_NTZ), CAST(o_custkey % 700 AS INT)) AS utc,
               fleet_datediff_day(fleet_to_utc(CAST(o_orderdate AS TIMESTAMP_NTZ), CAST(o_custkey % 700 AS INT)),
                                  TIMESTAMP_NTZ '1998-12-31 23:59:00') AS days,
               fleet_anonymise(o_orderpriority) AS clerk
        FROM fleet_orders""")


NOW = dt.datetime(2024, 2, 1)


def _tier_sql(minutes: int, days: int) -> str:
    bucket = tg_sql("ts", minutes)
    return f"""SELECT event_type, {bucket} AS ts, {minutes} AS interval_minutes, AVG(CAST(v AS DOUBLE)) AS value_avg, MIN(v) AS value_min,
                      MAX(v) AS value_max, CAST(SUM(v) AS BIGINT) AS value_sum, COUNT(v) AS value_count,
                      arg_max(v, (ts, event_id)) AS value_last, TIMESTAMP '{NOW}' + INTERVAL {days} DAY AS valid_until
               FROM (SELECT event_id, event_type, ts, CAST(round(value * 100) AS BIGINT) AS v FROM events) e
               GROUP BY event_type, {bucket}"""


@register("trend_tiers", oracle=" UNION ALL ".join(_tier_sql(m, d) for m, d in ((1, 7), (5, 90), (60, 720))))
def q_trend_tiers(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "ts", "value")
    e = e.select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
    return trend_tiers(e, ["event_type"], "v", NOW, time="ts", tie="event_id")


_BASELINES = """SELECT o_orderkey AS baseline_id, concat('srv', CAST(o_custkey AS VARCHAR)) AS sql_instance,
                       date_trunc('month', o_orderdate)::TIMESTAMP AS baseline_start,
                       date_trunc('month', o_orderdate)::TIMESTAMP + to_days(CAST(o_orderkey % 90 AS BIGINT)) AS baseline_end FROM orders"""


@register("baseline_rules", oracle=f"""
    WITH b AS ({_BASELINES}), old AS (SELECT baseline_id, baseline_start + to_days(CAST(baseline_id % 2 AS BIGINT)) AS s,
                                             baseline_end + to_days(CAST(baseline_id % 5 // 4 AS BIGINT)) AS e FROM b WHERE baseline_id % 3 = 0)
    SELECT 'OVERLAPPING_BASELINE' AS rule, concat_ws('|', b.sql_instance, CAST(b.baseline_id AS VARCHAR)) AS subject, COUNT(*) AS detail
    FROM b JOIN b o ON o.sql_instance = b.sql_instance AND o.baseline_end > b.baseline_start
                   AND (o.baseline_start, o.baseline_id) < (b.baseline_start, b.baseline_id) AND o.baseline_end > o.baseline_start
    WHERE b.baseline_end > b.baseline_start GROUP BY b.sql_instance, b.baseline_id
    UNION ALL
    SELECT 'BASELINE_DATES_CHANGED', CAST(b.baseline_id AS VARCHAR), CAST(b.baseline_start <> s AS BIGINT) + CAST(b.baseline_end <> e AS BIGINT)
    FROM b JOIN old USING (baseline_id) WHERE b.baseline_start <> s OR b.baseline_end <> e""")
def q_baseline_rules(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    month = trunc_ntz("month", F.col("o_orderdate").cast("timestamp_ntz"))
    b = o.select(F.col("o_orderkey").alias("baseline_id"), F.concat(F.lit("srv"), F.col("o_custkey").cast("string")).alias("sql_instance"),
                 month.alias("baseline_start"), F.timestamp_add("DAY", F.col("o_orderkey") % 90, month).alias("baseline_end"))
    old = b.filter(F.col("baseline_id") % 3 == 0).select(
        "baseline_id", F.timestamp_add("DAY", F.col("baseline_id") % 2, F.col("baseline_start")).alias("baseline_start"),
        F.timestamp_add("DAY", (F.col("baseline_id") % 5 == 4).cast("int"), F.col("baseline_end")).alias("baseline_end"))
    return dims.baseline_overlaps(b).unionByName(dims.baseline_date_changes(b, old))


EXTRACT_RUNS = (dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 21, 12))


def _views(spark, sf_dir):
    checks = fx.fx_check(spark, sf_dir)
    samples = fx.fx_sample(spark, sf_dir)
    return {
        "performance_counters": lambda: samples.select(
            "sql_instance", F.lit("Databases").alias("object_name"), F.concat(F.lit("counter "), F.col("snapshot_type_id")).alias("counter_name"), "instance_name",
            F.col("cntr_value").alias("cntr_value_calculated"), "snapshot_time"),
        "checks": lambda: checks.select("sql_instance", "snapshot_time", F.concat(F.lit("check "), F.col("check_id")).alias("check_name"), "check_value", "check_status",
                                        F.lit(False).alias("status_change")),
        "os_volume": lambda: fx.fx_volume(spark, sf_dir),
    }


@register("shipped_extracts", oracle=with_fixtures(f"""
    SELECT 'performance_counters' AS extract, COUNT(*) AS n, MIN(snapshot_time) AS first_time, MAX(snapshot_time) AS last_time
    FROM fx_sample WHERE snapshot_time <= TIMESTAMP '{EXTRACT_RUNS[-1]}'
    UNION ALL
    SELECT 'checks', COUNT(*), MIN(snapshot_time), MAX(snapshot_time) FROM fx_check WHERE snapshot_time <= TIMESTAMP '{EXTRACT_RUNS[-1]}'
    UNION ALL SELECT 'os_volume', COUNT(*), MIN(snapshot_time), MAX(snapshot_time) FROM fx_volume""", "fx_sample", "fx_check", "fx_volume"))
def q_shipped_extracts(spark, sf_dir):
    """Two windows of each extract and a repeated run of the second one, read back."""
    import uuid

    base = scratch_path(spark, f"extracts-{uuid.uuid4().hex}")
    views = _views(spark, sf_dir)
    for now in (*EXTRACT_RUNS, EXTRACT_RUNS[-1]):
        extracts.run_extracts(views, base, now)
    out = None
    for name in views:
        part = extracts.read_extract(spark, base, name).agg(F.count(F.lit(1)).alias("n"), F.min("snapshot_time").alias("first_time"),
                                                            F.max("snapshot_time").alias("last_time"))
        part = part.select(F.lit(name).alias("extract"), "n", "first_time", "last_time")
        out = part if out is None else out.unionByName(part)
    return out


@register("event_source", oracle="""
    SELECT event_type AS session_name, event_id, ts AS event_time, concat('object ', CAST(user_id % 3 AS VARCHAR)) AS object_name,
           concat('<event value="', CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), '"/>') AS event_data
    FROM events WHERE event_type <> 'click' OR ts > TIMESTAMP '2024-01-16 00:00:00'""")
def q_event_source(spark, sf_dir):
    """The events table as a store of sessions; all sessions are read from the begin but one, which has a stored offset."""
    import uuid

    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "ts", "value")
    rows = e.select(F.col("event_type").alias("session_name"), "event_id", F.col("ts").cast("timestamp_ntz").alias("event_time"),
                    F.concat(F.lit("object "), (F.col("user_id") % 3).cast("string")).alias("object_name"),
                    F.concat(F.lit('<event value="'), F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit('"/>')).alias("event_data"))
    counts = {r.session_name: r["count"] for r in rows.groupBy("session_name").count().collect()}  # one row for each session
    path = scratch_path(spark, f"events-{uuid.uuid4().hex}")
    event_source.write_events(rows, path, counts)
    return event_source.stored_events(spark, path, since={"click": "2024-01-16T00:00:00"})
