"""Queries over counter samples: deltas, cooking, rates, buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import time_group
from ..operators.deltas import counter_delta, gauge_delta
from ..sources import fixtures as fx
from .fixture_sql import with_fixtures
from .registry import register

K = fx.SAMPLE_KEYS

_HP = ("hp", """SELECT sql_instance, snapshot_type_id, snapshot_time,
                lag(snapshot_time) OVER (PARTITION BY sql_instance, snapshot_type_id
                                         ORDER BY snapshot_time) AS prev_time
         FROM fx_header""")
_PREV_JOIN = """FROM fx_sample s
    JOIN hp ON hp.sql_instance = s.sql_instance AND hp.snapshot_type_id = s.snapshot_type_id
           AND hp.snapshot_time = s.snapshot_time
    LEFT JOIN fx_sample p ON p.sql_instance = s.sql_instance AND p.instance_name = s.instance_name
           AND p.snapshot_type_id = s.snapshot_type_id AND p.snapshot_time = hp.prev_time"""


# --- M1 / M1n / M3 ---------------------------------------------------------------------------

@register("counter_delta", headline=True, oracle=with_fixtures(f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time,
           s.cntr_value, s.base_cntr_value,
           CASE WHEN p.cntr_value IS NOT NULL AND s.cntr_value > p.cntr_value
                THEN s.cntr_value - p.cntr_value ELSE 0 END AS cntr_value_delta,
           CASE WHEN p.base_cntr_value IS NOT NULL AND s.base_cntr_value > p.base_cntr_value
                THEN s.base_cntr_value - p.base_cntr_value ELSE 0 END AS base_cntr_value_delta,
           date_diff('second', p.snapshot_time, s.snapshot_time) AS delta_seconds
    {_PREV_JOIN}""", "fx_sample", "fx_header", extra=[_HP]))
def q_counter_delta(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir)
    return counter_delta(s, K, "snapshot_time", ["cntr_value", "base_cntr_value"],
                         header=fx.fx_header(spark, sf_dir))


@register("counter_delta_first_value", oracle=with_fixtures(f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time, s.cntr_value,
           CASE WHEN p.cntr_value IS NULL THEN s.cntr_value
                WHEN s.cntr_value > p.cntr_value THEN s.cntr_value - p.cntr_value ELSE 0 END
               AS cntr_value_delta
    {_PREV_JOIN}""", "fx_sample", "fx_header", extra=[_HP]))
def q_counter_delta_first_value(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir).drop("base_cntr_value")
    return counter_delta(s, K, "snapshot_time", ["cntr_value"], first="value",
                         header=fx.fx_header(spark, sf_dir)).drop("delta_seconds")


# --- M2 ----------------------------------------------------------------------------------------

@register("gauge_delta", oracle=with_fixtures(f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time, s.cntr_value,
           COALESCE(s.cntr_value - p.cntr_value, 0) AS cntr_value_delta
    {_PREV_JOIN}""", "fx_sample", "fx_header", extra=[_HP]))
def q_gauge_delta(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir).drop("base_cntr_value")
    return gauge_delta(s, K, "snapshot_time", ["cntr_value"], header=fx.fx_header(spark, sf_dir))


# --- T1 -----------------------------------------------------------------------------------------

def _tg_sql(n: int) -> str:
    return with_fixtures(f"""
        SELECT sql_instance,
               TIMESTAMP '1900-01-01 00:00:00'
                 + to_minutes(CAST(floor(date_diff('minute', TIMESTAMP '1900-01-01 00:00:00', ts) / {n})
                                   * {n} AS BIGINT)) AS time_bucket,
               COUNT(*) AS events, CAST(SUM(v100) AS BIGINT) AS sum_v100
        FROM fx_ev GROUP BY ALL""", "fx_ev")


@register("time_group", headline=True, oracle=_tg_sql(15))
def q_time_group(spark, sf_dir):
    ev = fx.fx_ev(spark, sf_dir)
    return (ev.groupBy("sql_instance", time_group("ts", 15).alias("time_bucket"))
            .agg(F.count(F.lit(1)).alias("events"), F.sum("v100").alias("sum_v100")))


@register("time_group_7", oracle=_tg_sql(7))
def q_time_group_7(spark, sf_dir):
    ev = fx.fx_ev(spark, sf_dir)
    return (ev.groupBy("sql_instance", time_group("ts", 7).alias("time_bucket"))
            .agg(F.count(F.lit(1)).alias("events"), F.sum("v100").alias("sum_v100")))


# --- J5 incremental form ---------------------------------------------------------------------------

_INC_CUTOFF = "2024-01-20 00:00:00"


@register("counter_delta_incremental", oracle=with_fixtures(f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time,
           s.cntr_value, s.base_cntr_value,
           CASE WHEN p.cntr_value IS NOT NULL AND s.cntr_value > p.cntr_value
                THEN s.cntr_value - p.cntr_value ELSE 0 END AS cntr_value_delta,
           CASE WHEN p.base_cntr_value IS NOT NULL AND s.base_cntr_value > p.base_cntr_value
                THEN s.base_cntr_value - p.base_cntr_value ELSE 0 END AS base_cntr_value_delta,
           date_diff('second', p.snapshot_time, s.snapshot_time) AS delta_seconds
    {_PREV_JOIN}
    WHERE s.snapshot_time >= TIMESTAMP '{_INC_CUTOFF}'""", "fx_sample", "fx_header", extra=[_HP]))
def q_counter_delta_incremental(spark, sf_dir):
    from ..operators.deltas import counter_delta_incremental

    s = fx.fx_sample(spark, sf_dir)
    cut = F.lit(_INC_CUTOFF).cast("timestamp_ntz")
    stored, new = s.filter(F.col("snapshot_time") < cut), s.filter(F.col("snapshot_time") >= cut)
    h = fx.fx_header(spark, sf_dir)
    return counter_delta_incremental(new, stored, K, "snapshot_time", ["cntr_value", "base_cntr_value"],
                                     new_header=h.filter(F.col("snapshot_time") >= cut),
                                     stored_header=h.filter(F.col("snapshot_time") < cut))
