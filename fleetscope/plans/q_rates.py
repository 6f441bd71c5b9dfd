"""Queries: counter cooking, waits, procedures, file IO, index usage, rates,
memory buckets, CPU split, wait categories and enum decodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import trunc_ntz

from ..functions import enums
from ..functions.patterns import wait_category, wait_category_sql
from ..operators.deltas import active_since, counter_delta, wait_delta
from ..operators.joins import broadcast_if_small
from ..operators.rates import (
    cook_counters, counter_rates, cpu_split, index_ratios, io_latency, memory_clerk_totals,
    minor_bucket, per_exec, wait_rate,
)
from ..sources import fixtures as fx
from .config import COUNTER_DIM, RATE_COUNTERS, WAIT_TYPES, WAIT_VOCABULARY
from .fixture_sql import with_fixtures
from .registry import register

K = fx.SAMPLE_KEYS
T = "snapshot_time"

HP = ("hp", """SELECT sql_instance, snapshot_type_id, snapshot_time,
                lag(snapshot_time) OVER (PARTITION BY sql_instance, snapshot_type_id
                                         ORDER BY snapshot_time) AS prev_time
         FROM fx_header""")


def prev_join(src: str) -> str:
    return f"""FROM {src} s
    JOIN hp ON hp.sql_instance = s.sql_instance AND hp.snapshot_type_id = s.snapshot_type_id
           AND hp.snapshot_time = s.snapshot_time
    LEFT JOIN {src} p ON p.sql_instance = s.sql_instance AND p.instance_name = s.instance_name
           AND p.snapshot_type_id = s.snapshot_type_id AND p.snapshot_time = hp.prev_time"""


def pos_delta_sql(c: str, first: str = "0") -> str:
    return (f"CASE WHEN p.{c} IS NULL THEN {first} WHEN s.{c} > p.{c} THEN s.{c} - p.{c} ELSE 0 END")


SECS = "date_diff('second', p.snapshot_time, s.snapshot_time)"


# --- M4 counter cooking ----------------------------------------------------------------------

def _cook_input(spark, sf_dir):
    return fx.fx_sample(spark, sf_dir).join(broadcast_if_small(COUNTER_DIM.df(spark)), "snapshot_type_id")


_COOK_SQL_VALUE = f"""CASE
      WHEN s.object_name = 'Batch Resp Statistics' THEN
           CASE WHEN p.cntr_value IS NOT NULL AND s.cntr_value > p.cntr_value
                THEN CAST(s.cntr_value - p.cntr_value AS DOUBLE) ELSE 0.0 END
      WHEN s.cntr_type = 65792 THEN CAST(COALESCE(s.cntr_value, 0) AS DOUBLE)
      WHEN s.cntr_type = 272696576 THEN
           CASE WHEN p.cntr_value IS NOT NULL AND s.cntr_value > p.cntr_value
                THEN CAST(s.cntr_value - p.cntr_value AS DOUBLE) / CAST({SECS} AS DOUBLE) ELSE 0.0 END
      WHEN s.cntr_type = 537003264 THEN
           COALESCE(CAST(100 AS DOUBLE) * CAST(s.cntr_value AS DOUBLE)
                    / CAST(NULLIF(s.base_cntr_value, 0) AS DOUBLE), 0.0)
      WHEN s.cntr_type = 1073874176 THEN
           CASE WHEN p.cntr_value IS NOT NULL AND s.cntr_value > p.cntr_value
                THEN COALESCE(CAST(s.cntr_value - p.cntr_value AS DOUBLE)
                              / CAST(NULLIF(s.base_cntr_value - p.base_cntr_value, 0) AS DOUBLE)
                              / CAST({SECS} AS DOUBLE), 0.0)
                ELSE 0.0 END
      ELSE CAST(s.cntr_value AS DOUBLE) END"""

_COOK_CTE = ("cs", "SELECT f.*, d.object_name, d.counter_name, d.cntr_type FROM fx_sample f "
                   f"JOIN ({COUNTER_DIM.sql()}) d USING (snapshot_type_id)")


@register("cook_counters", headline=True, oracle=with_fixtures(f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time, s.cntr_value,
           s.base_cntr_value, s.object_name, s.counter_name, s.cntr_type,
           {_COOK_SQL_VALUE} AS cntr_value_calculated
    {prev_join('cs')}""", "fx_sample", "fx_header", extra=[HP, _COOK_CTE]))
def q_cook_counters(spark, sf_dir):
    return cook_counters(_cook_input(spark, sf_dir), K, T, header=fx.fx_header(spark, sf_dir))


# --- M12 derived rates (pivot / unpivot) -------------------------------------------------------

def _one_rate(name: str, counter: str, per: str) -> str:
    """A rate by itself: the ratio of two mean counters of a key at a time; 0 where there is nothing to divide by."""
    return f"""
    SELECT k.sql_instance, k.instance_name, k.snapshot_time, '{name}' AS counter_name,
           CASE WHEN b.mean > 0 THEN a.mean / b.mean ELSE 0.0 END AS cntr_value_calculated
    FROM (SELECT DISTINCT sql_instance, instance_name, snapshot_time FROM mean_counter) k
    LEFT JOIN mean_counter a ON a.counter_name = '{counter}' AND a.sql_instance = k.sql_instance
         AND a.instance_name = k.instance_name AND a.snapshot_time = k.snapshot_time
    LEFT JOIN mean_counter b ON b.counter_name = '{per}' AND b.sql_instance = k.sql_instance
         AND b.instance_name = k.instance_name AND b.snapshot_time = k.snapshot_time
    WHERE NOT (b.mean > 0 AND a.mean IS NULL) OR b.mean IS NULL"""


_MEAN_COUNTER = ("mean_counter", f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_time, r.counter_name,
           AVG(CASE WHEN s.cntr_value > p.cntr_value
                    THEN CAST(s.cntr_value - p.cntr_value AS DOUBLE) / {SECS} ELSE 0.0 END) AS mean
    {prev_join('fx_sample')} JOIN ({RATE_COUNTERS.sql()}) r ON r.snapshot_type_id = s.snapshot_type_id
    GROUP BY s.sql_instance, s.instance_name, s.snapshot_time, r.counter_name""")
_RATES_BODY = "\n    UNION ALL".join((
    _one_rate("Full Scan Rate", "Full Scans/sec", "Index Searches/sec"),
    _one_rate("SQL Compilations Rate", "SQL Compilations/sec", "Batch Requests/Sec"),
    _one_rate("SQL Re-Compilation Rate", "SQL Re-Compilations/sec", "SQL Compilations/sec"),
    _one_rate("Page Split Rate", "Page Splits/sec", "Batch Requests/Sec"),
    _one_rate("Page Lookups Rate", "Page lookups/sec", "Batch Requests/Sec"),
))


@register("counter_rates", oracle=with_fixtures(_RATES_BODY, "fx_sample", "fx_header",
                                                extra=[HP, _MEAN_COUNTER]))
def q_counter_rates(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir).join(broadcast_if_small(RATE_COUNTERS.df(spark)), "snapshot_type_id")
    s = s.withColumn("object_name", F.lit("SQLServer:SQL Statistics")) \
         .withColumn("cntr_type", F.lit(272696576))
    cooked = cook_counters(s, [*K, "counter_name"], T, header=fx.fx_header(spark, sf_dir))
    return counter_rates(cooked, ["sql_instance", "instance_name", T])


# --- M6 / M9 waits ----------------------------------------------------------------------------

def _wait_samples(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir)
    return s.select(*K, T, F.col("base_cntr_value").alias("waiting_tasks_count"),
                    F.col("cntr_value").alias("wait_time_ms"),
                    F.floor(F.col("cntr_value") / 4).alias("signal_wait_time_ms"))


_WAIT_CTE = ("ws", """SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time,
                      base_cntr_value AS waiting_tasks_count, cntr_value AS wait_time_ms,
                      CAST(floor(cntr_value / 4) AS BIGINT) AS signal_wait_time_ms FROM fx_sample""")

_WAIT_DELTA_SQL = f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time,
           s.waiting_tasks_count, s.wait_time_ms, s.signal_wait_time_ms,
           {pos_delta_sql('waiting_tasks_count')} AS waiting_tasks_count_delta,
           {pos_delta_sql('wait_time_ms')} AS wait_time_ms_delta,
           {pos_delta_sql('signal_wait_time_ms')} AS signal_wait_time_ms_delta,
           {SECS} AS delta_seconds
    {prev_join('ws')}
    WHERE p.waiting_tasks_count IS NOT NULL AND s.waiting_tasks_count > p.waiting_tasks_count"""


@register("wait_delta", oracle=with_fixtures(_WAIT_DELTA_SQL, "fx_sample", "fx_header", extra=[HP, _WAIT_CTE]))
def q_wait_delta(spark, sf_dir):
    return wait_delta(_wait_samples(spark, sf_dir), K, T, "waiting_tasks_count",
                      ["wait_time_ms", "signal_wait_time_ms"], header=fx.fx_header(spark, sf_dir))


@register("wait_rate", oracle=with_fixtures(f"""
    SELECT d.*, w.wait_type,
           CAST(d.wait_time_ms_delta AS DOUBLE) / CAST(NULLIF(d.delta_seconds, 0) AS DOUBLE)
               AS wait_time_ms_per_second,
           {wait_category_sql('w.wait_type')} AS wait_category
    FROM ({_WAIT_DELTA_SQL}) d JOIN ({WAIT_TYPES.sql()}) w
      ON w.snapshot_type_id = d.snapshot_type_id AND w.instance_name = d.instance_name""",
    "fx_sample", "fx_header", extra=[HP, _WAIT_CTE]))
def q_wait_rate(spark, sf_dir):
    d = wait_delta(_wait_samples(spark, sf_dir), K, T, "waiting_tasks_count",
                   ["wait_time_ms", "signal_wait_time_ms"], header=fx.fx_header(spark, sf_dir))
    d = d.join(broadcast_if_small(WAIT_TYPES.df(spark)), ["snapshot_type_id", "instance_name"])
    return wait_rate(d, "wait_type")


# --- F13 wait classifier over a whole table ----------------------------------------------------

def _vocab_sql_case(idx: str) -> str:
    arr = ", ".join("'" + w + "'" for w in WAIT_VOCABULARY)
    return f"list_extract([{arr}], CAST({idx} AS INTEGER) + 1)"


@register("wait_category", oracle=f"""
    SELECT wait_type, {wait_category_sql('wait_type')} AS wait_category, COUNT(*) AS events,
           CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS wait_time_ms
    FROM (SELECT {_vocab_sql_case(f'event_id % {len(WAIT_VOCABULARY)}')} AS wait_type, value FROM events) e
    GROUP BY wait_type""")
def q_wait_category(spark, sf_dir):
    from ..sources.tables import read_table

    vocab = F.array(*[F.lit(w) for w in WAIT_VOCABULARY])
    ev = read_table(spark, sf_dir, "events", "event_id", "value")
    typed = ev.select(F.element_at(vocab, (F.col("event_id") % len(WAIT_VOCABULARY) + 1).cast("int"))
                      .alias("wait_type"), "value")
    return (typed.groupBy("wait_type")
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("wait_time_ms"))
            .select("wait_type", wait_category("wait_type").alias("wait_category"), "events", "wait_time_ms"))


# --- M7 / M10 procedures -------------------------------------------------------------------------

def _proc_samples(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir)
    return s.select(*K, T,
                    F.timestamp_add("MINUTE", (F.col("base_cntr_value") / 10).cast("bigint"),
                                    trunc_ntz("day", T)).alias("last_execution_time"),
                    F.col("base_cntr_value").alias("execution_count"),
                    F.col("cntr_value").alias("total_worker_time"))


_PROC_CTE = ("ps", """SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time,
                      date_trunc('day', snapshot_time) + to_minutes(CAST(floor(base_cntr_value / 10) AS BIGINT))
                          AS last_execution_time,
                      base_cntr_value AS execution_count, cntr_value AS total_worker_time FROM fx_sample""")

_ACTIVE_SQL = f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time, s.last_execution_time,
           s.execution_count, s.total_worker_time,
           {pos_delta_sql('execution_count', 's.execution_count')} AS execution_count_delta,
           {pos_delta_sql('total_worker_time', 's.total_worker_time')} AS total_worker_time_delta
    {prev_join('ps')}
    WHERE p.sql_instance IS NULL OR s.last_execution_time > p.last_execution_time"""


@register("active_since", oracle=with_fixtures(_ACTIVE_SQL, "fx_sample", "fx_header", extra=[HP, _PROC_CTE]))
def q_active_since(spark, sf_dir):
    return active_since(_proc_samples(spark, sf_dir), K, T, "last_execution_time",
                        ["execution_count", "total_worker_time"], header=fx.fx_header(spark, sf_dir))


@register("per_exec", oracle=with_fixtures(f"""
    SELECT a.*, CAST(total_worker_time_delta AS DOUBLE) / CAST(NULLIF(execution_count_delta, 0) AS DOUBLE)
               AS total_worker_time_delta_per_exec
    FROM ({_ACTIVE_SQL}) a""", "fx_sample", "fx_header", extra=[HP, _PROC_CTE]))
def q_per_exec(spark, sf_dir):
    a = active_since(_proc_samples(spark, sf_dir), K, T, "last_execution_time",
                     ["execution_count", "total_worker_time"], header=fx.fx_header(spark, sf_dir))
    return per_exec(a, ["total_worker_time_delta"])


# --- M8 file IO ----------------------------------------------------------------------------------

_FILE_COLS = ["num_of_reads", "io_stall_read_ms", "num_of_bytes_read", "num_of_writes",
              "io_stall_write_ms", "num_of_bytes_written"]


def _file_samples(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir)
    return s.select(*K, T,
                    F.col("base_cntr_value").alias("num_of_reads"),
                    F.col("cntr_value").alias("io_stall_read_ms"),
                    (F.col("cntr_value") * 512).alias("num_of_bytes_read"),
                    (F.col("base_cntr_value") * 2).alias("num_of_writes"),
                    F.floor(F.col("cntr_value") / 3).alias("io_stall_write_ms"),
                    (F.col("cntr_value") * 128).alias("num_of_bytes_written"))


_FILE_CTE = ("fs", """SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time,
                      base_cntr_value AS num_of_reads, cntr_value AS io_stall_read_ms,
                      cntr_value * 512 AS num_of_bytes_read, base_cntr_value * 2 AS num_of_writes,
                      CAST(floor(cntr_value / 3) AS BIGINT) AS io_stall_write_ms,
                      cntr_value * 128 AS num_of_bytes_written FROM fx_sample""")


def _ratio_sql(num: str, den: str) -> str:
    return f"CASE WHEN COALESCE({den}, 0) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END"


@register("io_latency", headline=True, oracle=with_fixtures(f"""
    SELECT d.*,
           {_ratio_sql('io_stall_read_ms_delta', 'num_of_reads_delta')} AS io_latency_read,
           {_ratio_sql('io_stall_write_ms_delta', 'num_of_writes_delta')} AS io_latency_write,
           {_ratio_sql('num_of_bytes_read_delta', 'delta_seconds')} AS bytes_read_per_second,
           {_ratio_sql('num_of_bytes_written_delta', 'delta_seconds')} AS bytes_written_per_second
    FROM (SELECT s.*, {', '.join(f'{pos_delta_sql(c)} AS {c}_delta' for c in _FILE_COLS)},
                 {SECS} AS delta_seconds
          {prev_join('fs')}) d""", "fx_sample", "fx_header", extra=[HP, _FILE_CTE]))
def q_io_latency(spark, sf_dir):
    d = counter_delta(_file_samples(spark, sf_dir), K, T, _FILE_COLS, header=fx.fx_header(spark, sf_dir))
    return io_latency(d)


# --- M11 index usage --------------------------------------------------------------------------------

_IDX_COLS = ["user_seeks", "user_scans", "user_lookups", "user_updates"]


def _index_samples(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir)
    return s.select(*K, T, F.col("cntr_value").alias("user_seeks"),
                    F.col("base_cntr_value").alias("user_scans"),
                    (F.col("cntr_value") % 7).alias("user_lookups"),
                    (F.col("base_cntr_value") * 3).alias("user_updates"))


_IDX_CTE = ("ix", """SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time,
                     cntr_value AS user_seeks, base_cntr_value AS user_scans, cntr_value % 7 AS user_lookups,
                     base_cntr_value * 3 AS user_updates FROM fx_sample""")


@register("index_ratios", oracle=with_fixtures(f"""
    SELECT d.*,
      {_ratio_sql('user_updates', 'user_seeks + user_lookups + user_scans + user_updates')} AS update_ratio,
      {_ratio_sql('user_scans', 'user_seeks + user_scans + user_lookups')} AS scan_to_seek_ratio,
      {_ratio_sql('user_updates_delta', 'user_seeks_delta + user_lookups_delta + user_scans_delta + user_updates_delta')}
          AS update_ratio_delta,
      {_ratio_sql('user_scans_delta', 'user_seeks_delta + user_scans_delta + user_lookups_delta')}
          AS scan_to_seek_ratio_delta
    FROM (SELECT s.*, {', '.join(f'{pos_delta_sql(c)} AS {c}_delta' for c in _IDX_COLS)},
                 {SECS} AS delta_seconds
          {prev_join('ix')}) d""", "fx_sample", "fx_header", extra=[HP, _IDX_CTE]))
def q_index_ratios(spark, sf_dir):
    d = counter_delta(_index_samples(spark, sf_dir), K, T, _IDX_COLS, header=fx.fx_header(spark, sf_dir))
    return index_ratios(d)


# --- M13 memory clerks ---------------------------------------------------------------------------------

_CLERKS_SQL = """SELECT sql_instance, snapshot_time,
       CASE WHEN snapshot_type_id = 1 THEN 'MEMORYCLERK_SQLBUFFERPOOL'
            ELSE concat('MEMORYCLERK_', CAST(snapshot_type_id AS VARCHAR)) END AS type, instance_name AS memory_node_id,
       inc AS single_pages_kb, n * 64 AS multi_pages_kb, inc // 2 AS virtual_memory_committed_kb, n * 8 AS shared_memory_committed_kb
FROM fx_inc"""


@register("memory_clerks", oracle=with_fixtures("""
    SELECT t.sql_instance, t.snapshot_time, md5(concat(t.sql_instance, '/', t.clerk_name)) AS clerk_id, t.clerk_name,
           t.total_kb, t.allocated_kb
    FROM (SELECT sql_instance, snapshot_time, CASE WHEN total / whole > 0.05 THEN type ELSE 'OTHER' END AS clerk_name,
                 CAST(SUM(total) AS BIGINT) AS total_kb, CAST(SUM(pages) AS BIGINT) AS allocated_kb
          FROM (SELECT *, CAST(SUM(total) OVER (PARTITION BY sql_instance, snapshot_time) AS DOUBLE) AS whole
                FROM (SELECT *, single_pages_kb + multi_pages_kb AS pages,
                             single_pages_kb + multi_pages_kb + shared_memory_committed_kb
                             + CASE WHEN type <> 'MEMORYCLERK_SQLBUFFERPOOL' THEN virtual_memory_committed_kb ELSE 0 END AS total
                      FROM clerks) a) b
          GROUP BY 1, 2, 3) t""", "fx_inc", extra=[("clerks", _CLERKS_SQL)]))
def q_memory_clerks(spark, sf_dir):
    """Clerk totals of each snapshot with the id of the clerk dimension."""
    inc = fx.fx_inc(spark, sf_dir)
    kind = F.when(F.col("snapshot_type_id") == 1, F.lit("MEMORYCLERK_SQLBUFFERPOOL")).otherwise(
        F.concat(F.lit("MEMORYCLERK_"), F.col("snapshot_type_id").cast("string")))
    clerks = inc.select("sql_instance", T, kind.alias("type"), F.col("instance_name").alias("memory_node_id"),
                        F.col("inc").alias("single_pages_kb"), (F.col("n") * 64).alias("multi_pages_kb"),
                        F.floor(F.col("inc") / 2).alias("virtual_memory_committed_kb"),
                        (F.col("n") * 8).alias("shared_memory_committed_kb"))
    totals = memory_clerk_totals(clerks, ["sql_instance", T])
    return totals.select("sql_instance", T, F.md5(F.concat("sql_instance", F.lit("/"), "clerk_name")).alias("clerk_id"),
                         "clerk_name", "total_kb", "allocated_kb")


# --- A12 / M13 minor-share bucketing ----------------------------------------------------------------

@register("minor_bucket", oracle=with_fixtures("""
    SELECT sql_instance, snapshot_time, clerk, CAST(SUM(total_kb) AS BIGINT) AS total_kb
    FROM (SELECT sql_instance, snapshot_time,
                 CASE WHEN CAST(total_kb AS DOUBLE) / CAST(NULLIF(SUM(total_kb) OVER (PARTITION BY sql_instance, snapshot_time), 0) AS DOUBLE) > 0.05
                      THEN clerk ELSE 'OTHER' END AS clerk, total_kb
          FROM (SELECT sql_instance, snapshot_time,
                       concat('MEMORYCLERK_', upper(instance_name), '_', CAST(snapshot_type_id AS VARCHAR)) AS clerk,
                       inc AS total_kb FROM fx_inc) c) b
    GROUP BY sql_instance, snapshot_time, clerk""", "fx_inc"))
def q_minor_bucket(spark, sf_dir):
    inc = fx.fx_inc(spark, sf_dir)
    clerks = inc.select("sql_instance", T,
                        F.concat(F.lit("MEMORYCLERK_"), F.upper("instance_name"), F.lit("_"),
                                 F.col("snapshot_type_id").cast("string")).alias("clerk"),
                        F.col("inc").alias("total_kb"))
    return minor_bucket(clerks, ["sql_instance", T], "clerk", "total_kb", share=0.05)


# --- M5 CPU split ---------------------------------------------------------------------------------------

@register("cpu_split", oracle=with_fixtures("""
    SELECT sql_instance, check_id, snapshot_time, counter_name, cntr_value FROM (
      SELECT sql_instance, check_id, snapshot_time, CAST(n % 40 AS BIGINT) AS "Processor Time %",
             CAST(sum100 % 50 AS BIGINT) AS "Idle Time %",
             CAST(100 - sum100 % 50 - n % 40 AS BIGINT) AS "System Time %"
      FROM fx_check) c
    UNPIVOT (cntr_value FOR counter_name IN ("Processor Time %", "Idle Time %", "System Time %"))""",
    "fx_check"))
def q_cpu_split(spark, sf_dir):
    c = fx.fx_check(spark, sf_dir)
    c = c.select("sql_instance", "check_id", T, (F.col("n") % 40).alias("process"), (F.col("sum100") % 50).alias("idle"))
    return cpu_split(c, ["sql_instance", "check_id", T], "process", "idle")


# --- F12 enum decodes ----------------------------------------------------------------------------------

@register("enum_decode", oracle=f"""
    SELECT p_partkey,
           {enums.case_sql('p_size % 6', enums.FILE_TYPE, enums.FILE_TYPE_DEFAULT)} AS file_type_desc,
           {enums.case_sql('p_size % 7', enums.JOB_RUN_STATUS, enums.JOB_RUN_STATUS_DEFAULT)} AS run_status_desc,
           {enums.case_sql('p_size % 5', enums.DATA_COMPRESSION, enums.DATA_COMPRESSION_DEFAULT)} AS data_compression,
           {enums.case_sql('p_size % 3', enums.LOG_TYPE, enums.LOG_TYPE_DEFAULT)} AS log_type
    FROM part""")
def q_enum_decode(spark, sf_dir):
    from ..sources.tables import read_table

    p = read_table(spark, sf_dir, "part", "p_partkey", "p_size")
    return p.select("p_partkey",
                    enums.file_type_desc(F.col("p_size") % 6).alias("file_type_desc"),
                    enums.job_status_desc(F.col("p_size") % 7).alias("run_status_desc"),
                    enums.compression_desc(F.col("p_size") % 5).alias("data_compression"),
                    enums.log_type_desc(F.col("p_size") % 3).alias("log_type"))
