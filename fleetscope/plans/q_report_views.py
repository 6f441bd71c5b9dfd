"""Queries: report views of disk, memory, job and index facts and dimensions; application log retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import report_time, trunc_ntz
from ..operators import report_views as views
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .fixture_sql import with_fixtures
from .registry import register

LOG_NOW = "2024-01-20 12:00:00"


def _instance(col: str):
    return F.concat(F.lit("srv"), F.expr(f"{col} div 4").cast("string")).alias("sql_instance")


def _header(samples):
    """Every snapshot of the samples, registered."""
    keys = ["sql_instance", "snapshot_type_id", "snapshot_time"]
    return samples.select(*keys).distinct().withColumn("report_time", report_time("snapshot_time"))


_REPORT_TIME = "date_trunc('minute', snapshot_time + INTERVAL 59 SECOND) AS report_time"

_DB_SAMPLES = """SELECT concat('srv', o_custkey // 4) AS sql_instance, o_custkey AS database_id, 2 AS snapshot_type_id,
    date_trunc('day', o_orderdate) AS snapshot_time, CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS data_bytes,
    COUNT(*) AS log_size_used_bytes FROM orders GROUP BY ALL"""


@register("fact_disk_database", oracle=f"""
    SELECT s.*, c_name AS database_name, {_REPORT_TIME}
    FROM ({_DB_SAMPLES}) s JOIN customer ON c_custkey = database_id""")
def q_fact_disk_database(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    samples = o.groupBy(_instance("o_custkey"), F.col("o_custkey").alias("database_id"), F.lit(2).alias("snapshot_type_id"),
                        trunc_ntz("day", "o_orderdate").alias("snapshot_time")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("data_bytes"), F.count(F.lit(1)).alias("log_size_used_bytes"))
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    members = c.select(_instance("c_custkey"), F.col("c_custkey").alias("database_id"), F.col("c_name").alias("database_name"))
    return views.disk_database_facts(samples, _header(samples), members)


@register("fact_disk_volume", oracle=with_fixtures(f"""
    SELECT concat('srv', volume_id // 4) AS sql_instance, volume_id, 17 AS snapshot_type_id, snapshot_time, free_bytes, total_bytes,
           s_name AS volume_name, {_REPORT_TIME}
    FROM fx_volume JOIN supplier ON s_suppkey = volume_id""", "fx_volume"))
def q_fact_disk_volume(spark, sf_dir):
    samples = fx.fx_volume(spark, sf_dir).select(_instance("volume_id"), "volume_id", F.lit(17).alias("snapshot_type_id"),
                                                 "snapshot_time", "free_bytes", "total_bytes")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    members = s.select(_instance("s_suppkey"), F.col("s_suppkey").alias("volume_id"), F.col("s_name").alias("volume_name"))
    return views.disk_volume_facts(samples, _header(samples), members)


_TABLE_SAMPLES = """SELECT concat('srv', l_suppkey // 4) AS sql_instance, l_suppkey AS database_id, l_partkey AS table_id,
    22 AS snapshot_type_id, date_trunc('month', l_shipdate) AS snapshot_time, COUNT(*) AS row_count,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_pages, CAST(MAX(CAST(l_quantity AS BIGINT)) AS BIGINT) AS used_pages
    FROM lineitem GROUP BY ALL"""


@register("fact_disk_table", oracle=f"""
    SELECT s.*, p_name AS table_name, s_name AS database_name, TIMESTAMP '2000-01-01 00:00:00' AS database_create_date, {_REPORT_TIME}
    FROM (SELECT *, row_count - LAG(row_count) OVER w AS row_count_delta, total_pages - LAG(total_pages) OVER w AS total_pages_delta,
                 used_pages - LAG(used_pages) OVER w AS used_pages_delta FROM ({_TABLE_SAMPLES}) t
          WINDOW w AS (PARTITION BY sql_instance, database_id, table_id ORDER BY snapshot_time)) s
    JOIN part ON p_partkey = table_id JOIN supplier ON s_suppkey = database_id""")
def q_fact_disk_table(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
    n = F.col("l_quantity").cast("bigint")
    samples = li.groupBy(_instance("l_suppkey"), F.col("l_suppkey").alias("database_id"), F.col("l_partkey").alias("table_id"),
                         F.lit(22).alias("snapshot_type_id"), trunc_ntz("month", "l_shipdate").alias("snapshot_time")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(n).alias("total_pages"), F.max(n).alias("used_pages"))
    keys = ["sql_instance", "database_id", "table_id"]
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("table_id"), F.col("p_name").alias("table_name"))
    tables = samples.select(*keys).distinct().join(p, "table_id")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    databases = s.select(_instance("s_suppkey"), F.col("s_suppkey").alias("database_id"), F.col("s_name").alias("database_name"),
                         F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("database_create_date"))
    return views.disk_table_facts(samples, _header(samples), tables, databases)


@register("fact_process_memory", oracle=with_fixtures(f"""
    SELECT sql_instance, snapshot_type_id, snapshot_time, {_REPORT_TIME}, CAST(SUM(inc) AS BIGINT) AS physical_memory_in_use_kb,
           CAST(SUM(n) AS BIGINT) AS page_fault_count
    FROM fx_inc GROUP BY sql_instance, snapshot_type_id, snapshot_time""", "fx_inc"))
def q_fact_process_memory(spark, sf_dir):
    samples = fx.fx_inc(spark, sf_dir).groupBy("sql_instance", "snapshot_type_id", "snapshot_time").agg(
        F.sum("inc").alias("physical_memory_in_use_kb"), F.sum("n").alias("page_fault_count"))
    header = fx.fx_header(spark, sf_dir).withColumn("report_time", report_time("snapshot_time"))
    return views.process_memory_facts(samples, header)


@register("dim_agent_job", oracle="""
    SELECT concat('srv', p_partkey // 4) AS sql_instance, p_name AS job_name, p_partkey AS job_id,
           CASE p_size % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS is_record_deleted
    FROM part WHERE p_size % 3 <> 1""")
def q_dim_agent_job(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    mark = F.when(F.col("p_size") % 3 == 0, False).when(F.col("p_size") % 3 == 1, True)
    return views.dim_agent_job(p.select(_instance("p_partkey"), F.col("p_name").alias("job_name"), F.col("p_partkey").alias("job_id"),
                                        mark.alias("is_record_deleted")))


@register("app_log_retention", oracle=f"""
    SELECT event_id, ts AS event_time, event_type FROM events
    WHERE ts IS NULL OR ts >= TIMESTAMP '{LOG_NOW}' - INTERVAL 7 DAY""")
def q_app_log_retention(spark, sf_dir):
    log = read_table(spark, sf_dir, "events", "event_id", "ts", "event_type")
    return views.app_log_retention(log.withColumnRenamed("ts", "event_time"), LOG_NOW)
