"""Queries: ordered string aggregation, anonymised failure statistics, text
dictionaries, backup age."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregates import failure_stats_anonymised, listagg
from ..operators.events import text_dictionary
from ..sources.tables import read_table
from .registry import register
from .sqlbits import NOW, NOW_PY


@register("listagg_cols", oracle="""
    SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
    FROM customer GROUP BY c_nationkey""")
def q_listagg_cols(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment")
    return listagg(c, ["c_nationkey"], "c_mktsegment", "segments")


@register("error_stats_anon", oracle=f"""
    SELECT md5(concat('srv', CAST(user_id % 4 AS VARCHAR))) AS instance_hash,
           concat('proc_', CAST(user_id % 5 AS VARCHAR)) AS process, COUNT(*) AS failures
    FROM events WHERE event_type = 'error' AND ts > {NOW} - INTERVAL 168 HOUR
    GROUP BY 1, 2""")
def q_error_stats_anon(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "ts", "user_id", "event_type").filter(F.col("event_type") == "error")
    e = e.select("ts", F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string")).alias("sql_instance"),
                 F.concat(F.lit("proc_"), (F.col("user_id") % 5).cast("string")).alias("process"))
    return failure_stats_anonymised(e, "sql_instance", "process", "ts", NOW_PY, hours=168)


_LINE_SQL = "concat('Event ', event_type, ' for user u', CAST(user_id % 20 AS VARCHAR))"


@register("text_dictionary", oracle=f"""
    SELECT {_LINE_SQL} AS text, COUNT(*) AS occurrences, MIN(ts) AS first_occurrence,
           MAX(ts) AS last_occurrence
    FROM events GROUP BY 1""")
def q_text_dictionary(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "ts", "user_id", "event_type")
    lines = e.select("ts", F.concat(F.lit("Event "), "event_type", F.lit(" for user u"),
                                    (F.col("user_id") % 20).cast("string")).alias("text"))
    split = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    earlier = text_dictionary(lines.filter(F.col("ts") < split), "text", "ts")
    return text_dictionary(lines.filter(F.col("ts") >= split), "text", "ts", existing=earlier)


BACKUP_NOW = "2001-08-02 00:00:00"


@register("backup_age", oracle=f"""
    SELECT c.c_custkey AS database_id, b.last_data_backup, b.last_log_backup,
           COALESCE(date_diff('day', b.last_data_backup, TIMESTAMP '{BACKUP_NOW}'), 9999) AS data_backup_age_days,
           COALESCE(date_diff('minute', b.last_log_backup, TIMESTAMP '{BACKUP_NOW}'), 9999) AS log_backup_age_minutes,
           b.last_full_backup IS NULL AS missing_full_backup
    FROM customer c LEFT JOIN (
      SELECT o_custkey,
             MAX(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderdate END) AS last_data_backup,
             MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) AS last_full_backup,
             MAX(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN o_orderdate END) AS last_log_backup
      FROM orders GROUP BY o_custkey) b ON b.o_custkey = c.c_custkey""")
def q_backup_age(spark, sf_dir):
    from ..operators.aggregates import backup_age

    c = read_table(spark, sf_dir, "customer", "c_custkey").withColumnRenamed("c_custkey", "database_id")
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority")
    sets = o.select(F.col("o_custkey").alias("database_id"), F.col("o_orderdate").alias("backup_finish_date"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", "D")
                     .when(F.col("o_orderpriority") == "2-HIGH", "I").otherwise("L").alias("type"))
    return backup_age(c, sets, BACKUP_NOW)
