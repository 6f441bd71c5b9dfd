"""Queries: report-star views and remaining inventory items (F14, M18, M19, A17,
A19, A21, U12, S6, S12, app version, server dimension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums
from ..operators import dims
from ..operators import report as rp
from ..operators.alerts import expand_checks
from ..operators.joins import broadcast_if_small
from ..sources import fixtures as fx
from ..sources.ingest import failed_checks_since
from ..sources.tables import read_table
from .config import Relation
from .fixture_sql import with_fixtures
from .registry import register

LOCAL = "srv0"
INSTANCES = Relation(
    "sql_instance string, environment string, sql_instance_user_alias string, repo_collector_is_active boolean",
    [("srv0", "PROD", "primary", False), ("srv1", "PROD", "replica", True), ("srv2", "TEST", None, False),
     ("srv3", "DEV", "sandbox", True)],
)


@register("active_instance_filter", oracle=with_fixtures(f"""
    SELECT s.* FROM fx_sample s JOIN ({INSTANCES.sql()}) c USING (sql_instance)
    WHERE s.sql_instance = '{LOCAL}' OR c.repo_collector_is_active""", "fx_sample"))
def q_active_instance_filter(spark, sf_dir):
    return rp.active_instances(fx.fx_sample(spark, sf_dir), INSTANCES.df(spark), LOCAL)


_SERVERS_SQL = """SELECT concat('srv', CAST(n_nationkey AS VARCHAR)) AS sql_instance, n_name AS physical_name,
                         'MSSQLSERVER' AS service_name, CAST(n_regionkey * 60 AS INTEGER) AS utc_offset_minutes
                  FROM nation"""


@register("dim_server", oracle=f"""
    SELECT s.*, c.environment, c.sql_instance_user_alias FROM ({_SERVERS_SQL}) s JOIN ({INSTANCES.sql()}) c
      USING (sql_instance)
    WHERE (CASE WHEN s.sql_instance <> '{LOCAL}' THEN TRUE ELSE FALSE END) = c.repo_collector_is_active""")
def q_dim_server(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    servers = n.select(F.concat(F.lit("srv"), F.col("n_nationkey").cast("string")).alias("sql_instance"),
                       F.col("n_name").alias("physical_name"), F.lit("MSSQLSERVER").alias("service_name"),
                       (F.col("n_regionkey") * 60).cast("int").alias("utc_offset_minutes"))
    return rp.dim_server(servers, INSTANCES.df(spark), LOCAL)


@register("app_version", oracle="""
    SELECT install_sequence, install_date, version,
           CASE WHEN len(string_split(version, '.')) <= 4 THEN list_extract(string_split(version, '.'), -4) END AS major,
           CASE WHEN len(string_split(version, '.')) <= 4 THEN list_extract(string_split(version, '.'), -3) END AS minor,
           CASE WHEN len(string_split(version, '.')) <= 4 THEN list_extract(string_split(version, '.'), -2) END AS patch,
           CASE WHEN len(string_split(version, '.')) <= 4 THEN list_extract(string_split(version, '.'), -1) END AS build
    FROM (SELECT o_orderkey AS install_sequence, o_orderdate AS install_date,
                 CAST(year(o_orderdate) - 1990 AS VARCHAR) || '.' || CAST(month(o_orderdate) AS VARCHAR) || '.'
                 || CAST(day(o_orderdate) AS VARCHAR) || '.' || CAST(o_custkey AS VARCHAR) AS version FROM orders) v
    WHERE install_sequence = (SELECT MAX(o_orderkey) FROM orders)""")
def q_app_version(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_custkey")
    v = o.select(F.col("o_orderkey").alias("install_sequence"), F.col("o_orderdate").alias("install_date"),
                 F.concat_ws(".", (F.year("o_orderdate") - 1990).cast("string"), F.month("o_orderdate").cast("string"),
                             F.dayofmonth("o_orderdate").cast("string"), F.col("o_custkey").cast("string"))
                 .alias("version"))
    return rp.app_version(v)


_REPLICA_SQL = """SELECT o_orderkey AS sample_id, 'ag' || CAST(o_custkey % 5 AS VARCHAR) AS hadr_group_name,
                         'db' || CAST(o_custkey % 3 AS VARCHAR) AS database_name,
                         CAST(o_orderkey % 5 AS INTEGER) AS availability_mode, CAST(o_custkey % 3 AS INTEGER) AS failover_mode,
                         CAST(o_orderkey % 6 AS INTEGER) AS synchronization_state,
                         CAST(o_custkey % 4 AS INTEGER) AS synchronization_health,
                         CAST(o_orderkey % 8 AS INTEGER) AS database_state, CAST(o_custkey % 10 AS INTEGER) AS suspend_reason
                  FROM orders"""


@register("replica_states", oracle=f"""
    SELECT r.*, {enums.case_or_code_sql('availability_mode', enums.AVAILABILITY_MODE)} AS availability_mode_desc,
           {enums.case_or_code_sql('failover_mode', enums.FAILOVER_MODE)} AS failover_mode_desc,
           {enums.case_or_code_sql('synchronization_state', enums.SYNC_STATE)} AS synchronization_state_desc,
           {enums.case_or_code_sql('synchronization_health', enums.SYNC_HEALTH)} AS synchronization_health_desc,
           {enums.case_or_code_sql('database_state', enums.DATABASE_STATE)} AS database_state_desc,
           {enums.case_or_code_sql('suspend_reason', enums.SUSPEND_REASON)} AS suspend_reason_desc,
           n.n_name AS replica_server_name
    FROM ({_REPLICA_SQL}) r JOIN nation n ON 'db' || CAST(n.n_nationkey AS VARCHAR) = r.database_name""")
def q_replica_states(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    s = o.select(F.col("o_orderkey").alias("sample_id"),
                 F.concat(F.lit("ag"), (F.col("o_custkey") % 5).cast("string")).alias("hadr_group_name"),
                 F.concat(F.lit("db"), (F.col("o_custkey") % 3).cast("string")).alias("database_name"),
                 (F.col("o_orderkey") % 5).cast("int").alias("availability_mode"),
                 (F.col("o_custkey") % 3).cast("int").alias("failover_mode"),
                 (F.col("o_orderkey") % 6).cast("int").alias("synchronization_state"),
                 (F.col("o_custkey") % 4).cast("int").alias("synchronization_health"),
                 (F.col("o_orderkey") % 8).cast("int").alias("database_state"),
                 (F.col("o_custkey") % 10).cast("int").alias("suspend_reason"))
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(
        F.concat(F.lit("db"), F.col("n_nationkey").cast("string")).alias("database_name"),
        F.col("n_name").alias("replica_server_name"))
    return rp.replica_states(s).join(broadcast_if_small(n), "database_name")


_MI_SQL = """SELECT l_partkey, COUNT(*) AS user_seeks, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS user_scans,
                    '[db' || CAST(l_partkey % 3 AS VARCHAR) || '].[dbo].[' || replace(p_name, ' ', '_') || ']' AS statement
             FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, p_name"""


@register("missing_index", oracle=f"""
    SELECT m.l_partkey, m.user_seeks, m.user_scans, m.statement, 'db' || CAST(m.l_partkey % 3 AS VARCHAR) AS database_name,
           'dbo.' || replace(p.p_name, ' ', '_') AS table_name, d.database_id, t.table_id
    FROM ({_MI_SQL}) m JOIN part p ON p.p_partkey = m.l_partkey
    JOIN (SELECT 'db' || CAST(n_nationkey AS VARCHAR) AS database_name, n_nationkey AS database_id FROM nation) d
      ON d.database_name = 'db' || CAST(m.l_partkey % 3 AS VARCHAR)
    JOIN (SELECT DISTINCT 'db' || CAST(p_partkey % 3 AS VARCHAR) AS database_name,
                 'dbo.' || replace(p_name, ' ', '_') AS table_name,
                 MIN(p_partkey) OVER (PARTITION BY p_partkey % 3, p_name) AS table_id FROM part) t
      ON t.database_name = d.database_name AND t.table_name = 'dbo.' || replace(p.p_name, ' ', '_')""")
def q_missing_index(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    # aggregate the fact per part first (map-side partial aggregation), then join the 1-row-per-part result
    per_part = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("user_seeks"),
                                           F.sum(F.col("l_quantity").cast("bigint")).alias("user_scans"))
    s = per_part.join(p, per_part.l_partkey == p.p_partkey)
    s = s.select("l_partkey", "user_seeks", "user_scans",
                 F.concat(F.lit("[db"), (F.col("l_partkey") % 3).cast("string"), F.lit("].[dbo].["),
                          F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("]")).alias("statement"))
    dbs = read_table(spark, sf_dir, "nation", "n_nationkey").select(
        F.concat(F.lit("db"), F.col("n_nationkey").cast("string")).alias("database_name"),
        F.col("n_nationkey").alias("database_id"))
    tables = (p.select(F.concat(F.lit("db"), (F.col("p_partkey") % 3).cast("string")).alias("database_name"),
                       F.concat(F.lit("dbo."), F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("table_name"),
                       "p_partkey")
              .groupBy("database_name", "table_name").agg(F.min("p_partkey").alias("table_id")))
    return rp.missing_index_facts(s, dbs, tables)


@register("queue_status_counts", oracle="""
    SELECT concat('srv', CAST(o_custkey % 4 AS VARCHAR)) AS sql_instance,
           CASE WHEN o_orderstatus = 'F' THEN 'OK' WHEN o_orderstatus = 'P' THEN 'RETRYING'
                WHEN o_orderpriority = '1-URGENT' THEN 'FAILED' END AS exec_status, COUNT(*) AS items
    FROM orders GROUP BY 1, 2""")
def q_queue_status_counts(spark, sf_dir):
    from .q_dims import _queue

    return rp.status_count(_queue(spark, sf_dir), ["sql_instance"])


@register("errorlog_counts", oracle="""
    SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) AS log_date, role AS attribute_value,
           'turn of ' || role AS text, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS keyword_id,
           COUNT(*) AS record_count
    FROM conversations GROUP BY 1, 2, 3, 4""")
def q_errorlog_counts(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "role")
    lines = c.select(F.timestamp_add("HOUR", F.col("conv_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
                     .alias("log_date"), F.col("role").alias("attribute_value"),
                     F.concat(F.lit("turn of "), "role").alias("text"),
                     F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
                     .alias("keyword_id"))
    return rp.errorlog_counts(lines)


@register("failed_jobs", oracle="""
    SELECT o_custkey % 20 AS job_id, c_name AS job_name, COUNT(*) AS failures, MAX(o_orderdate) AS last_failure,
           string_agg(DISTINCT CAST(o_orderkey % 3 AS VARCHAR), ',' ORDER BY CAST(o_orderkey % 3 AS VARCHAR))
               AS failed_steps
    FROM orders JOIN customer ON c_custkey = o_custkey % 20
    WHERE o_orderkey % 6 = 0 AND o_orderdate > TIMESTAMP '2000-01-01 00:00:00'
    GROUP BY 1, 2""")
def q_failed_jobs(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name")
    h = o.select((F.col("o_custkey") % 20).alias("job_id"), (F.col("o_orderkey") % 3).cast("int").alias("step_id"),
                 (F.col("o_orderkey") % 6).cast("int").alias("run_status"), F.col("o_orderdate").alias("run_start_utc"))
    h = h.join(broadcast_if_small(c.select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"))),
               "job_id")
    return rp.failed_jobs(h, "2000-01-01 00:00:00")


_TEMPL = Relation("template_id int, object_kind string, check_name string, check_threshold_warning string, "
                  "check_threshold_critical string",
                  [(3, "Database", "Log backup age of {OBJECT}", ">60", ">1440")])
MIRROR_NOW = "2001-08-02 00:00:00"


def _db_objects(o):
    return o.select(F.concat(F.lit("srv"), (F.col("o_custkey") % 4).cast("string")).alias("sql_instance"),
                    F.lit("Database").alias("object_kind"), F.col("o_custkey").alias("object_id"),
                    F.concat(F.lit("db"), F.col("o_custkey").cast("string")).alias("object_name")).distinct()


@register("config_mirror", oracle=f"""
    SELECT n.check_id, n.check_name, n.check_threshold_warning, n.check_threshold_critical,
           CASE WHEN o.check_id IS NULL THEN TIMESTAMP '{MIRROR_NOW}' ELSE TIMESTAMP '1999-01-01 00:00:00' END
               AS date_updated
    FROM (SELECT DISTINCT 3000000 + o_custkey AS check_id, 'Log backup age of db' || CAST(o_custkey AS VARCHAR) AS check_name,
                 '>60' AS check_threshold_warning, '>1440' AS check_threshold_critical
          FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00') n
    LEFT JOIN (SELECT DISTINCT 3000000 + o_custkey AS check_id FROM orders
               WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00') o USING (check_id)""")
def q_config_mirror(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    cols = ["check_name", "check_threshold_warning", "check_threshold_critical"]
    old = expand_checks(_TEMPL.df(spark), _db_objects(o.filter(F.col("o_orderdate") < F.lit("1996-01-01 00:00:00")
                                                             .cast("timestamp_ntz"))))
    old = old.select("check_id", *cols, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("date_updated"))
    new = expand_checks(_TEMPL.df(spark), _db_objects(o.filter(F.col("o_orderdate") >= F.lit("1996-01-01 00:00:00")
                                                             .cast("timestamp_ntz")))).select("check_id", *cols)
    merged = dims.upsert(old, new, ["check_id"], cols, MIRROR_NOW)
    return dims.delete_unmatched(merged, new, ["check_id"])


@register("volume_samples", oracle=with_fixtures("""
    SELECT v.*, s.s_name AS volume_name FROM fx_volume v JOIN supplier s ON s.s_suppkey = v.volume_id""", "fx_volume"))
def q_volume_samples(spark, sf_dir):
    dim = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    dim = dim.select(F.col("s_suppkey").alias("volume_id"), F.col("s_name").alias("volume_name"))
    # the sink keeps only samples of known volumes (inner join to the dimension), then appends
    return fx.fx_volume(spark, sf_dir).join(dim, "volume_id")


@register("external_check_failures", oracle="""
    SELECT COUNT(*) AS failed_count FROM orders
    WHERE o_orderdate > TIMESTAMP '2001-01-01 00:00:00' AND o_orderstatus = 'F'""")
def q_external_check_failures(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_orderstatus")
    res = o.select(F.col("o_orderdate").alias("check_time"),
                   F.when(F.col("o_orderstatus") == "F", "Failed").otherwise("Passed").alias("result"))
    return failed_checks_since(res, "2001-01-01 00:00:00")


_DBS_SQL = """SELECT o_orderkey AS database_id, 'db' || CAST(o_orderkey AS VARCHAR) AS name,
                     CASE WHEN o_orderstatus IN ('F', 'O') THEN 'ONLINE' ELSE 'RESTORING' END AS state_desc,
                     CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey + 1 END AS source_database_id,
                     CASE WHEN o_custkey % 30 < 25 THEN CAST(o_custkey % 30 AS INTEGER) END AS replica_id
              FROM orders"""
_REPL_SQL = """SELECT n_nationkey AS replica_id,
                      CASE n_regionkey WHEN 0 THEN 'PRIMARY' WHEN 1 THEN 'RESOLVING' ELSE 'SECONDARY' END AS role_desc,
                      CASE n_nationkey % 3 WHEN 0 THEN 'READ_ONLY' WHEN 1 THEN 'NO' ELSE 'ALL' END
                          AS secondary_role_allow_connections_desc
               FROM nation"""


@register("sys_databases", oracle=f"""
    SELECT d.* FROM ({_DBS_SQL}) d LEFT JOIN ({_REPL_SQL}) r USING (replica_id)
    WHERE d.state_desc = 'ONLINE' AND d.source_database_id IS NULL
      AND (r.role_desc IS NULL OR r.role_desc = 'PRIMARY'
           OR (r.role_desc = 'SECONDARY' AND r.secondary_role_allow_connections_desc IN ('READ_ONLY', 'ALL')))""")
def q_sys_databases(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    dbs = o.select(F.col("o_orderkey").alias("database_id"),
                   F.concat(F.lit("db"), F.col("o_orderkey").cast("string")).alias("name"),
                   F.when(F.col("o_orderstatus").isin("F", "O"), "ONLINE").otherwise("RESTORING").alias("state_desc"),
                   F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") + 1).alias("source_database_id"),
                   F.when(F.col("o_custkey") % 30 < 25, (F.col("o_custkey") % 30).cast("int")).alias("replica_id"))
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    repl = n.select(F.col("n_nationkey").alias("replica_id"),
                    F.when(F.col("n_regionkey") == 0, "PRIMARY").when(F.col("n_regionkey") == 1, "RESOLVING")
                    .otherwise("SECONDARY").alias("role_desc"),
                    F.when(F.col("n_nationkey") % 3 == 0, "READ_ONLY").when(F.col("n_nationkey") % 3 == 1, "NO")
                    .otherwise("ALL").alias("secondary_role_allow_connections_desc"))
    return rp.sys_databases(dbs, repl)


@register("help_queue_failures", oracle="""
    SELECT * FROM (SELECT o_orderkey AS queue_item_id, concat('srv', CAST(o_custkey % 4 AS VARCHAR)) AS sql_instance,
                          o_orderdate AS time_queued,
                          CASE WHEN o_orderstatus = 'F' THEN 'OK' WHEN o_orderstatus = 'P' THEN 'RETRYING'
                               WHEN o_orderpriority = '1-URGENT' THEN 'FAILED' END AS exec_status,
                          o_orderdate + to_minutes(o_orderkey % 600) AS exec_time_end,
                          CAST(o_orderkey % 6 AS INTEGER) AS retry_count FROM orders) q
    WHERE exec_status <> 'OK'""")
def q_help_queue_failures(spark, sf_dir):
    """Queue items that did not complete (a NULL status is not a failure yet)."""
    from .q_dims import _queue

    return _queue(spark, sf_dir).filter(F.col("exec_status") != "OK")


@register("help_log_failures", oracle="""
    SELECT event_id AS event_sequence, concat('srv', CAST(user_id % 4 AS VARCHAR)) AS sql_instance, ts AS event_time,
           'collector_' || CAST(user_id % 5 AS VARCHAR) AS process_name, event_type AS process_message
    FROM events WHERE event_type = 'error'""")
def q_help_log_failures(spark, sf_dir):
    """Application-log entries of type ERROR."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    log = e.select(F.col("event_id").alias("event_sequence"),
                   F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string")).alias("sql_instance"),
                   F.col("ts").alias("event_time"),
                   F.concat(F.lit("collector_"), (F.col("user_id") % 5).cast("string")).alias("process_name"),
                   F.col("event_type").alias("process_message"),
                   F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("process_message_type"))
    return log.filter(F.col("process_message_type") == "ERROR").drop("process_message_type")


@register("scheduler_totals", oracle=with_fixtures("""
    SELECT i.sql_instance, i.snapshot_type_id, i.snapshot_time, h.report_time, CAST(SUM(i.n) AS BIGINT) AS runnable_tasks,
           CAST(SUM(i.inc) AS BIGINT) AS work_queue, COUNT(*) AS schedulers
    FROM fx_inc i JOIN hdr h USING (sql_instance, snapshot_type_id, snapshot_time)
    GROUP BY i.sql_instance, i.snapshot_type_id, i.snapshot_time, h.report_time""", "fx_inc", "fx_header", extra=[
    ("hdr", """SELECT sql_instance, snapshot_type_id, snapshot_time,
                      snapshot_time + to_minutes(CAST(CAST(right(sql_instance, 1) AS INTEGER) * 60 AS BIGINT))
                          AS report_time FROM fx_header""")]))
def q_scheduler_totals(spark, sf_dir):
    """Sum over the schedulers of a snapshot (each counter instance stands for a scheduler),
    stamped with the header's report time (A3, J1)."""
    from ..operators.joins import with_header
    from .q_joins import header_with_report_time

    inc = fx.fx_inc(spark, sf_dir)
    h = header_with_report_time(spark, sf_dir).select(*fx.HEADER_KEYS, "report_time")
    return (with_header(inc, h).groupBy("sql_instance", "snapshot_type_id", "snapshot_time", "report_time")
            .agg(F.sum("n").alias("runnable_tasks"), F.sum("inc").alias("work_queue"),
                 F.count(F.lit(1)).alias("schedulers")))
