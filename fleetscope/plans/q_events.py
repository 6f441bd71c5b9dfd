"""Queries: event XML shredding, long queries, enrichment, de-duplication,
plan dictionary, wait events, health events, session activity, job history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.timeops import trunc_ntz

from ..functions import enums
from ..functions.scalars import parse_wait_info, grouped_number
from ..operators import events as ev
from ..operators.joins import broadcast_if_small
from ..sources.ingest import job_history_ingest
from ..sources.tables import read_table
from .config import WAIT_VOCABULARY
from .q_joins import EXCLUSION_RULES
from .registry import register


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _data(name: str, v) -> Column:
    return F.concat(F.lit(f'<data name="{name}"><value>'), _s(v), F.lit("</value></data>"))


def _action(name: str, v) -> Column:
    return F.concat(F.lit(f'<action name="{name}"><value>'), _s(v), F.lit("</value></action>"))


def _ts_attr(ts) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def event_xml(spark, sf_dir):
    """Extended-event XML for every event row (the capture format the shredder reads)."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    xml = F.concat(
        F.lit('<event name="'), F.when(F.col("event_id") % 2 == 0, "rpc_completed").otherwise("sql_batch_completed"),
        F.lit('" timestamp="'), _ts_attr(F.col("ts")), F.lit('">'),
        _data("duration", F.round(F.col("value") * 1000000).cast("bigint")),
        _data("cpu_time", F.col("user_id") * 1000), _data("physical_reads", F.col("event_id") % 7),
        _data("logical_reads", F.col("event_id") % 100), _data("writes", F.col("event_id") % 3),
        _data("row_count", F.col("user_id")), _data("line_number", F.col("event_id") % 50),
        _data("offset", (F.col("event_id") % 10) * 2),
        _data("offset_end", F.when(F.col("event_id") % 4 == 0, F.lit(-1)).otherwise((F.col("event_id") % 10) * 2 + 40)),
        _action("sql_text", F.concat(F.lit("SELECT \t *   FROM t_"), F.col("event_type"))),
        _action("client_app_name", F.concat(F.lit("app_"), F.col("event_type"))),
        _action("client_hostname", F.concat(F.lit("srv"), _s(F.col("user_id") % 4))),
        _action("database_name", F.concat(F.lit("db"), _s(F.col("user_id") % 3))),
        _action("plan_handle", F.upper(F.md5(F.col("event_type")))),
        _action("session_id", F.col("user_id") + 50),
        _action("username", F.concat(F.lit("user"), _s(F.col("user_id") % 7))),
        F.lit("</event>"))
    return e.select("event_id", F.concat(F.lit("srv"), _s(F.col("user_id") % 4)).alias("sql_instance"),
                    xml.alias("event_data"))


_SHRED_SQL = """SELECT event_id, concat('srv', CAST(user_id % 4 AS VARCHAR)) AS sql_instance,
       CASE WHEN event_id % 2 = 0 THEN 'rpc_completed' ELSE 'sql_batch_completed' END AS event_name,
       date_trunc('second', ts) AS event_time,
       CAST(round(value * 1000000) AS BIGINT) AS duration, user_id * 1000 AS cpu_time,
       event_id % 7 AS physical_reads, event_id % 100 AS logical_reads, event_id % 3 AS writes,
       user_id AS row_count, CAST(NULL AS BIGINT) AS last_row_count,
       CAST(event_id % 50 AS INTEGER) AS line_number, CAST((event_id % 10) * 2 AS INTEGER) AS "offset",
       CAST(CASE WHEN event_id % 4 = 0 THEN -1 ELSE (event_id % 10) * 2 + 40 END AS INTEGER) AS offset_end,
       'SELECT * FROM t_' || event_type AS sql_text, 'app_' || event_type AS client_app_name,
       'srv' || CAST(user_id % 4 AS VARCHAR) AS client_hostname, 'db' || CAST(user_id % 3 AS VARCHAR) AS database_name,
       upper(md5(event_type)) AS plan_handle, CAST(user_id + 50 AS INTEGER) AS session_id,
       'user' || CAST(user_id % 7 AS VARCHAR) AS username
FROM events"""


def _shredded(spark, sf_dir):
    return ev.shred_event(event_xml(spark, sf_dir), "event_data", keep=["event_id", "sql_instance"])


@register("shred_event", headline=True, oracle=_SHRED_SQL)
def q_shred_event(spark, sf_dir):
    return _shredded(spark, sf_dir)


SEEN_BEFORE = "2024-01-10 00:00:00"


@register("long_queries", oracle=f"""
    SELECT q.* FROM ({_SHRED_SQL}) q
    WHERE NOT EXISTS (
      SELECT 1 FROM ({EXCLUSION_RULES.sql()}) r
      WHERE NOT (r.sql_text IS NULL AND r.client_app_name IS NULL AND r.client_hostname IS NULL AND r.username IS NULL)
        AND (r.sql_text IS NULL OR q.sql_text LIKE r.sql_text)
        AND (r.client_app_name IS NULL OR q.client_app_name LIKE r.client_app_name)
        AND (r.client_hostname IS NULL OR q.client_hostname LIKE r.client_hostname)
        AND (r.username IS NULL OR q.username LIKE r.username))
    AND NOT EXISTS (SELECT 1 FROM ({_SHRED_SQL}) s WHERE s.event_time < TIMESTAMP '{SEEN_BEFORE}'
                    AND s.event_time = q.event_time AND s.session_id = q.session_id
                    AND s.sql_instance = q.sql_instance)""")
def q_long_queries(spark, sf_dir):
    s = _shredded(spark, sf_dir)
    # rows stored by earlier runs (the long-query table): events before the cut-off
    raw = read_table(spark, sf_dir, "events", "ts", "user_id")
    seen = raw.select(trunc_ntz("second", "ts").alias("event_time"), (F.col("user_id") + 50).cast("int")
                      .alias("session_id"), F.concat(F.lit("srv"), _s(F.col("user_id") % 4)).alias("sql_instance")) \
              .filter(F.col("event_time") < F.lit(SEEN_BEFORE).cast("timestamp_ntz"))
    return ev.long_queries(s, EXCLUSION_RULES.df(spark), seen)


_PLANS_SQL = """SELECT DISTINCT upper(md5(event_type)) AS plan_handle,
                       substr(md5('plan' || event_type), 1, 16) AS query_plan_hash,
                       CASE WHEN event_type IN ('purchase', 'signup') THEN 'usp_' || event_type END AS procedure_name
                FROM events"""
_DBS_SQL = """SELECT 'db' || CAST(n_nationkey AS VARCHAR) AS database_name, n_nationkey + 5 AS database_id,
                     TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(n_regionkey AS BIGINT)) AS database_create_date
              FROM nation"""


@register("event_enrich", oracle=f"""
    SELECT q.*, p.query_plan_hash, d.database_id, d.database_create_date,
           COALESCE(p.procedure_name, 'Ad-Hoc Query') AS procedure_name
    FROM ({_SHRED_SQL}) q LEFT JOIN ({_PLANS_SQL}) p USING (plan_handle) LEFT JOIN ({_DBS_SQL}) d USING (database_name)""")
def q_event_enrich(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_type")
    plans = e.select(F.upper(F.md5("event_type")).alias("plan_handle"),
                     F.substring(F.md5(F.concat(F.lit("plan"), "event_type")), 1, 16).alias("query_plan_hash"),
                     F.when(F.col("event_type").isin("purchase", "signup"), F.concat(F.lit("usp_"), "event_type"))
                      .alias("procedure_name")).distinct()
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    dbs = n.select(F.concat(F.lit("db"), _s("n_nationkey")).alias("database_name"),
                   (F.col("n_nationkey") + 5).alias("database_id"),
                   F.timestamp_add("DAY", F.col("n_regionkey"), F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
                   .alias("database_create_date"))
    return ev.event_enrich(_shredded(spark, sf_dir), plans, dbs)


@register("event_dedupe", oracle=f"""
    SELECT md5(q.client_app_name || '|' || q.username) AS event_hash,
           arg_min(q.event_id, (q.event_time, q.event_id)) AS event_id,
           arg_min(q.sql_instance, (q.event_time, q.event_id)) AS sql_instance,
           arg_min(q.session_id, (q.event_time, q.event_id)) AS session_id,
           arg_min(q.duration, (q.event_time, q.event_id)) AS duration,
           MIN(q.event_time) AS first_event_time, MAX(q.event_time) AS last_event_time, COUNT(*) AS occurrence
    FROM ({_SHRED_SQL}) q GROUP BY 1""")
def q_event_dedupe(spark, sf_dir):
    s = _shredded(spark, sf_dir).withColumn("event_hash", F.md5(F.concat_ws("|", "client_app_name", "username")))
    s = s.withColumn("_order", F.struct("event_time", "event_id"))
    g = s.groupBy("event_hash").agg(
        F.min_by(F.struct("event_id", "sql_instance", "session_id", "duration"), F.col("_order")).alias("_f"),
        F.min("event_time").alias("first_event_time"), F.max("event_time").alias("last_event_time"),
        F.count(F.lit(1)).alias("occurrence"))
    return g.select("event_hash", "_f.*", "first_event_time", "last_event_time", "occurrence")


@register("plan_dedupe", oracle=f"""
    SELECT substr(md5('plan' || q.client_app_name), 1, 16) AS query_plan_hash,
           arg_min(q.plan_handle, (q.event_time, q.plan_handle, q.event_id)) AS plan_handle,
           arg_min(q.sql_text, (q.event_time, q.plan_handle, q.event_id)) AS sql_text,
           arg_min(q."offset", (q.event_time, q.plan_handle, q.event_id)) AS statement_start_offset,
           arg_min(q.offset_end, (q.event_time, q.plan_handle, q.event_id)) AS statement_end_offset,
           arg_min(q.event_id, (q.event_time, q.plan_handle, q.event_id)) AS event_id,
           MIN(q.event_time) AS first_seen, MAX(q.event_time) AS last_seen
    FROM ({_SHRED_SQL}) q GROUP BY 1""")
def q_plan_dedupe(spark, sf_dir):
    s = _shredded(spark, sf_dir)
    p = s.select(F.substring(F.md5(F.concat(F.lit("plan"), "client_app_name")), 1, 16).alias("query_plan_hash"),
                 "plan_handle", "sql_text", F.col("offset").alias("statement_start_offset"),
                 F.col("offset_end").alias("statement_end_offset"), "event_id", "event_time")
    return ev.plan_dictionary(p, order=("event_time", "plan_handle", "event_id"))


# --- E5 wait events ----------------------------------------------------------------------------------------

EXCLUDED_WAITS = ["SLEEP_TASK", "WAITFOR", "BROKER_RECEIVE_WAITFOR", "ONDEMAND_TASK_QUEUE"]


def _wait_xml(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    vocab = F.array(*[F.lit(w) for w in WAIT_VOCABULARY])
    wt = F.element_at(vocab, (F.col("event_id") % len(WAIT_VOCABULARY) + 1).cast("int"))
    nframes = (F.col("event_id") % 3 + 1).cast("int")
    frames = F.array_join(F.transform(F.sequence(F.lit(1), nframes), lambda i: F.concat(
        F.lit('<frame level="'), _s(i), F.lit('" handle="0x'), F.upper(F.md5(F.concat(_s(F.col("event_id")), _s(i)))),
        F.lit('" offsetStart="'), _s(i * 10), F.lit('" offsetEnd="'), _s(i * 10 + 8), F.lit('"/>'))), "")
    xml = F.concat(F.lit('<event name="wait_info" timestamp="'), _ts_attr(F.col("ts")), F.lit('">'),
                   F.lit('<data name="wait_type"><text>'), wt, F.lit("</text></data>"),
                   _data("duration", F.round(F.col("value") * 10).cast("bigint")),
                   _data("signal_duration", F.col("event_id") % 13),
                   _action("session_id", F.col("user_id") + 50),
                   F.lit('<action name="tsql_stack"><value>'), frames, F.lit("</value></action></event>"))
    return e.select("event_id", xml.alias("event_data"))


@register("wait_events", oracle=f"""
    SELECT event_id, event_time, wait_type, duration, signal_duration, session_id,
           CAST(i AS INTEGER) AS frame_level, '0x' || upper(md5(CAST(event_id AS VARCHAR) || CAST(i AS VARCHAR))) AS frame_handle,
           CAST(i * 10 AS INTEGER) AS offset_start, CAST(i * 10 + 8 AS INTEGER) AS offset_end
    FROM (SELECT event_id, date_trunc('second', ts) AS event_time,
                 list_extract([{", ".join("'" + w + "'" for w in WAIT_VOCABULARY)}],
                              CAST(event_id % {len(WAIT_VOCABULARY)} AS INTEGER) + 1) AS wait_type,
                 CAST(round(value * 10) AS BIGINT) AS duration, event_id % 13 AS signal_duration,
                 CAST(user_id + 50 AS INTEGER) AS session_id,
                 unnest(generate_series(1, event_id % 3 + 1)) AS i FROM events) w
    WHERE wait_type NOT IN ({", ".join("'" + w + "'" for w in EXCLUDED_WAITS)}) AND duration > 100""")
def q_wait_events(spark, sf_dir):
    e = _wait_xml(spark, sf_dir).select("event_id", F.from_xml("event_data", ev.EVENT_XML_SCHEMA).alias("_e"))
    e = e.select("event_id", ev.event_time_from_text(F.col("_e._timestamp")).alias("event_time"),
                 F.col("_e.data").alias("_d"), F.col("_e.action").alias("_a"))
    w = e.select("event_id", "event_time", ev._named("_d", "wait_type").alias("wait_type"),
                 ev._named("_d", "duration").cast("bigint").alias("duration"),
                 ev._named("_d", "signal_duration").cast("bigint").alias("signal_duration"),
                 ev._named("_a", "session_id").cast("int").alias("session_id"),
                 ev._named("_a", "tsql_stack").alias("tsql_stack"))
    return ev.wait_events(w, EXCLUDED_WAITS, min_duration_ms=100)


# --- E6 health events -----------------------------------------------------------------------------------------

QP_SCHEMA = ("queryProcessing struct<_maxWorkers: int, _workersCreated: int, _workersIdle: int, "
             "_pendingTasks: int, _hasUnresolvableDeadlockOccurred: int>")
HEALTH_SEEN = "2024-01-05 00:00:00"


@register("health_events", oracle=f"""
    SELECT event_id, date_trunc('second', ts) AS event_time, 'QUERY_PROCESSING' AS component,
           CASE WHEN value > 400 THEN 'WARNING' ELSE 'CLEAN' END AS state,
           512 AS maxWorkers, CAST(user_id AS INTEGER) AS workersCreated, CAST(user_id % 17 AS INTEGER) AS workersIdle,
           CAST(event_id % 5 AS INTEGER) AS pendingTasks, CAST(CASE WHEN value > 480 THEN 1 ELSE 0 END AS INTEGER)
               AS hasUnresolvableDeadlockOccurred
    FROM events WHERE date_trunc('second', ts) > TIMESTAMP '{HEALTH_SEEN}'""")
def q_health_events(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    inner = F.concat(F.lit('<queryProcessing maxWorkers="512" workersCreated="'), _s("user_id"),
                     F.lit('" workersIdle="'), _s(F.col("user_id") % 17), F.lit('" pendingTasks="'),
                     _s(F.col("event_id") % 5), F.lit('" hasUnresolvableDeadlockOccurred="'),
                     F.when(F.col("value") > 480, "1").otherwise("0"), F.lit('"/>'))
    xml = F.concat(F.lit('<event name="sp_server_diagnostics_component_result" timestamp="'), _ts_attr(F.col("ts")),
                   F.lit('"><data name="component"><text>QUERY_PROCESSING</text></data><data name="state"><text>'),
                   F.when(F.col("value") > 400, "WARNING").otherwise("CLEAN"),
                   F.lit('</text></data><data name="data"><value>'), inner, F.lit("</value></data></event>"))
    h = ev.health_events(e.select("event_id", xml.alias("event_data")), "event_data", QP_SCHEMA,
                         seen_max=HEALTH_SEEN, keep=["event_id"])
    return h.select("event_id", "event_time", "component", "state",
                    *[F.col(f"queryProcessing._{c}").alias(c) for c in
                      ("maxWorkers", "workersCreated", "workersIdle", "pendingTasks",
                       "hasUnresolvableDeadlockOccurred")])


# --- session activity (W3, W4, wait_info parse, thousands separators) ----------------------------------------

_SESS_CTE = """SELECT user_id AS session_id, date_trunc('hour', ts) AS collection_time,
                      MIN(ts) AS first_ts, COUNT(*) AS n, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v
               FROM events GROUP BY 1, 2"""


@register("session_activity", oracle=f"""
    SELECT session_id, collection_time, wait_info, wait_ms, wait_type, cpu,
           row_number() OVER (PARTITION BY session_id ORDER BY collection_time DESC) = 1 AS is_last_collection,
           dense_rank() OVER (ORDER BY session_start, session_id) AS session_seq
    FROM (SELECT s.*, '(' || CAST(v AS VARCHAR) || 'ms)' || (CASE WHEN n > 1 THEN 'LCK_M_S' ELSE 'PAGEIOLATCH_SH' END)
                      || ':' || CAST(n AS VARCHAR) AS wait_info,
                 v AS wait_ms, CASE WHEN n > 1 THEN 'LCK_M_S' ELSE 'PAGEIOLATCH_SH' END AS wait_type,
                 CAST(v * 1000 AS DOUBLE) AS cpu,
                 MIN(first_ts) OVER (PARTITION BY session_id) AS session_start
          FROM ({_SESS_CTE}) s) x""")
def q_session_activity(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "ts", "user_id", "value")
    s = e.groupBy(F.col("user_id").alias("session_id"), trunc_ntz("hour", "ts").alias("collection_time")).agg(
        F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("v"))
    wtype = F.when(F.col("n") > 1, "LCK_M_S").otherwise("PAGEIOLATCH_SH")
    s = s.select("session_id", "collection_time", "first_ts",
                 F.concat(F.lit("("), _s("v"), F.lit("ms)"), wtype, F.lit(":"), _s("n")).alias("wait_info"),
                 F.format_number(F.col("v") * 1000, 0).alias("cpu_text"))
    ms, typ = parse_wait_info("wait_info")
    s = s.select("session_id", "collection_time", "first_ts", "wait_info", ms.alias("wait_ms"),
                 typ.alias("wait_type"), grouped_number("cpu_text").alias("cpu"))
    # last collection per session: a per-session aggregate joined back (no whole-session window)
    last = s.groupBy("session_id").agg(F.max("collection_time").alias("_last"),
                                       F.min("first_ts").alias("session_start"))
    s = s.join(last, "session_id").withColumn("is_last_collection", F.col("collection_time") == F.col("_last"))
    ranked = ev.dense_rank_global(s, ["session_start", "session_id"], alias="session_seq")
    return ranked.select("session_id", "collection_time", "wait_info", "wait_ms", "wait_type", "cpu",
                         "is_last_collection", "session_seq")


# --- job history (S5, J2, F12, T8) ------------------------------------------------------------------------------

def _hist_sql() -> str:
    return """SELECT o_orderkey AS instance_id, o_custkey % 20 AS job_id, CAST(o_orderkey % 3 AS INTEGER) AS step_id,
                     CAST(o_orderkey % 6 AS INTEGER) AS run_status,
                     CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS run_date,
                     CAST((o_orderkey % 24) * 10000 + (o_orderkey % 60) * 100 + o_custkey % 60 AS INTEGER) AS run_time,
                     CAST(floor(o_totalprice / 10000) % 3 * 10000 + (o_custkey % 60) * 100 + o_orderkey % 60 AS INTEGER)
                         AS run_duration
              FROM orders"""


@register("job_history", oracle=f"""
    SELECT h.*, run_start_utc + to_seconds(run_duration_s) AS run_end_utc,
           {enums.case_sql('h.run_status', enums.JOB_RUN_STATUS, enums.JOB_RUN_STATUS_DEFAULT)} AS run_status_desc,
           c.c_name AS job_name, 'step ' || CAST(h.step_id AS VARCHAR) AS step_name
    FROM (SELECT *, make_timestamp(run_date // 10000, run_date // 100 % 100, run_date % 100,
                                   run_time // 10000, run_time // 100 % 100, run_time % 100)
                    - to_minutes(CAST(job_id % 3 * 60 AS BIGINT)) AS run_start_utc,
                 CAST(run_duration // 10000 * 3600 + run_duration // 100 % 100 * 60 + run_duration % 100 AS BIGINT)
                    AS run_duration_s,
                 CAST(job_id % 3 * 60 AS INTEGER) AS utc_offset_minutes
          FROM ({_hist_sql()}) x
          WHERE instance_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00')) h
    JOIN customer c ON c.c_custkey = h.job_id""")
def q_job_history(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    h = o.select(F.col("o_orderkey").alias("instance_id"), (F.col("o_custkey") % 20).alias("job_id"),
                 (F.col("o_orderkey") % 3).cast("int").alias("step_id"),
                 (F.col("o_orderkey") % 6).cast("int").alias("run_status"),
                 F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("run_date"),
                 ((F.col("o_orderkey") % 24) * 10000 + (F.col("o_orderkey") % 60) * 100 + F.col("o_custkey") % 60)
                 .cast("int").alias("run_time"),
                 (F.floor(F.col("o_totalprice") / 10000) % 3 * 10000 + (F.col("o_custkey") % 60) * 100
                  + F.col("o_orderkey") % 60).cast("int").alias("run_duration"))
    h = h.withColumn("utc_offset_minutes", (F.col("job_id") % 3 * 60).cast("int"))
    seen = o.filter(F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")) \
            .select(F.col("o_orderkey").alias("instance_id"))
    j = job_history_ingest(h, seen, offset_minutes_col="utc_offset_minutes")
    jobs = read_table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"))
    j = j.withColumn("run_status_desc", enums.job_status_desc("run_status"))
    j = j.join(broadcast_if_small(jobs), "job_id").withColumn(
        "step_name", F.concat(F.lit("step "), _s("step_id")))
    return j


# --- E2 blocked-process reports ----------------------------------------------------------------------------

def _report_xml(spark, sf_dir):
    from ..sources import fixtures as fx

    e = fx.fx_edge(spark, sf_dir)
    proc = lambda spid, app, db, buf, extra: F.concat(
        F.lit('<process spid="'), _s(spid), F.lit('" ecid="0"'), extra, F.lit(' clientapp="'), app,
        F.lit('" hostname="host'), _s(F.col("monitor_loop")), F.lit('" currentdbname="'), db, F.lit('"><inputbuf>'),
        buf, F.lit("</inputbuf></process>"))
    xml = F.concat(
        F.lit('<blocked-process-report monitorLoop="'), _s("monitor_loop"), F.lit('"><blocked-process>'),
        proc(F.col("blocked_spid"), F.lit("app_blocked"), F.col("database_name"),
             F.concat(F.lit("UPDATE t SET x = "), _s("o_orderkey")),
             F.concat(F.lit(' lockMode="'), F.col("lock_mode"), F.lit('"'))),
        F.lit("</blocked-process><blocking-process>"),
        proc(F.col("blocking_spid"), F.lit("app_blocking"), F.col("database_name"), F.lit("SELECT 1"), F.lit("")),
        F.lit("</blocking-process></blocked-process-report>"))
    return e.select("event_time", (F.col("blocking_duration_ms") * 1000).alias("duration"), xml.alias("report_xml"))


@register("blocked_process_edges", oracle="""
    SELECT monitor_loop, event_time, blocked_spid, 0 AS blocked_ecid, blocking_spid, 0 AS blocking_ecid, lock_mode,
           'app_blocked' AS blocked_clientapp, 'app_blocking' AS blocking_clientapp,
           'host' || CAST(monitor_loop AS VARCHAR) AS blocked_hostname,
           'host' || CAST(monitor_loop AS VARCHAR) AS blocking_hostname,
           database_name AS blocked_currentdbname, database_name AS blocking_currentdbname,
           'UPDATE t SET x = ' || CAST(o_orderkey AS VARCHAR) AS blocked_inputbuf, 'SELECT 1' AS blocking_inputbuf,
           CAST(blocking_duration_ms * 1000 AS DOUBLE) / 1000 AS blocking_duration_ms
    FROM (SELECT o_orderkey % 50 AS monitor_loop, o_orderdate AS event_time,
                 CAST(floor(o_orderkey / 50) + 2 AS INTEGER) AS blocked_spid,
                 CAST(floor(floor(o_orderkey / 50) / 3) + 1 AS INTEGER) AS blocking_spid,
                 o_orderstatus AS lock_mode, o_orderpriority AS database_name,
                 CAST(round(o_totalprice) AS BIGINT) AS blocking_duration_ms, o_orderkey
          FROM orders) e
    WHERE event_time >= TIMESTAMP '1997-01-01 00:00:00'""")
def q_blocked_process_edges(spark, sf_dir):
    from ..sources import fixtures as fx

    x = _report_xml(spark, sf_dir)
    # edges stored by earlier runs: the blocking edges recorded before the cut-off
    seen = fx.fx_edge(spark, sf_dir).filter(F.col("event_time") < F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    return ev.blocked_process_edges(x, seen=seen)
