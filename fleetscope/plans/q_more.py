"""Queries: error-log star, I/O health events, merge of expanded checks, table sizes, server settings, check facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import events as ev
from ..operators import report as rp
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .config import Relation
from .fixture_sql import with_fixtures
from .q_checks import CHECK_CONFIG, _CHG_CTE, _DYN_CTE, _STATUS_CTE, _cfg_sql, _changes
from .q_events import HEALTH_SEEN, _s, _ts_attr
from .q_ingest import KEYWORDS, _LINES_SQL, _lines
from .registry import register

T = "snapshot_time"
LOG_CUT = "2024-01-04 00:00:00"

# --- E9 error-log star -------------------------------------------------------------------------------------

_KW_LINES = f"""SELECT l.log_date, l.log_type_id, l.attribute_value, l.text, k.keyword_id
    FROM ({_LINES_SQL}) l JOIN ({KEYWORDS.sql()}) k ON k.log_type_id = l.log_type_id"""
_ATTRIBUTE = "CASE log_type_id WHEN 1 THEN 'ProcessInfo' WHEN 2 THEN 'ErrorLevel' ELSE '' END"
_STAR = [
    ("lines", f"SELECT *, {_ATTRIBUTE} AS attribute_name FROM ({_KW_LINES}) x"),
    ("attrs", """SELECT attribute_name, attribute_value, dense_rank() OVER (ORDER BY attribute_name, attribute_value) AS attribute_id
                 FROM (SELECT DISTINCT attribute_name, attribute_value FROM lines) a"""),
    ("stored", f"""SELECT text, dense_rank() OVER (ORDER BY text) AS id
                   FROM (SELECT DISTINCT text FROM lines WHERE log_date < TIMESTAMP '{LOG_CUT}') t"""),
    ("texts", f"""SELECT text, id AS errorlog_text_id FROM stored
                  UNION ALL SELECT text, (SELECT COALESCE(MAX(id), 0) FROM stored) + dense_rank() OVER (ORDER BY text)
                  FROM (SELECT DISTINCT text FROM lines WHERE log_date >= TIMESTAMP '{LOG_CUT}'
                        AND text NOT IN (SELECT text FROM stored)) n"""),
]


def _star(spark, sf_dir):
    """The star after a second run: texts logged before the cut are stored already."""
    lines = _lines(spark, sf_dir).join(KEYWORDS.df(spark).select("keyword_id", "log_type_id"), "log_type_id")
    cut = F.lit(LOG_CUT).cast("timestamp_ntz")
    attrs, texts, first = ev.errorlog_star(lines.filter(F.col("log_date") < cut))
    attrs, texts, second = ev.errorlog_star(lines.filter(F.col("log_date") >= cut), texts=texts)
    return first, second, texts


@register("errorlog_texts", oracle=with_fixtures("""
    SELECT t.errorlog_text_id, t.text, COUNT(*) AS occurrences, MIN(l.log_date) AS first_occurrence,
           MAX(l.log_date) AS last_occurrence
    FROM texts t JOIN lines l USING (text) GROUP BY 1, 2""", extra=_STAR))
def q_errorlog_texts(spark, sf_dir):
    _, _, texts = _star(spark, sf_dir)
    return texts.select("errorlog_text_id", "text", "occurrences", "first_occurrence", "last_occurrence")


@register("errorlog_facts", oracle=with_fixtures("""
    SELECT l.log_date, a.attribute_id, a.attribute_name, t.text, l.keyword_id, l.log_type_id, COUNT(*) AS record_count
    FROM lines l JOIN attrs a USING (attribute_name, attribute_value) JOIN texts t USING (text)
    GROUP BY ALL""", extra=_STAR))
def q_errorlog_facts(spark, sf_dir):
    """Facts by id, joined back to their dimensions."""
    lines = _lines(spark, sf_dir).join(KEYWORDS.df(spark).select("keyword_id", "log_type_id"), "log_type_id")
    attrs, texts, facts = ev.errorlog_star(lines)
    return (facts.join(attrs, "attribute_id").join(texts.select("errorlog_text_id", "text"), "errorlog_text_id")
            .select("log_date", "attribute_id", "attribute_name", "text", "keyword_id", "log_type_id", "record_count"))


# --- E6 I/O subsystem --------------------------------------------------------------------------------------

@register("io_subsystem_events", oracle=f"""
    SELECT event_id, date_trunc('second', ts) AS event_time, user_id AS io_latch_timeouts, event_id % 11 AS total_long_ios,
           CASE WHEN event_id % 3 > 0 THEN 'd:\\data\\f' || CAST(event_id AS VARCHAR) || '_0.mdf' END AS longest_pending_request_file,
           CASE WHEN event_id % 3 > 0 THEN CAST(round(value) AS BIGINT) END AS longest_pending_request_duration
    FROM events WHERE event_id % 2 = 0 AND date_trunc('second', ts) > TIMESTAMP '{HEALTH_SEEN}'""")
def q_io_subsystem_events(spark, sf_dir):
    """Diagnostics results of both kinds; pending requests vary from none to two."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    request = lambda i: F.concat(F.lit('<pendingRequest filePath="d:\\data\\f'), _s("event_id"), F.lit("_"), _s(i),
                                 F.lit('.mdf" duration="'), _s(F.round("value").cast("bigint") + i), F.lit('"/>'))
    pending = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, request(F.lit(0))) \
               .otherwise(F.concat(request(F.lit(0)), request(F.lit(1))))
    io = F.concat(F.lit('<ioSubsystem ioLatchTimeouts="'), _s("user_id"), F.lit('" totalLongIos="'), _s(F.col("event_id") % 11),
                  F.lit('"><longestPendingRequests>'), pending, F.lit("</longestPendingRequests></ioSubsystem>"))
    inner = F.when(F.col("event_id") % 2 == 0, io).otherwise(F.lit('<queryProcessing maxWorkers="512"/>'))
    xml = F.concat(F.lit('<event name="sp_server_diagnostics_component_result" timestamp="'), _ts_attr(F.col("ts")),
                   F.lit('"><data name="component"><text>X</text></data><data name="data"><value>'), inner,
                   F.lit("</value></data></event>"))
    return ev.io_subsystem_events(e.select("event_id", xml.alias("event_data")), "event_data", seen_max=HEALTH_SEEN, keep=["event_id"])


# --- L9 merge of expanded checks ----------------------------------------------------------------------------

TEMPLATE_ACTIONS = Relation("template_id int, action_id int, action_every_failure boolean", [(1, 1, False), (1, 2, True), (2, 1, False)])

_EXPANDED = """SELECT concat('srv', CAST(c_nationkey AS VARCHAR)) AS sql_instance, 'Check ' || CAST(c_custkey AS VARCHAR) AS check_name,
       CAST(c_custkey AS BIGINT) AS check_id, CAST(c_custkey % 2 + 1 AS INTEGER) AS template_id, '>' || CAST(c_nationkey AS VARCHAR) AS threshold
FROM customer WHERE c_custkey % 10 <> 0"""
_STORED = """SELECT concat('srv', CAST(c_nationkey AS VARCHAR)) AS sql_instance, 'Check ' || CAST(c_custkey AS VARCHAR) AS check_name,
       CAST(c_custkey AS BIGINT) AS check_id, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 2 + 1 AS INTEGER) END AS template_id,
       'old' AS threshold, c_custkey % 5 = 0 AS user_modified FROM customer WHERE c_custkey % 3 <> 0"""


def _expansion(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    rows = c.select(F.concat(F.lit("srv"), F.col("c_nationkey").cast("string")).alias("sql_instance"),
                    F.concat(F.lit("Check "), F.col("c_custkey").cast("string")).alias("check_name"),
                    F.col("c_custkey").cast("bigint").alias("check_id"), (F.col("c_custkey") % 2 + 1).cast("int").alias("template_id"),
                    F.concat(F.lit(">"), F.col("c_nationkey").cast("string")).alias("threshold"))
    expanded = rows.filter(F.col("check_id") % 10 != 0)
    loose = (F.col("check_id") % 7 == 0) & (F.col("check_id") % 10 == 0)
    stored = rows.filter(F.col("check_id") % 3 != 0).withColumn("threshold", F.lit("old")) \
                 .withColumn("template_id", F.when(~loose, F.col("template_id"))) \
                 .withColumn("user_modified", F.col("check_id") % 5 == 0)
    return stored, expanded


@register("template_merge", oracle=f"""
    SELECT e.sql_instance, e.check_name, e.check_id,
           CASE WHEN COALESCE(s.user_modified, FALSE) THEN s.template_id ELSE e.template_id END AS template_id,
           CASE WHEN COALESCE(s.user_modified, FALSE) THEN s.threshold ELSE e.threshold END AS threshold,
           COALESCE(s.user_modified, FALSE) AS user_modified
    FROM ({_EXPANDED}) e LEFT JOIN ({_STORED}) s USING (sql_instance, check_name)
    UNION ALL
    SELECT s.* FROM ({_STORED}) s WHERE s.template_id IS NULL
     AND NOT EXISTS (SELECT 1 FROM ({_EXPANDED}) e WHERE e.sql_instance = s.sql_instance AND e.check_name = s.check_name)""")
def q_template_merge(spark, sf_dir):
    """New, changed, user-modified, stale and template-free checks after an expansion."""
    return al.merge_expanded(*_expansion(spark, sf_dir))


@register("default_actions", oracle=f"""
    SELECT e.check_id, a.action_id, CASE WHEN e.check_id % 4 = 0 AND a.action_id = 1 THEN TRUE ELSE a.action_every_failure END
               AS action_every_failure
    FROM ({_EXPANDED}) e JOIN ({TEMPLATE_ACTIONS.sql()}) a USING (template_id)""")
def q_default_actions(spark, sf_dir):
    """Template actions for each check; actions that a user changed before stay."""
    _, expanded = _expansion(spark, sf_dir)
    mine = expanded.filter(F.col("check_id") % 4 == 0).select("check_id", F.lit(1).alias("action_id"), F.lit(True).alias("action_every_failure"))
    return al.default_actions(expanded, TEMPLATE_ACTIONS.df(spark), stored=mine)


# --- A21, report star ----------------------------------------------------------------------------------------

@register("table_sizes", oracle="""
    SELECT 's' || CAST(p_size % 3 AS VARCHAR) AS schema_name, p_brand AS table_name, p_type AS data_compression_desc,
           CAST(SUM(p_partkey) AS BIGINT) AS row_count,
           CAST(round(CAST(SUM(p_size * 10) AS DECIMAL(28,0)) * 8 / 1024, 2) AS DECIMAL(28,2)) AS total_space_mb,
           CAST(round(CAST(SUM(p_size * 7) AS DECIMAL(28,0)) * 8 / 1024, 2) AS DECIMAL(28,2)) AS used_space_mb,
           CAST(round(CAST(SUM(p_size * 3) AS DECIMAL(28,0)) * 8 / 1024, 2) AS DECIMAL(28,2)) AS unused_space_mb
    FROM part GROUP BY 1, 2, 3""")
def q_table_sizes(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    parts = p.select(F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string")).alias("schema_name"), F.col("p_brand").alias("table_name"),
                     F.col("p_type").alias("data_compression_desc"), F.col("p_partkey").alias("rows"),
                     (F.col("p_size").cast("bigint") * 10).alias("total_pages"), (F.col("p_size").cast("bigint") * 7).alias("used_pages"))
    return rp.table_sizes(parts)


@register("sys_configurations", oracle="""
    SELECT 'srv' || CAST(s_nationkey AS VARCHAR) AS sql_instance, CAST(s_suppkey AS INTEGER) AS configuration_id, s_name AS name,
           s_suppkey * 3 AS value, s_suppkey * 2 AS value_in_use, 'option' AS description FROM supplier
    UNION ALL
    SELECT 'srv' || CAST(n_nationkey AS VARCHAR), -1, 'version', CAST('150' || CAST(2000 + n_nationkey AS VARCHAR) || '5' AS BIGINT),
           CAST('150' || CAST(2000 + n_nationkey AS VARCHAR) || '5' AS BIGINT), 'Version as integer: xx.x.xxxx.xx' FROM nation""")
def q_sys_configurations(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey")
    inst = lambda c: F.concat(F.lit("srv"), F.col(c).cast("string")).alias("sql_instance")
    settings = s.select(inst("s_nationkey"), F.col("s_suppkey").cast("int").alias("configuration_id"), F.col("s_name").alias("name"),
                        (F.col("s_suppkey") * 3).alias("value"), (F.col("s_suppkey") * 2).alias("value_in_use"),
                        F.lit("option").alias("description"))
    versions = n.select(inst("n_nationkey"), F.concat(F.lit("15.0."), (F.col("n_nationkey") + 2000).cast("string"), F.lit(".5"))
                        .alias("product_version"))
    return rp.sys_configurations(settings, versions)


@register("fact_check", oracle=with_fixtures("""
    SELECT c.sql_instance, c.snapshot_time, c.check_id, g.check_name, c.check_value, c.check_status, f.n AS check_exec_time_ms,
           c.snapshot_time + INTERVAL 60 MINUTE AS report_time, c.status_change, c.check_id AS snapshot_type_id,
           'Check ' || g.check_name AS check_description
    FROM chg c JOIN cfg g USING (check_id) JOIN fx_check f USING (sql_instance, check_id, snapshot_time)
    JOIN fx_header h ON h.sql_instance = c.sql_instance AND h.snapshot_type_id = c.check_id AND h.snapshot_time = c.snapshot_time""",
    "fx_check", "fx_header", extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _CHG_CTE]))
def q_fact_check(spark, sf_dir):
    timed = fx.fx_check(spark, sf_dir).select("sql_instance", "check_id", T, F.col("n").alias("check_exec_time_ms"))
    history = _changes(spark, sf_dir).join(timed, ["sql_instance", "check_id", T]).withColumn("snapshot_type_id", F.col("check_id"))
    header = fx.fx_header(spark, sf_dir).withColumn("report_time", F.timestamp_add("MINUTE", F.lit(60), F.col(T)))
    checks = CHECK_CONFIG.df(spark).select("check_id", "check_name", F.concat(F.lit("Check "), "check_name").alias("check_description"))
    return rp.fact_check(history, header, checks)
