"""Queries: the flagship hot-counter report, action decisions and suppression,
message rendering, report thresholds, check template expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import time_group
from ..operators import alerts as al
from ..operators import checks as ck
from ..operators.joins import broadcast_if_small
from ..operators.rates import cook_counters
from ..sources import fixtures as fx
from .config import COUNTER_DIM, Relation
from .fixture_sql import with_fixtures
from .q_checks import (
    CHECK_CONFIG, _CHG_CTE, _DYN_CTE, _STATUS_CTE, _cfg_sql, status_sql,
)
from .q_joins import _HDR_CTE, header_with_report_time
from .q_rates import _COOK_CTE, _COOK_SQL_VALUE, HP, prev_join
from .registry import register
from .sqlbits import tg_sql

T = "snapshot_time"

# Thresholds of the flagship report, per counter.
HOT_THRESHOLDS = Relation(
    "counter_name string, threshold_warning string, threshold_critical string",
    [
        ("User Connections", ">20000", ">60000"),
        ("Batch Requests/sec", ">1", ">3"),
        ("Buffer cache hit ratio", ">500000", ">700000"),
        ("Average Wait Time (ms)", ">0.001", ">0.002"),
        ("Elapsed Time:Requests", ">5000", ">15000"),
    ],
)


@register("hot_counters", headline=True, oracle=with_fixtures(f"""
    SELECT c.sql_instance, c.counter_name, c.time_bucket, c.max_value, c.samples,
           t.threshold_warning, t.threshold_critical,
           {status_sql('c.max_value', 't.threshold_critical', 't.threshold_warning')} AS status
    FROM (SELECT x.sql_instance, x.counter_name, {tg_sql('h.report_time', 15)} AS time_bucket,
                 MAX(x.cntr_value_calculated) AS max_value, COUNT(*) AS samples
          FROM (SELECT s.sql_instance, s.snapshot_type_id, s.snapshot_time, s.counter_name,
                       {_COOK_SQL_VALUE} AS cntr_value_calculated
                {prev_join('cs')}) x
          JOIN hdr h ON h.sql_instance = x.sql_instance AND h.snapshot_type_id = x.snapshot_type_id
                    AND h.snapshot_time = x.snapshot_time
          GROUP BY 1, 2, 3) c
    JOIN ({HOT_THRESHOLDS.sql()}) t USING (counter_name)""",
    "fx_sample", "fx_header", extra=[HP, _COOK_CTE, _HDR_CTE]))
def q_hot_counters(spark, sf_dir):
    samples = fx.fx_sample(spark, sf_dir).join(broadcast_if_small(COUNTER_DIM.df(spark)), "snapshot_type_id")
    header = header_with_report_time(spark, sf_dir)
    # the fact-header join (J1) happens inside the previous-snapshot join, carrying report_time
    facts = cook_counters(samples, fx.SAMPLE_KEYS, T, header=header.select(*fx.HEADER_KEYS, "report_time"),
                          header_cols=["report_time"])
    g = (facts.groupBy("sql_instance", "counter_name", time_group("report_time", 15).alias("time_bucket"))
         .agg(F.max("cntr_value_calculated").alias("max_value"), F.count(F.lit(1)).alias("samples")))
    g = g.join(broadcast_if_small(HOT_THRESHOLDS.df(spark)), "counter_name")
    return g.withColumn("status", ck.status_of("max_value", "threshold_critical", "threshold_warning"))


# --- L10 / L11 ------------------------------------------------------------------------------------------

CHECK_ACTIONS = Relation(
    "check_id int, action_id int, action_every_failure boolean, action_recovery boolean, "
    "action_repeat_period_minutes int, action_hourly_limit int, action_template_id int",
    [
        (1, 1, False, True, 60, 2, 1),
        (2, 1, True, True, None, 10, 1),
        (3, 2, False, False, 180, 1, 2),
        (4, 2, True, False, None, 5, 2),
        (5, 3, False, True, 30, 3, 1),
    ],
)

_DEC_SQL = with_fixtures(f"""
    SELECT c.sql_instance, c.check_id, a.action_id, c.snapshot_time, c.check_status, c.check_value,
           a.action_every_failure, a.action_recovery, a.action_repeat_period_minutes, a.action_hourly_limit,
           a.action_template_id, c.prev_check_status, c.prev_check_value,
           CASE WHEN c.check_status <> 'OK' AND COALESCE(c.prev_check_status, 'OK') = 'OK' THEN 'NEW'
                WHEN c.check_status = 'OK' AND COALESCE(c.prev_check_status, 'OK') <> 'OK' AND a.action_recovery
                     THEN 'RECOVERY'
                WHEN c.check_status <> 'OK' AND COALESCE(c.prev_check_status, 'OK') <> 'OK'
                     AND (c.prev_check_value IS NULL OR c.check_value <> c.prev_check_value) AND a.action_every_failure
                     THEN 'REPEAT'
                ELSE 'NONE' END AS action_type,
           COALESCE(c.check_status <> 'OK' AND c.prev_check_status = c.check_status
                    AND a.action_repeat_period_minutes IS NOT NULL, FALSE) AS repeat_candidate
    FROM (SELECT sql_instance, check_id, snapshot_time, check_status, check_value,
                 lag(check_status) OVER w AS prev_check_status, lag(check_value) OVER w AS prev_check_value
          FROM st WINDOW w AS (PARTITION BY sql_instance, check_id ORDER BY snapshot_time)) c
    JOIN ({CHECK_ACTIONS.sql()}) a USING (check_id)""", "fx_check", extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE])


def _decisions(spark, sf_dir):
    from .q_checks import _history

    # decisions need the previous status and value only (one previous-row pass), not the change flags
    h = _history(spark, sf_dir).select("sql_instance", "check_id", T, "check_status", "check_value")
    return al.action_candidates(h, CHECK_ACTIONS.df(spark))


@register("action_decision", oracle=_DEC_SQL)
def q_action_decision(spark, sf_dir):
    return _decisions(spark, sf_dir)


# The replay row by row: what was sent in the last hour and last of all is carried from candidate to candidate.
_SUPPRESS_SQL = with_fixtures("""
    SELECT sql_instance, check_id, action_id, snapshot_time, action_type, sent, suppressed_reason, action_count_last_hour
    FROM replay WHERE n > 0""", "fx_check", recursive=True, extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _CHG_CTE,
    ("flap", """
    SELECT c.sql_instance, c.check_id, c.snapshot_time, c.check_status, c.check_value,
           COALESCE(f.ratio BETWEEN 0.35 AND 0.65, FALSE) AND NOT g.ignore_flapping AS is_flapping
    FROM chg c JOIN cfg g USING (check_id)
    LEFT JOIN (
      SELECT a.sql_instance, a.check_id, a.snapshot_time, AVG(CAST(b.status_change AS DOUBLE)) AS ratio
      FROM (SELECT *, row_number() OVER (PARTITION BY sql_instance, check_id ORDER BY snapshot_time) AS rn FROM chg) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY sql_instance, check_id ORDER BY snapshot_time) AS rn FROM chg) b
        ON a.sql_instance = b.sql_instance AND a.check_id = b.check_id
       AND b.rn BETWEEN a.rn - 12 AND a.rn - 1 AND b.snapshot_time > a.snapshot_time - INTERVAL 6 HOUR
      GROUP BY a.sql_instance, a.check_id, a.snapshot_time) f
      ON f.sql_instance = c.sql_instance AND f.check_id = c.check_id AND f.snapshot_time = c.snapshot_time"""),
    ("decided", f"""
    SELECT c.*, a.action_id, a.action_every_failure, a.action_repeat_period_minutes, a.action_hourly_limit,
           CASE WHEN c.check_status <> 'OK' AND COALESCE(c.ps, 'OK') = 'OK' THEN 'NEW'
                WHEN c.check_status = 'OK' AND COALESCE(c.ps, 'OK') <> 'OK' AND a.action_recovery THEN 'RECOVERY'
                WHEN c.check_status <> 'OK' AND COALESCE(c.ps, 'OK') <> 'OK' AND a.action_every_failure
                     AND (c.pv IS NULL OR c.check_value <> c.pv) THEN 'REPEAT' ELSE 'NONE' END AS typ,
           COALESCE(c.check_status <> 'OK' AND c.ps = c.check_status AND a.action_repeat_period_minutes IS NOT NULL, FALSE) AS rep
    FROM (SELECT *, lag(check_status) OVER w AS ps, lag(check_value) OVER w AS pv FROM flap
          WINDOW w AS (PARTITION BY sql_instance, check_id ORDER BY snapshot_time)) c
    JOIN ({CHECK_ACTIONS.sql()}) a USING (check_id)"""),
    ("cand", """
    SELECT *, row_number() OVER (PARTITION BY sql_instance, check_id, action_id ORDER BY snapshot_time) AS n
    FROM decided WHERE typ <> 'NONE' OR rep"""),
    ("replay", """
    SELECT sql_instance, check_id, action_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS snapshot_time,
           CAST(NULL AS VARCHAR) AS action_type, FALSE AS sent, CAST(NULL AS VARCHAR) AS suppressed_reason,
           CAST(0 AS INTEGER) AS action_count_last_hour, CAST([] AS TIMESTAMP[]) AS times, TIMESTAMP '1970-01-01' AS latest
    FROM cand WHERE n = 1
    UNION ALL
    SELECT sql_instance, check_id, action_id, n, snapshot_time, outcome, outcome <> 'NONE', reason, hour_count,
           CASE WHEN outcome <> 'NONE' THEN list_append(recent, snapshot_time) ELSE recent END,
           CASE WHEN outcome <> 'NONE' THEN snapshot_time ELSE latest END
    FROM (SELECT *, CASE WHEN reason IS NOT NULL THEN 'NONE'
                         WHEN typ = 'NONE' AND date_diff('minute', latest, snapshot_time) > action_repeat_period_minutes
                         THEN 'REPEAT' ELSE typ END AS outcome
          FROM (SELECT *, CAST(len(recent) AS INTEGER) AS hour_count,
                       CASE WHEN is_flapping AND NOT action_every_failure THEN 'FLAPPING'
                            WHEN len(recent) > action_hourly_limit THEN 'HOURLY LIMIT' END AS reason
                FROM (SELECT c.*, p.latest,
                             list_filter(p.times, lambda x: x > c.snapshot_time - INTERVAL 1 HOUR) AS recent
                      FROM replay p JOIN cand c ON c.n = p.n + 1 AND c.sql_instance = p.sql_instance
                       AND c.check_id = p.check_id AND c.action_id = p.action_id) a) b) d"""),
])


@register("action_suppress", oracle=_SUPPRESS_SQL)
def q_action_suppress(spark, sf_dir):
    from .q_checks import _history

    h = _history(spark, sf_dir).select("sql_instance", "check_id", T, "check_value", "check_status")
    ch = ck.status_change(h, ["sql_instance", "check_id"], T, "check_status",
                          keep_previous=["check_status", "check_value"])
    ch = ch.join(broadcast_if_small(CHECK_CONFIG.df(spark).select("check_id", "ignore_flapping")), "check_id")
    fl = ck.flapping(ch, ["sql_instance", "check_id"], T, ignore_col="ignore_flapping")
    cand = al.action_candidates(fl.select("sql_instance", "check_id", T, "check_status", "check_value",
                                          "prev_check_status", "prev_check_value", "is_flapping"),
                                CHECK_ACTIONS.df(spark))
    return al.action_suppress(cand)


# --- L13 ---------------------------------------------------------------------------------------------------

TEMPLATES = Relation(
    "action_template_id int, fail_subject string, fail_body string, recover_subject string, recover_body string, "
    "repeat_subject string, repeat_body string",
    [
        (1, "{CHECK_STATUS}: {CHECK_NAME} on {SQL_INSTANCE}",
         "Check {CHECK_ID} is {CHECK_STATUS} (value {CHECK_VALUE}, threshold {THRESHOLD_CRITICAL}) at {CHECK_TIME}.",
         "RECOVERED: {CHECK_NAME} on {SQL_INSTANCE}", "Check {CHECK_ID} is back to OK, was {CHECK_LAST_STATUS}.",
         "STILL {CHECK_STATUS}: {CHECK_NAME}", "Value {CHECK_VALUE}, last {CHECK_LAST_VALUE}."),
        (2, "[{SQL_INSTANCE}] {CHECK_NAME}", "{CHECK_STATUS} {CHECK_VALUE}", "[{SQL_INSTANCE}] ok",
         "{CHECK_NAME} recovered", "[{SQL_INSTANCE}] repeat", "{CHECK_STATUS} again"),
    ],
)


def _dec_token_sql(name: str) -> str:
    return {
        "{CHECK_STATUS}": "d.check_status", "{CHECK_NAME}": "g.check_name", "{SQL_INSTANCE}": "d.sql_instance",
        "{CHECK_ID}": "CAST(d.check_id AS VARCHAR)",
        "{CHECK_VALUE}": "CAST(CAST(d.check_value AS DECIMAL(28,5)) AS VARCHAR)",
        "{CHECK_LAST_VALUE}": "COALESCE(CAST(CAST(d.prev_check_value AS DECIMAL(28,5)) AS VARCHAR), 'N/A')",
        "{CHECK_LAST_STATUS}": "COALESCE(d.prev_check_status, 'N/A')",
        "{THRESHOLD_CRITICAL}": "COALESCE(g.check_threshold_critical, '')",
        "{CHECK_TIME}": "strftime(d.snapshot_time, '%Y-%m-%d %H:%M:%S')",
    }[name]


_TOKENS = ["{CHECK_STATUS}", "{CHECK_NAME}", "{SQL_INSTANCE}", "{CHECK_ID}", "{CHECK_VALUE}", "{CHECK_LAST_VALUE}",
           "{CHECK_LAST_STATUS}", "{THRESHOLD_CRITICAL}", "{CHECK_TIME}"]


def _render_sql(template: str) -> str:
    out = template
    for tok in _TOKENS:
        out = f"replace({out}, '{tok}', COALESCE({_dec_token_sql(tok)}, ''))"
    return out


def _pick_sql(kind: str) -> str:
    return (f"CASE d.action_type WHEN 'NEW' THEN t.fail_{kind} WHEN 'RECOVERY' THEN t.recover_{kind} "
            f"WHEN 'REPEAT' THEN t.repeat_{kind} ELSE 'UNDEFINED' END")


@register("render_template", oracle=f"""
    SELECT d.sql_instance, d.check_id, d.action_id, d.snapshot_time, d.action_type,
           {_render_sql(_pick_sql('subject'))} AS subject, {_render_sql(_pick_sql('body'))} AS body
    FROM ({_DEC_SQL}) d JOIN ({CHECK_CONFIG.sql()}) g USING (check_id)
    LEFT JOIN ({TEMPLATES.sql()}) t USING (action_template_id)
    WHERE d.action_type <> 'NONE'""")
def q_render_template(spark, sf_dir):
    d = _decisions(spark, sf_dir).filter(F.col("action_type") != al.NONE)
    d = d.join(broadcast_if_small(CHECK_CONFIG.df(spark).select("check_id", "check_name", "check_threshold_critical")),
               "check_id")
    dec = lambda c: F.col(c).cast("decimal(28,5)").cast("string")
    tokens = {
        "{CHECK_STATUS}": F.col("check_status"), "{CHECK_NAME}": F.col("check_name"),
        "{SQL_INSTANCE}": F.col("sql_instance"), "{CHECK_ID}": F.col("check_id"),
        "{CHECK_VALUE}": dec("check_value"),
        "{CHECK_LAST_VALUE}": F.coalesce(dec("prev_check_value"), F.lit("N/A")),
        "{CHECK_LAST_STATUS}": F.coalesce(F.col("prev_check_status"), F.lit("N/A")),
        "{THRESHOLD_CRITICAL}": F.coalesce(F.col("check_threshold_critical"), F.lit("")),
        "{CHECK_TIME}": F.date_format(T, "yyyy-MM-dd HH:mm:ss"),
    }
    r = al.render_messages(d, TEMPLATES.df(spark), tokens)
    return r.select("sql_instance", "check_id", "action_id", T, "action_type", "subject", "body")


# --- L15 ----------------------------------------------------------------------------------------------------

@register("report_threshold", oracle=with_fixtures("""
    SELECT sql_instance, check_id, snapshot_time, check_value FROM fx_check
    WHERE CAST(check_value AS DECIMAL(28,5)) > CAST('75' AS DECIMAL(28,5))""", "fx_check"))
def q_report_threshold(spark, sf_dir):
    c = fx.fx_check(spark, sf_dir).select("sql_instance", "check_id", T, "check_value")
    return al.report_threshold(c, "check_value", ">75")


# --- L9 -------------------------------------------------------------------------------------------------------

CHECK_TEMPLATES = Relation(
    "template_id int, object_kind string, check_name string, check_threshold_warning string, "
    "check_threshold_critical string",
    [
        (1, "Disk", "Disk free % on {OBJECT}", "<0.1", "<0.05"),
        (2, "Disk", "Days until {OBJECT} is full", "<7", "<3"),
        (3, "Database", "Log backup age of {OBJECT}", ">60", ">1440"),
        (4, "Job", "Failures of job {OBJECT}", ">0", ">2"),
    ],
)


@register("expand_checks", oracle=f"""
    SELECT o.sql_instance, t.template_id, o.object_id, o.object_kind,
           t.template_id * 1000000 + o.object_id AS check_id,
           replace(t.check_name, '{{OBJECT}}', o.object_name) AS check_name,
           t.check_threshold_warning, t.check_threshold_critical
    FROM ({CHECK_TEMPLATES.sql()}) t JOIN (
      SELECT DISTINCT concat('srv', CAST(l_suppkey % 4 AS VARCHAR)) AS sql_instance, 'Disk' AS object_kind,
             l_suppkey AS object_id, 'vol' || CAST(l_suppkey AS VARCHAR) AS object_name FROM lineitem
      UNION ALL
      SELECT DISTINCT concat('srv', CAST(o_custkey % 4 AS VARCHAR)), 'Database', o_custkey,
             'db' || CAST(o_custkey AS VARCHAR) FROM orders
      UNION ALL
      SELECT DISTINCT concat('srv', CAST(p_partkey % 4 AS VARCHAR)), 'Job', p_partkey, p_name FROM part) o
      ON o.object_kind = t.object_kind""")
def q_expand_checks(spark, sf_dir):
    from ..sources.tables import read_table

    li = read_table(spark, sf_dir, "lineitem", "l_suppkey")
    o = read_table(spark, sf_dir, "orders", "o_custkey")
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    inst = lambda c: F.concat(F.lit("srv"), (F.col(c) % 4).cast("string"))
    objects = (li.select(inst("l_suppkey").alias("sql_instance"), F.lit("Disk").alias("object_kind"),
                         F.col("l_suppkey").alias("object_id"),
                         F.concat(F.lit("vol"), F.col("l_suppkey").cast("string")).alias("object_name")).distinct()
               .unionByName(o.select(inst("o_custkey").alias("sql_instance"), F.lit("Database").alias("object_kind"),
                                     F.col("o_custkey").alias("object_id"),
                                     F.concat(F.lit("db"), F.col("o_custkey").cast("string")).alias("object_name"))
                            .distinct())
               .unionByName(p.select(inst("p_partkey").alias("sql_instance"), F.lit("Job").alias("object_kind"),
                                     F.col("p_partkey").alias("object_id"), F.col("p_name").alias("object_name"))
                            .distinct()))
    return al.expand_checks(CHECK_TEMPLATES.df(spark), objects)
