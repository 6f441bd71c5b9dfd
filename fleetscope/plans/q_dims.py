"""Queries: upserts, soft deletes, last-seen refresh, type-2 history, rule
violations, retention, queue handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import trunc_ntz

from ..operators import dims, retention
from ..operators.alerts import queue_next, queue_update
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .config import Relation
from .fixture_sql import with_fixtures
from .registry import register
from .sqlbits import NOW, NOW_PY

DIM_NOW = "2001-08-01 12:00:00"
DIM_NOW_SQL = f"TIMESTAMP '{DIM_NOW}'"
#: Every order is in the source (from this day on, and all orders of every fifth database, which is new) or in the target.
SPLIT = "2000-07-01"
_IN_SOURCE_SQL = f"(o_orderdate >= TIMESTAMP '{SPLIT} 00:00:00' OR o_custkey % 5 = 0)"
ATTRS = ["recovery_model", "page_verify_option"]


def _orders(spark, sf_dir):
    return read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                      "o_orderpriority")


def _dim(o):
    order = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.col("o_custkey").alias("database_id")).agg(
        F.max_by("o_orderpriority", order).alias("recovery_model"),
        F.max_by("o_orderstatus", order).alias("page_verify_option"),
        F.max("o_orderdate").alias("date_last_seen"),
        F.min("o_orderdate").alias("date_updated")) \
        .withColumn("sql_instance", F.concat(F.lit("srv"), (F.col("database_id") % 4).cast("string")))


def _in_source():
    return (F.col("o_orderdate") >= F.lit(SPLIT).cast("timestamp_ntz")) | (F.col("o_custkey") % 5 == 0)


def _target(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return _dim(o.filter(~_in_source())).withColumn("is_current", F.lit(True))


def _source(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return _dim(o.filter(_in_source()))


def _dim_sql(where: str) -> str:
    return f"""SELECT o_custkey AS database_id,
                      arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS recovery_model,
                      arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS page_verify_option,
                      MAX(o_orderdate) AS date_last_seen, MIN(o_orderdate) AS date_updated,
                      concat('srv', CAST(o_custkey % 4 AS VARCHAR)) AS sql_instance
               FROM orders WHERE {where} GROUP BY o_custkey"""


_TS = ("tgt", _dim_sql(f"NOT {_IN_SOURCE_SQL}"))
_SS = ("src", _dim_sql(_IN_SOURCE_SQL))


@register("upsert", oracle=with_fixtures(f"""
    SELECT COALESCE(t.database_id, s.database_id) AS database_id,
           CASE WHEN s.database_id IS NOT NULL THEN s.recovery_model ELSE t.recovery_model END AS recovery_model,
           CASE WHEN s.database_id IS NOT NULL THEN s.page_verify_option ELSE t.page_verify_option END AS page_verify_option,
           CASE WHEN t.database_id IS NULL THEN {DIM_NOW_SQL}
                WHEN s.database_id IS NOT NULL AND (t.recovery_model IS DISTINCT FROM s.recovery_model
                     OR t.page_verify_option IS DISTINCT FROM s.page_verify_option) THEN {DIM_NOW_SQL}
                ELSE t.date_updated END AS date_updated
    FROM tgt t FULL OUTER JOIN src s ON t.database_id = s.database_id""", extra=[_TS, _SS]))
def q_upsert(spark, sf_dir):
    return dims.upsert(_target(spark, sf_dir), _source(spark, sf_dir), ["database_id"], ATTRS, DIM_NOW)


@register("soft_delete", oracle=with_fixtures(f"""
    SELECT COALESCE(t.database_id, s.database_id) AS database_id,
           COALESCE(t.sql_instance, s.sql_instance) AS sql_instance,
           CASE WHEN s.database_id IS NOT NULL THEN s.recovery_model ELSE t.recovery_model END AS recovery_model,
           CASE WHEN s.database_id IS NOT NULL THEN s.page_verify_option ELSE t.page_verify_option END AS page_verify_option,
           CASE WHEN s.database_id IS NOT NULL THEN TRUE
                WHEN COALESCE(t.sql_instance, s.sql_instance) IN (SELECT sql_instance FROM src) THEN FALSE
                ELSE t.is_current END AS is_current,
           CASE WHEN s.database_id IS NOT NULL AND t.database_id IS NULL THEN {DIM_NOW_SQL}
                WHEN s.database_id IS NOT NULL AND (t.date_last_seen IS NULL
                     OR date_diff('hour', t.date_last_seen, {DIM_NOW_SQL}) >= 24) THEN {DIM_NOW_SQL}
                ELSE t.date_last_seen END AS date_last_seen
    FROM (SELECT *, TRUE AS is_current FROM tgt) t FULL OUTER JOIN src s
      ON t.database_id = s.database_id AND t.sql_instance = s.sql_instance""", extra=[_TS, _SS]))
def q_soft_delete(spark, sf_dir):
    return dims.soft_delete(_target(spark, sf_dir), _source(spark, sf_dir), ["database_id", "sql_instance"],
                            ["sql_instance"], ATTRS, DIM_NOW)


@register("last_seen", oracle=with_fixtures(f"""
    SELECT a.database_id, a.recovery_model, a.page_verify_option, a.date_updated, a.sql_instance,
           CASE WHEN s.database_id IS NOT NULL AND (a.date_last_seen IS NULL
                     OR date_diff('hour', a.date_last_seen, {DIM_NOW_SQL}) >= 24) THEN {DIM_NOW_SQL}
                ELSE a.date_last_seen END AS date_last_seen
    FROM alld a LEFT JOIN (SELECT DISTINCT database_id FROM src) s USING (database_id)""",
    extra=[("alld", _dim_sql("TRUE")), _SS]))
def q_last_seen(spark, sf_dir):
    return dims.last_seen(_dim(_orders(spark, sf_dir)), _source(spark, sf_dir), ["database_id"], DIM_NOW)


@register("scd2", headline=True, oracle="""
    SELECT o_custkey, o_orderpriority, valid_from,
           lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS valid_until
    FROM (SELECT o_custkey, o_orderpriority, t AS valid_from,
                 lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY t) AS prev_p,
                 lag(t) OVER (PARTITION BY o_custkey ORDER BY t) AS prev_t
          FROM (SELECT o_custkey, o_orderpriority, o_orderdate + to_microseconds(o_orderkey) AS t FROM orders) o) x
    WHERE prev_t IS NULL OR o_orderpriority IS DISTINCT FROM prev_p""")
def q_scd2(spark, sf_dir):
    o = _orders(spark, sf_dir)
    obs = o.select("o_custkey", "o_orderpriority",
                   F.timestamp_add("MICROSECOND", F.col("o_orderkey"), F.col("o_orderdate")).alias("t"))
    return dims.scd2(obs, ["o_custkey"], "t", ["o_orderpriority"])


_ACTIONS_SQL = """SELECT o_orderkey AS action_id,
                         CASE WHEN o_orderstatus IN ('F', 'O') THEN 'exec' END AS action_exec,
                         CASE WHEN o_orderstatus IN ('O', 'P') THEN o_custkey END AS action_report_id FROM orders"""
_BASE_SQL = """SELECT o_orderkey - 10 AS baseline_id, concat('srv', CAST(o_custkey % 4 AS VARCHAR)) AS sql_instance,
                      date_trunc('month', o_orderdate) AS baseline_start,
                      date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS baseline_end,
                      o_orderpriority = '1-URGENT' AS is_default FROM orders"""


@register("rule_violations", oracle=with_fixtures("""
    SELECT 'MULTIPLE_DEFAULT_BASELINES' AS rule, sql_instance AS subject FROM b WHERE is_default
        GROUP BY sql_instance HAVING COUNT(*) > 1
    UNION ALL
    SELECT 'DUPLICATE_BASELINE_WINDOW', concat_ws('|', sql_instance, CAST(baseline_start AS VARCHAR),
                                                  CAST(baseline_end AS VARCHAR))
        FROM b GROUP BY sql_instance, baseline_start, baseline_end HAVING COUNT(*) > 1
    UNION ALL
    SELECT 'RESERVED_ID', CAST(baseline_id AS VARCHAR) FROM b WHERE baseline_id < 0
    UNION ALL
    SELECT 'ACTION_EXEC_XOR_REPORT', CAST(action_id AS VARCHAR) FROM a
        WHERE CAST(action_exec IS NOT NULL AS INTEGER) + CAST(action_report_id IS NOT NULL AS INTEGER) <> 1""",
    extra=[("b", _BASE_SQL), ("a", _ACTIONS_SQL)]))
def q_rule_violations(spark, sf_dir):
    o = _orders(spark, sf_dir)
    month = trunc_ntz("month", "o_orderdate")
    b = o.select((F.col("o_orderkey") - 10).alias("baseline_id"),
                 F.concat(F.lit("srv"), (F.col("o_custkey") % 4).cast("string")).alias("sql_instance"),
                 month.alias("baseline_start"), F.timestamp_add("MONTH", F.lit(1), month).alias("baseline_end"),
                 (F.col("o_orderpriority") == "1-URGENT").alias("is_default"))
    a = o.select(F.col("o_orderkey").alias("action_id"),
                 F.when(F.col("o_orderstatus").isin("F", "O"), F.lit("exec")).alias("action_exec"),
                 F.when(F.col("o_orderstatus").isin("O", "P"), F.col("o_custkey")).alias("action_report_id"))
    return dims.rule_violations(b, a)


# --- retention -----------------------------------------------------------------------------------------

POLICY = Relation("snapshot_type_id int, retention_days int", [(1, 8), (2, 3), (3, -1), (4, 30), (5, 2)])
_CUT_CTE = ("cut", f"""
    SELECT l.sql_instance, p.snapshot_type_id, p.retention_days,
           CASE WHEN p.retention_days > 0 THEN {NOW} - to_days(CAST(p.retention_days AS BIGINT)) ELSE l.latest END
               AS cutoff_time
    FROM (SELECT sql_instance, snapshot_type_id, MAX(snapshot_time) AS latest FROM fx_header
          GROUP BY sql_instance, snapshot_type_id) l
    JOIN ({POLICY.sql()}) p ON l.snapshot_type_id = p.snapshot_type_id""")


def _cutoffs(spark, sf_dir):
    h = fx.fx_header(spark, sf_dir)
    return retention.retention_cutoffs(POLICY.df(spark), h, NOW_PY)


@register("retention_cutoffs", oracle=with_fixtures("SELECT * FROM cut", "fx_header", extra=[_CUT_CTE]))
def q_retention_cutoffs(spark, sf_dir):
    return _cutoffs(spark, sf_dir)


@register("retention_apply", oracle=with_fixtures("""
    SELECT h.* FROM fx_header h LEFT JOIN cut c USING (sql_instance, snapshot_type_id)
    WHERE NOT (COALESCE(h.snapshot_time < c.cutoff_time, FALSE)
               AND NOT EXISTS (SELECT 1 FROM bt WHERE bt.sql_instance = h.sql_instance
                               AND bt.snapshot_time = h.snapshot_time))""", "fx_header", extra=[
    _CUT_CTE, ("bt", """SELECT DISTINCT sql_instance, snapshot_time FROM fx_header
                        WHERE snapshot_time >= TIMESTAMP '2024-01-05 00:00:00'
                          AND snapshot_time < TIMESTAMP '2024-01-06 00:00:00'""")]))
def q_retention_apply(spark, sf_dir):
    h = fx.fx_header(spark, sf_dir)
    bt = h.filter((F.col("snapshot_time") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
                  & (F.col("snapshot_time") < F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")))
    return retention.retention_apply(h, _cutoffs(spark, sf_dir), bt)


@register("orphan_purge", oracle=with_fixtures("""
    SELECT s.* FROM fx_sample s WHERE EXISTS (
      SELECT 1 FROM fx_header h LEFT JOIN cut c USING (sql_instance, snapshot_type_id)
      WHERE NOT COALESCE(h.snapshot_time < c.cutoff_time, FALSE) AND h.sql_instance = s.sql_instance
        AND h.snapshot_type_id = s.snapshot_type_id AND h.snapshot_time = s.snapshot_time)""",
    "fx_sample", "fx_header", extra=[_CUT_CTE]))
def q_orphan_purge(spark, sf_dir):
    kept = retention.retention_apply(fx.fx_header(spark, sf_dir), _cutoffs(spark, sf_dir))
    return retention.orphan_purge(fx.fx_sample(spark, sf_dir), kept)


@register("last_seen_purge", oracle=with_fixtures(f"""
    SELECT * FROM alld WHERE date_last_seen IS NULL OR date_last_seen >= {DIM_NOW_SQL} - INTERVAL 90 DAY""",
    extra=[("alld", _dim_sql("TRUE"))]))
def q_last_seen_purge(spark, sf_dir):
    return retention.last_seen_purge(_dim(_orders(spark, sf_dir)), DIM_NOW, days=90)


# --- queue ---------------------------------------------------------------------------------------------

QUEUE_NOW = "2001-09-01 00:00:00"


def _queue(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return o.select(F.col("o_orderkey").alias("queue_item_id"),
                    F.concat(F.lit("srv"), (F.col("o_custkey") % 4).cast("string")).alias("sql_instance"),
                    F.col("o_orderdate").alias("time_queued"),
                    F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "P", "RETRYING")
                     .when(F.col("o_orderpriority") == "1-URGENT", "FAILED").alias("exec_status"),
                    F.timestamp_add("MINUTE", F.col("o_orderkey") % 600, F.col("o_orderdate")).alias("exec_time_end"),
                    (F.col("o_orderkey") % 6).cast("int").alias("retry_count"))


_QUEUE_CTE = ("q", """SELECT o_orderkey AS queue_item_id, concat('srv', CAST(o_custkey % 4 AS VARCHAR)) AS sql_instance,
                      o_orderdate AS time_queued,
                      CASE WHEN o_orderstatus = 'F' THEN 'OK' WHEN o_orderstatus = 'P' THEN 'RETRYING'
                           WHEN o_orderpriority = '1-URGENT' THEN 'FAILED' END AS exec_status,
                      o_orderdate + to_minutes(o_orderkey % 600) AS exec_time_end,
                      CAST(o_orderkey % 6 AS INTEGER) AS retry_count FROM orders""")


@register("queue_next", oracle=with_fixtures(f"""
    SELECT queue_item_id, sql_instance, time_queued, exec_status, exec_time_end, retry_count FROM (
      SELECT *, row_number() OVER (PARTITION BY sql_instance ORDER BY time_queued, queue_item_id) AS rn FROM q
      WHERE exec_status IS NULL OR (exec_status = 'RETRYING' AND
            date_diff('minute', COALESCE(exec_time_end, time_queued), TIMESTAMP '{QUEUE_NOW}') > 5)) x
    WHERE rn <= 3""", extra=[_QUEUE_CTE]))
def q_queue_next(spark, sf_dir):
    return queue_next(_queue(spark, sf_dir), QUEUE_NOW, n=3)


@register("queue_update", oracle=with_fixtures("""
    SELECT q.queue_item_id, q.sql_instance, q.time_queued,
      CASE WHEN r.res IS NULL THEN q.exec_status WHEN r.res <> 'ERROR' THEN r.res
           WHEN q.retry_count + 1 >= 5 THEN 'FAILED' ELSE 'RETRYING' END AS exec_status,
      CASE WHEN r.res = 'ERROR' THEN q.retry_count + 1 ELSE q.retry_count END AS retry_count,
      COALESCE(r.t_end, q.exec_time_end) AS exec_time_end
    FROM q LEFT JOIN (SELECT o_orderkey AS queue_item_id,
                             CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'ERROR' ELSE 'OK' END AS res,
                             o_orderdate + INTERVAL 1 DAY AS t_end
                      FROM orders WHERE o_totalprice > 200000) r USING (queue_item_id)""", extra=[_QUEUE_CTE]))
def q_queue_update(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    res = o.filter(F.col("o_totalprice") > 200000).select(
        F.col("o_orderkey").alias("queue_item_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "ERROR").otherwise("OK").alias("exec_status"),
        F.timestamp_add("DAY", F.lit(1), F.col("o_orderdate")).alias("exec_time_end"))
    return queue_update(_queue(spark, sf_dir), res)


@register("queue_retention", oracle=with_fixtures(f"""
    SELECT * FROM q WHERE NOT (time_queued < CASE WHEN exec_status <> 'FAILED'
                                                  THEN TIMESTAMP '{QUEUE_NOW}' - INTERVAL 400 DAY
                                                  ELSE TIMESTAMP '{QUEUE_NOW}' - INTERVAL 900 DAY END)""",
    extra=[_QUEUE_CTE]))
def q_queue_retention(spark, sf_dir):
    return retention.queue_retention(_queue(spark, sf_dir), QUEUE_NOW, ok_days=400, failed_days=900)
