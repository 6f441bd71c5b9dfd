"""Queries: check statuses, dynamic thresholds, status changes, flapping, status runs,
due checks, baselines, check values, execution statistics and check aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators.joins import broadcast_if_small
from ..sources import fixtures as fx
from .config import Relation
from .fixture_sql import with_fixtures
from .registry import register
from .sqlbits import NOW, NOW_PY

T = "snapshot_time"
KEYS = ["sql_instance", "check_id"]

CHECK_CONFIG = Relation(
    "check_id int, check_name string, check_threshold_warning string, check_threshold_critical string, "
    "check_frequency_minutes int, ignore_flapping boolean, use_baseline boolean",
    [
        (1, "Counter value 1", ">50", ">80", 5, False, True),
        (2, "Counter value 2", ">=40", ">=75.5", 15, False, False),
        (3, "Counter value 3", "<30", "<=10", 60, True, True),
        (4, "Counter value 4", "<>60", "=0", 1440, False, False),
        (5, "Counter value 5", "60", ">{LAST_CHECK_VALUE}", 5, False, False),
    ],
)

BASELINES = Relation(
    "baseline_id int, sql_instance string, baseline_start timestamp_ntz, baseline_end timestamp_ntz, is_default boolean",
    [
        (1, "srv0", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 7, 23, 0), True),
        (2, "srv1", dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 14, 23, 0), True),
        (3, "srv2", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3), True),
        (4, "srv2", dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 21), False),
        (5, "srv3", dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 15, 12, 0), True),
    ],
)


def _cfg_sql():
    return ("cfg", CHECK_CONFIG.sql())


# --- SQL mirrors of the threshold functions (oracle side) --------------------------------------------

def cmp_sql(t: str) -> str:
    return f"nullif(regexp_extract({t}, '^(<=|>=|<>|<|>|=)', 1), '')"


def tv_sql(t: str) -> str:
    return f"TRY_CAST(replace({t}, {cmp_sql(t)}, '') AS DECIMAL(28,5))"


def match_sql(v: str, t: str, variance: int = 1) -> str:
    up = f"CAST({1 + variance / 100:.2f} AS DECIMAL(10,2))"
    dn = f"CAST({1 - variance / 100:.2f} AS DECIMAL(10,2))"
    vv = f"CAST({v} AS DECIMAL(28,5))"
    tv = tv_sql(t)
    return (f"COALESCE(CASE {cmp_sql(t)} WHEN '<=' THEN {vv} <= {tv} * {dn} WHEN '>=' THEN {vv} >= {tv} * {up} "
            f"WHEN '<>' THEN {vv} <> {tv} WHEN '<' THEN {vv} < {tv} * {dn} WHEN '>' THEN {vv} > {tv} * {up} "
            f"WHEN '=' THEN {vv} = {tv} ELSE {vv} = {tv} END, FALSE)")


def status_sql(v: str, crit: str, warn: str) -> str:
    return (f"CASE WHEN {v} IS NULL THEN 'CHECK ERROR' "
            f"WHEN COALESCE(contains({crit}, '{{LAST_CHECK_VALUE}}'), FALSE) "
            f"  OR COALESCE(contains({warn}, '{{LAST_CHECK_VALUE}}'), FALSE) THEN 'OK' "
            f"WHEN {match_sql(v, crit)} THEN 'CRITICAL' WHEN {match_sql(v, warn)} THEN 'WARNING' ELSE 'OK' END")


_DYN_CTE = ("dyn", """
    SELECT c.sql_instance, c.check_id, c.snapshot_time, c.check_value,
      CASE WHEN contains(g.check_threshold_warning, '{LAST_CHECK_VALUE}') AND c.prev_value IS NOT NULL
           THEN replace(g.check_threshold_warning, '{LAST_CHECK_VALUE}', CAST(CAST(c.prev_value AS DECIMAL(28,5)) AS VARCHAR))
           ELSE g.check_threshold_warning END AS check_threshold_warning,
      CASE WHEN contains(g.check_threshold_critical, '{LAST_CHECK_VALUE}') AND c.prev_value IS NOT NULL
           THEN replace(g.check_threshold_critical, '{LAST_CHECK_VALUE}', CAST(CAST(c.prev_value AS DECIMAL(28,5)) AS VARCHAR))
           ELSE g.check_threshold_critical END AS check_threshold_critical
    FROM (SELECT sql_instance, check_id, snapshot_time, check_value,
                 lag(check_value) OVER (PARTITION BY sql_instance, check_id ORDER BY snapshot_time) AS prev_value
          FROM fx_check) c JOIN cfg g USING (check_id)""")

_STATUS_CTE = ("st", f"""SELECT *, {status_sql('check_value', 'check_threshold_critical', 'check_threshold_warning')}
                         AS check_status FROM dyn""")


def _history(spark, sf_dir):
    """fx_check with configured thresholds, dynamic thresholds resolved and statuses evaluated."""
    c = fx.fx_check(spark, sf_dir).select(*KEYS, T, "check_value")
    cfg = broadcast_if_small(CHECK_CONFIG.df(spark).select("check_id", "check_threshold_warning",
                                                           "check_threshold_critical"))
    d = ck.dynamic_threshold(c.join(cfg, "check_id"), KEYS, T, "check_value")
    return ck.check_status(d)


@register("dynamic_threshold", oracle=with_fixtures("SELECT * FROM dyn", "fx_check",
                                                    extra=[_cfg_sql(), _DYN_CTE]))
def q_dynamic_threshold(spark, sf_dir):
    return _history(spark, sf_dir).drop("check_status")


@register("check_status", headline=True, oracle=with_fixtures("SELECT * FROM st", "fx_check",
                                                              extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE]))
def q_check_status(spark, sf_dir):
    return _history(spark, sf_dir)


_CHG_CTE = ("chg", """SELECT sql_instance, check_id, snapshot_time, check_value, check_status,
                      CASE WHEN COALESCE(check_status, '') <> COALESCE(lag(check_status) OVER
                           (PARTITION BY sql_instance, check_id ORDER BY snapshot_time), '') THEN 1 ELSE 0 END
                           AS status_change
                      FROM st""")


def _changes(spark, sf_dir):
    h = _history(spark, sf_dir).select(*KEYS, T, "check_value", "check_status")
    return ck.status_change(h, KEYS, T, "check_status")


@register("status_change", oracle=with_fixtures("SELECT * FROM chg", "fx_check",
                                                extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _CHG_CTE]))
def q_status_change(spark, sf_dir):
    return _changes(spark, sf_dir)


@register("flapping", oracle=with_fixtures("""
    SELECT c.sql_instance, c.check_id, c.snapshot_time, c.check_value, c.check_status, c.status_change,
           f.ratio AS change_ratio,
           COALESCE(f.ratio BETWEEN 0.35 AND 0.65, FALSE) AND NOT g.ignore_flapping AS is_flapping
    FROM chg c JOIN cfg g USING (check_id)
    LEFT JOIN (
      SELECT a.sql_instance, a.check_id, a.snapshot_time, AVG(CAST(b.status_change AS DOUBLE)) AS ratio
      FROM (SELECT *, row_number() OVER (PARTITION BY sql_instance, check_id ORDER BY snapshot_time) AS rn FROM chg) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY sql_instance, check_id ORDER BY snapshot_time) AS rn FROM chg) b
        ON a.sql_instance = b.sql_instance AND a.check_id = b.check_id
       AND b.rn BETWEEN a.rn - 12 AND a.rn - 1 AND b.snapshot_time > a.snapshot_time - INTERVAL 6 HOUR
      GROUP BY a.sql_instance, a.check_id, a.snapshot_time) f
      ON f.sql_instance = c.sql_instance AND f.check_id = c.check_id AND f.snapshot_time = c.snapshot_time""",
    "fx_check", extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _CHG_CTE]))
def q_flapping(spark, sf_dir):
    ch = _changes(spark, sf_dir).join(broadcast_if_small(CHECK_CONFIG.df(spark).select("check_id", "ignore_flapping")),
                                      "check_id")
    return ck.flapping(ch, KEYS, T, ignore_col="ignore_flapping").drop("ignore_flapping")


@register("flapping_three_days", oracle=with_fixtures("""
    SELECT c.sql_instance, c.check_id, c.snapshot_time, f.ratio AS change_ratio,
           COALESCE(f.ratio BETWEEN 0.35 AND 0.65, FALSE) AS is_flapping
    FROM chg c
    LEFT JOIN (
      SELECT a.sql_instance, a.check_id, a.snapshot_time, AVG(CAST(b.status_change AS DOUBLE)) AS ratio
      FROM (SELECT *, row_number() OVER (PARTITION BY sql_instance, check_id ORDER BY snapshot_time) AS rn FROM chg) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY sql_instance, check_id ORDER BY snapshot_time) AS rn FROM chg) b
        ON a.sql_instance = b.sql_instance AND a.check_id = b.check_id
       AND b.rn BETWEEN a.rn - 12 AND a.rn - 1 AND b.snapshot_time > a.snapshot_time - INTERVAL 72 HOUR
      GROUP BY a.sql_instance, a.check_id, a.snapshot_time) f
      ON f.sql_instance = c.sql_instance AND f.check_id = c.check_id AND f.snapshot_time = c.snapshot_time""",
    "fx_check", extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _CHG_CTE]))
def q_flapping_three_days(spark, sf_dir):
    """A look-back longer than the window bucket: rows are carried over empty days."""
    out = ck.flapping(_changes(spark, sf_dir), KEYS, T, hours=72)
    return out.select(*KEYS, T, "change_ratio", "is_flapping")


@register("status_runs", oracle=with_fixtures("""
    SELECT sql_instance, check_id, arg_min(check_status, snapshot_time) AS check_status,
           MIN(snapshot_time) AS status_start_time, MAX(snapshot_time) AS status_end_time,
           COUNT(*) - 1 AS check_count
    FROM (SELECT *, SUM(status_change) OVER (PARTITION BY sql_instance, check_id ORDER BY snapshot_time) AS island
          FROM chg) i
    GROUP BY sql_instance, check_id, island""", "fx_check", extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _CHG_CTE]))
def q_status_runs(spark, sf_dir):
    return ck.status_runs(_changes(spark, sf_dir), KEYS, T)


@register("status_runs_reference", oracle=with_fixtures(f"""
    SELECT s.sql_instance, s.check_id, s.check_status, s.snapshot_time AS status_start_time,
           COALESCE(MAX(z.snapshot_time), {NOW}) AS status_end_time, COUNT(z.snapshot_time) AS check_count
    FROM chg s LEFT JOIN chg z ON z.sql_instance = s.sql_instance AND z.check_id = s.check_id
                              AND z.snapshot_time > s.snapshot_time AND z.status_change = 0
    WHERE s.status_change = 1
    GROUP BY s.sql_instance, s.check_id, s.check_status, s.snapshot_time""",
    "fx_check", extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _CHG_CTE]))
def q_status_runs_reference(spark, sf_dir):
    return ck.status_runs(_changes(spark, sf_dir), KEYS, T, mode="reference", now=NOW_PY)


# --- L7 due checks ----------------------------------------------------------------------------------

_META_CTE = ("meta", """SELECT sql_instance, check_id, MAX(snapshot_time) AS last_check_date,
                        arg_max(check_status, snapshot_time) AS last_check_status FROM st
                        GROUP BY sql_instance, check_id""")


@register("due_checks", oracle=with_fixtures(f"""
    SELECT m.sql_instance, m.check_id, m.last_check_date, m.last_check_status, g.check_frequency_minutes
    FROM meta m JOIN cfg g USING (check_id)
    WHERE date_diff('minute', COALESCE(m.last_check_date, TIMESTAMP '1970-01-01 00:00:00'),
                    {NOW}) >=
          CASE WHEN m.last_check_status = 'CHECK ERROR' AND COALESCE(g.check_frequency_minutes, 0) > 60 THEN 60
               ELSE COALESCE(g.check_frequency_minutes, 0) END""",
    "fx_check", extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _META_CTE]))
def q_due_checks(spark, sf_dir):
    h = _history(spark, sf_dir)
    meta = h.groupBy(*KEYS).agg(F.max(T).alias("last_check_date"),
                                F.max_by("check_status", T).alias("last_check_status"))
    m = meta.join(broadcast_if_small(CHECK_CONFIG.df(spark).select("check_id", "check_frequency_minutes")),
                  "check_id")
    return ck.due_checks(m, NOW_PY)


# --- J7 / L5 baselines ------------------------------------------------------------------------------

_MEMBER_CTE = ("mem", f"""SELECT h.sql_instance, h.snapshot_type_id, h.snapshot_time, b.baseline_id, b.baseline_start,
                          b.baseline_end, b.is_default
                          FROM fx_header h JOIN ({BASELINES.sql()}) b ON b.sql_instance = h.sql_instance
                           AND h.snapshot_time BETWEEN b.baseline_start AND b.baseline_end""")


@register("baseline_membership", oracle=with_fixtures("SELECT * FROM mem", "fx_header", extra=[_MEMBER_CTE]))
def q_baseline_membership(spark, sf_dir):
    return ck.baseline_membership(fx.fx_header(spark, sf_dir), BASELINES.df(spark))


_BCMP = cmp_sql("s.check_threshold_critical")
_BTHR = f"concat(COALESCE({_BCMP}, ''), CAST(b.check_baseline AS VARCHAR))"
_BASELINE_SQL = f"""
    SELECT s.*, b.check_baseline,
      CASE WHEN b.check_baseline IS NOT NULL THEN {_BTHR} END AS baseline_threshold,
      CASE WHEN b.check_baseline IS NULL THEN NULL
           WHEN NOT {match_sql('s.check_value', _BTHR, 20)}
             OR NOT {match_sql('s.check_value', 's.check_threshold_critical', 10)} THEN 'OK'
           ELSE 'CRITICAL' END AS baseline_status
    FROM st s LEFT JOIN (
      SELECT sql_instance, check_id,
             CAST(CAST(floor((2 * s + n) / (2 * n)) AS DECIMAL(28,0)) * CAST(0.00001 AS DECIMAL(6,5))
                  AS DECIMAL(28,5)) AS check_baseline
      FROM (SELECT c.sql_instance, c.check_id, SUM(CAST(round(c.check_value * 100000) AS BIGINT)) AS s,
                   COUNT(*) AS n
            FROM fx_check c WHERE EXISTS (SELECT 1 FROM mem m WHERE m.is_default AND m.sql_instance = c.sql_instance
                                          AND m.snapshot_time = c.snapshot_time)
            GROUP BY c.sql_instance, c.check_id) a) b USING (sql_instance, check_id)"""


@register("baseline_status", oracle=with_fixtures(_BASELINE_SQL, "fx_check", "fx_header",
                                                  extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _MEMBER_CTE]))
def q_baseline_status(spark, sf_dir):
    h = _history(spark, sf_dir)
    mem = ck.baseline_membership(fx.fx_header(spark, sf_dir), BASELINES.df(spark))
    base = ck.baseline_values(fx.fx_check(spark, sf_dir), mem, KEYS, T)
    return ck.baseline_status(h, base, KEYS)


@register("baseline_status_strict", oracle=with_fixtures(f"""
    SELECT s.sql_instance, s.check_id, s.snapshot_time, s.check_value, b.check_baseline,
           CASE WHEN b.check_baseline IS NULL THEN NULL
                WHEN {match_sql('s.check_value', _BTHR, 1)} THEN 'CRITICAL' ELSE 'OK' END AS baseline_status
    FROM st s LEFT JOIN (
      SELECT sql_instance, check_id, CAST(round(AVG(CAST(round(check_value, 5) AS DECIMAL(28,5))), 5) AS DECIMAL(28,5)) AS check_baseline
      FROM fx_check c WHERE EXISTS (SELECT 1 FROM mem m WHERE m.is_default AND m.sql_instance = c.sql_instance
                                    AND m.snapshot_time = c.snapshot_time)
      GROUP BY sql_instance, check_id) b USING (sql_instance, check_id)""", "fx_check", "fx_header",
                                                         extra=[_cfg_sql(), _DYN_CTE, _STATUS_CTE, _MEMBER_CTE]))
def q_baseline_status_strict(spark, sf_dir):
    """Strict form: CRITICAL as soon as the baseline is exceeded by more than 1 %."""
    h = _history(spark, sf_dir)
    mem = ck.baseline_membership(fx.fx_header(spark, sf_dir), BASELINES.df(spark))
    base = ck.baseline_values(fx.fx_check(spark, sf_dir), mem, KEYS, T)
    out = ck.baseline_status(h, base, KEYS, strict=True)
    return out.select(*KEYS, T, "check_value", "check_baseline", "baseline_status")


# --- L1 check values --------------------------------------------------------------------------------------

CHECK_DEFS = Relation(
    "check_id int, metric string, agg string, window_start timestamp_ntz, window_end timestamp_ntz",
    [
        (101, "db0", "avg", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)),
        (102, "db1", "max", dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)),
        (103, "db2", "sum", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)),
        (104, "db0", "count", dt.datetime(2024, 1, 29), dt.datetime(2024, 1, 31)),
        (105, "db2", "min", dt.datetime(2023, 12, 1), dt.datetime(2024, 2, 1)),
    ],
)


@register("check_values", oracle=with_fixtures(f"""
    SELECT c.check_id, m.sql_instance,
      CAST(CASE c.agg WHEN 'avg' THEN AVG(m.inc) WHEN 'min' THEN MIN(m.inc) WHEN 'max' THEN MAX(m.inc)
                      WHEN 'sum' THEN SUM(m.inc) WHEN 'count' THEN COUNT(m.inc) END AS DOUBLE) AS check_value
    FROM fx_inc m JOIN ({CHECK_DEFS.sql()}) c ON m.instance_name = c.metric
     AND m.snapshot_time > c.window_start AND m.snapshot_time <= c.window_end
    GROUP BY c.check_id, m.sql_instance, c.agg""", "fx_inc"))
def q_check_values(spark, sf_dir):
    m = fx.fx_inc(spark, sf_dir).select("sql_instance", F.col("instance_name").alias("metric"), T,
                                        F.col("inc").alias("value"))
    return ck.check_values(m, CHECK_DEFS.df(spark))


# --- L17 / A1 -----------------------------------------------------------------------------------------------

@register("check_exec_stats", oracle=with_fixtures("""
    SELECT g.check_id, g.check_name, s.min_exec_ms, s.max_exec_ms, s.avg_exec_ms, s.check_count, s.last_check_time
    FROM cfg g LEFT JOIN (SELECT check_id, MIN(n) AS min_exec_ms, MAX(n) AS max_exec_ms, AVG(n) AS avg_exec_ms,
                                 COUNT(*) AS check_count, MAX(snapshot_time) AS last_check_time
                          FROM fx_check GROUP BY check_id) s USING (check_id)""", "fx_check", extra=[_cfg_sql()]))
def q_check_exec_stats(spark, sf_dir):
    h = fx.fx_check(spark, sf_dir).withColumnRenamed("n", "check_exec_time_ms")
    cfg = CHECK_CONFIG.df(spark).select("check_id", "check_name")
    return ck.check_exec_stats(h, cfg)


# --- A2 / A10 / A11 ----------------------------------------------------------------------------------------

@register("status_counts", oracle=with_fixtures("""
    SELECT sql_instance, snapshot_time,
           COUNT(*) FILTER (WHERE check_status = 'OK') AS ok_count,
           COUNT(*) FILTER (WHERE check_status = 'WARNING') AS warning_count,
           COUNT(*) FILTER (WHERE check_status = 'CRITICAL') AS critical_count
    FROM fx_check GROUP BY sql_instance, snapshot_time""", "fx_check"))
def q_status_counts(spark, sf_dir):
    from ..operators.aggregates import status_counts

    return status_counts(fx.fx_check(spark, sf_dir), ["sql_instance", T], "check_status",
                         {"ok_count": "OK", "warning_count": "WARNING", "critical_count": "CRITICAL"})


@register("avg_of_sums", oracle=with_fixtures("""
    SELECT sql_instance, AVG(s) AS avg_of_sums FROM (
      SELECT sql_instance, snapshot_time, SUM(inc) AS s FROM fx_inc GROUP BY sql_instance, snapshot_time) x
    GROUP BY sql_instance""", "fx_inc"))
def q_avg_of_sums(spark, sf_dir):
    from ..operators.aggregates import avg_of_sums

    return avg_of_sums(fx.fx_inc(spark, sf_dir), ["sql_instance"], ["sql_instance", T], "inc")


@register("ratio_of_avgs", oracle=with_fixtures("""
    SELECT sql_instance,
      CASE WHEN AVG(CASE WHEN snapshot_type_id = 2 THEN inc END) > 0
           THEN AVG(CASE WHEN snapshot_type_id = 1 THEN inc END) / AVG(CASE WHEN snapshot_type_id = 2 THEN inc END)
           ELSE 0.0 END AS ratio
    FROM fx_inc GROUP BY sql_instance""", "fx_inc"))
def q_ratio_of_avgs(spark, sf_dir):
    from ..operators.aggregates import ratio_of_avgs

    return ratio_of_avgs(fx.fx_inc(spark, sf_dir), ["sql_instance"], "inc",
                         F.col("snapshot_type_id") == 1, F.col("snapshot_type_id") == 2)
