"""Queries: the shipped checks that look at single objects and at raw counters.

``shipped_checks`` (q_catalog) covers cooked counters, derived rates, queues, disks and blocking; here are database
settings, jobs and backups (expanded per database or job) and the counters that the catalogue averages as they come.
Values are exact means in 1e-5 units.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators.aggregates import avg_of_sums, backup_age, ratio_of_avgs
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .config import Relation
from .fixture_sql import with_fixtures
from .q_catalog import CATALOGUE, _mean_sql
from .q_checks import status_sql
from .registry import register

NOW = "2001-08-02 00:00:00"
JOBS_SINCE = "2000-01-01 00:00:00"
COUNTERS_SINCE = "2024-01-20 00:00:00"
CHECK_TIME = "2024-01-31 00:00:00"
PREVIOUS_SINCE = "2024-01-10 00:00:00"

# Setting of a database -> its check and the value it has on every n-th database (and on the others).
SETTINGS = [
    ("Database {DATABASE} AUTO_CLOSE", 20, 1, 0), ("Database {DATABASE} PAGE_VERIFY", 9, 1, 2),
    ("Database {DATABASE} AUTO_SHRINK", 15, 1, 0), ("Database {DATABASE} STATE", 31, 6, 0),
    ("Database {DATABASE} USER ACCESS", 25, 1, 0),
]

# Counters of the derived fleet that the catalogue averages: place in the event number -> counter.
COUNTERS = Relation("k int, check_template string", [
    (0, "Free list stalls/sec"), (1, "Lazy writes/sec"), (2, "Page reads/sec"), (3, "Page writes/sec"),
    (4, "Lock Requests/sec"), (5, "Lock Timeouts/sec"), (6, "Lock Waits/sec"), (7, "Number of Deadlocks/sec"),
    (8, "Memory Grants Outstanding"), (9, "Memory Grants Pending"), (10, "Page life expectancy"), (11, "Logins/sec"),
    (12, "Errors/sec"), (13, "Page Split Rate"), (14, "Page Lookups Rate"), (15, "Readahead pages/sec"),
    (16, "Log Growths"), (17, "dbachecks failed"), (18, "CPU Utilistaion"),
])
N_COUNTERS = len(COUNTERS.rows)
SPECIAL = ("Readahead pages/sec", "Log Growths", "dbachecks failed", "CPU Utilistaion")


def _named(template, name):
    return F.replace(F.replace(template, F.lit("{DATABASE}"), name), F.lit("{Database}"), name)


def _status_of(body: str) -> str:
    return f"""SELECT v.sql_instance, v.check_template, v.check_name, v.check_value, c.check_threshold_warning,
           c.check_threshold_critical,
           {status_sql('v.check_value', 'c.check_threshold_critical', 'c.check_threshold_warning')} AS check_status
    FROM ({body}) v JOIN ({CATALOGUE.sql()}) c ON c.check_name = v.check_template"""


_DB = "'db' || CAST(c_custkey AS VARCHAR)"
_INST = "'srv' || CAST(c_nationkey AS VARCHAR)"
_SETTINGS_SQL = "\n      UNION ALL\n".join(
    f"""SELECT {_INST} AS sql_instance, '{t}' AS check_template, replace('{t}', '{{DATABASE}}', {_DB}) AS check_name,
               CAST(CASE WHEN c_custkey % {n} = 0 THEN {a} ELSE {b} END AS DECIMAL(28,5)) AS check_value FROM customer"""
    for t, n, a, b in SETTINGS)
_BACKUP_SQL = """SELECT o_custkey, MAX(o_orderdate) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS data_at,
             MAX(o_orderdate) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS log_at
      FROM orders GROUP BY o_custkey"""


@register("shipped_object_checks", oracle=_status_of(f"""
      {_SETTINGS_SQL}
      UNION ALL
      SELECT {_INST}, 'Job {{JOB}} failure count', 'Job job' || CAST(c_custkey AS VARCHAR) || ' failure count',
             CAST((SELECT COUNT(DISTINCT o_custkey) FROM orders o WHERE o.o_custkey = c.c_custkey
                   AND o.o_orderstatus = 'F' AND o.o_orderdate > TIMESTAMP '{JOBS_SINCE}') AS DECIMAL(28,5))
      FROM customer c
      UNION ALL
      SELECT {_INST}, 'Database {{Database}} Log Backup Age', 'Database ' || {_DB} || ' Log Backup Age',
             CAST(COALESCE(date_diff('minute', b.log_at, TIMESTAMP '{NOW}'), 9999) AS DECIMAL(28,5))
      FROM customer LEFT JOIN ({_BACKUP_SQL}) b ON b.o_custkey = c_custkey
      UNION ALL
      SELECT {_INST}, 'Database {{Database}} Data Backup Age', 'Database ' || {_DB} || ' Data Backup Age',
             CAST(COALESCE(date_diff('day', b.data_at, TIMESTAMP '{NOW}'), 9999) AS DECIMAL(28,5))
      FROM customer LEFT JOIN ({_BACKUP_SQL}) b ON b.o_custkey = c_custkey"""))
def q_shipped_object_checks(spark, sf_dir):
    """Checks expanded per database and job: five settings, failed jobs, two backup ages."""
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    inst = F.concat(F.lit("srv"), F.col("c_nationkey").cast("string"))
    name = F.concat(F.lit("db"), F.col("c_custkey").cast("string"))
    failed = (orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") > F.lit(JOBS_SINCE).cast("timestamp_ntz")))
              .select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("_failed")).distinct())
    backups = orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("backup_finish_date"),
                            F.when(F.col("o_orderpriority") == "1-URGENT", "D")
                             .when(F.col("o_orderpriority") == "2-HIGH", "I").otherwise("L").alias("type"))
    ages = backup_age(cust, backups, NOW, key="c_custkey")
    one = cust.join(failed, "c_custkey", "left").join(ages, "c_custkey")
    # one row per database with all of its values, then one row per check: no scan is repeated
    values = [F.struct(F.lit(t).alias("t"), F.when(F.col("c_custkey") % n == 0, a).otherwise(b).cast("bigint").alias("v"))
              for t, n, a, b in SETTINGS]
    values += [F.struct(F.lit(t).alias("t"), v.cast("bigint").alias("v")) for t, v in (
        ("Job {JOB} failure count", F.coalesce("_failed", F.lit(0))),
        ("Database {Database} Log Backup Age", F.col("log_backup_age_minutes")),
        ("Database {Database} Data Backup Age", F.col("data_backup_age_days")))]
    rows = one.select(inst.alias("sql_instance"), name.alias("_db"), F.explode(F.array(*values)).alias("_c"))
    job = F.replace("_db", F.lit("db"), F.lit("job"))
    check = F.replace(_named(F.col("_c.t"), F.col("_db")), F.lit("{JOB}"), job)
    out = rows.select("sql_instance", F.col("_c.t").alias("check_template"), check.alias("check_name"),
                      F.col("_c.v").cast("decimal(28,5)").alias("check_value"))
    return ck.evaluate_checks(out, CATALOGUE.df(spark))


_RAW_SQL = f"""SELECT e.sql_instance, e.snapshot_time, n.check_template, e.value, e.event_id
    FROM fx_ev e JOIN ({COUNTERS.sql()}) n ON n.k = CAST((e.event_id // 7) % {N_COUNTERS} AS INTEGER)"""
_SINCE = f"snapshot_time > TIMESTAMP '{COUNTERS_SINCE}'"
_BEFORE = f"snapshot_time > TIMESTAMP '{PREVIOUS_SINCE}' AND snapshot_time <= TIMESTAMP '{COUNTERS_SINCE}'"
_ROUNDED = "CAST(round({v}, 5) AS DECIMAL(28,5))"


@register("shipped_counter_checks", oracle=with_fixtures(f"""
    SELECT v.sql_instance, v.check_template, v.check_name, v.check_value, v.check_threshold_warning,
           v.check_threshold_critical,
           {status_sql('v.check_value', 'v.check_threshold_critical', 'v.check_threshold_warning')} AS check_status
    FROM (
      SELECT m.sql_instance, m.check_template, m.check_template AS check_name, m.check_value, c.check_threshold_warning,
             CASE WHEN contains(c.check_threshold_critical, '{{LAST_CHECK_VALUE}}') AND m.before IS NOT NULL
                  THEN replace(c.check_threshold_critical, '{{LAST_CHECK_VALUE}}', CAST(m.before AS VARCHAR))
                  ELSE c.check_threshold_critical END AS check_threshold_critical
      FROM (
        SELECT now.*, old.check_value AS before FROM (
          SELECT sql_instance, check_template, {_mean_sql('value')} AS check_value FROM raw
          WHERE {_SINCE} AND check_template NOT IN ('Readahead pages/sec', 'CPU Utilistaion', 'dbachecks failed')
          GROUP BY 1, 2) now
        LEFT JOIN (SELECT sql_instance, check_template, {_mean_sql('value')} AS check_value FROM raw
                   WHERE {_BEFORE} AND check_template = 'Log Growths' GROUP BY 1, 2) old USING (sql_instance, check_template)
        UNION ALL
        SELECT sql_instance, 'Readahead pages/sec', CAST(round(CASE WHEN d > 0 THEN n / d ELSE 0 END, 5) AS DECIMAL(28,5)), NULL
        FROM (SELECT sql_instance, AVG(value) FILTER (WHERE check_template = 'Readahead pages/sec') AS n,
                     AVG(value) FILTER (WHERE check_template = 'Page reads/sec') AS d
              FROM raw WHERE {_SINCE} AND check_template IN ('Readahead pages/sec', 'Page reads/sec') GROUP BY 1) r
        UNION ALL
        SELECT sql_instance, 'CPU Utilistaion', CAST(round(AVG(s), 5) AS DECIMAL(28,5)), NULL
        FROM (SELECT sql_instance, snapshot_time, SUM(round(value)) AS s FROM raw
              WHERE {_SINCE} AND check_template = 'CPU Utilistaion' GROUP BY 1, 2) x GROUP BY 1
        UNION ALL
        SELECT sql_instance, 'dbachecks failed', CAST(COUNT(*) FILTER (WHERE value > 100) AS DECIMAL(28,5)), NULL
        FROM raw WHERE {_SINCE} AND check_template = 'dbachecks failed' GROUP BY 1
      ) m JOIN ({CATALOGUE.sql()}) c ON c.check_name = m.check_template
    ) v""", "fx_ev", extra=[("raw", _RAW_SQL)]))
def q_shipped_counter_checks(spark, sf_dir):
    """Counter checks of the catalogue: means, the read-ahead ratio, CPU as a mean of sums, log growths against the
    previous value, external check results."""
    from ..operators.joins import broadcast_if_small

    ev = fx.fx_ev(spark, sf_dir).withColumn("k", (F.floor(F.col("event_id") / 7) % N_COUNTERS).cast("int"))
    raw = ev.join(broadcast_if_small(COUNTERS.df(spark)), "k").select("sql_instance", "snapshot_time", "check_template", "value")
    since = F.col("snapshot_time") > F.lit(COUNTERS_SINCE).cast("timestamp_ntz")
    now = raw.filter(since)
    total, count = ck.exact_mean("value")

    def mean(rows):
        g = rows.groupBy("sql_instance", "check_template").agg(total.alias("_s"), count.alias("_n"))
        return g.select("sql_instance", "check_template", ck.exact_mean_value("_s", "_n").alias("check_value"))

    def value(frame, template, v):
        return frame.select("sql_instance", F.lit(template).alias("check_template"),
                            F.round(v, 5).cast("decimal(28,5)").alias("check_value"))

    means = mean(now.filter(~F.col("check_template").isin("Readahead pages/sec", "CPU Utilistaion", "dbachecks failed")))
    name = F.col("check_template")
    ahead = ratio_of_avgs(now.filter(name.isin("Readahead pages/sec", "Page reads/sec")), ["sql_instance"], "value",
                          name == "Readahead pages/sec", name == "Page reads/sec")
    cpu = avg_of_sums(now.filter(name == "CPU Utilistaion").withColumn("value", F.round("value")), ["sql_instance"],
                      ["sql_instance", "snapshot_time"], "value")
    failed = now.filter(name == "dbachecks failed").groupBy("sql_instance").agg(F.count_if(F.col("value") > 100).alias("n"))
    values = (means.unionByName(value(ahead, "Readahead pages/sec", F.coalesce("ratio", F.lit(0.0))))
              .unionByName(value(cpu, "CPU Utilistaion", F.col("avg_of_sums")))
              .unionByName(value(failed, "dbachecks failed", F.col("n").cast("double"))))
    old = raw.filter(~since & (F.col("snapshot_time") > F.lit(PREVIOUS_SINCE).cast("timestamp_ntz")) & (name == "Log Growths"))
    history = (mean(old).withColumn("snapshot_time", F.lit(COUNTERS_SINCE).cast("timestamp_ntz")).withColumn("_now", F.lit(False))
               .unionByName(values.withColumn("snapshot_time", F.lit(CHECK_TIME).cast("timestamp_ntz"))
                            .withColumn("_now", F.lit(True))))
    cat = broadcast_if_small(CATALOGUE.df(spark).withColumnRenamed("check_name", "check_template"))
    history = history.join(cat, "check_template")
    out = ck.dynamic_threshold(history, ["sql_instance", "check_template"]).filter("_now")
    out = ck.check_status(out)
    return out.select("sql_instance", "check_template", name.alias("check_name"), "check_value",
                      "check_threshold_warning", "check_threshold_critical", "check_status")
