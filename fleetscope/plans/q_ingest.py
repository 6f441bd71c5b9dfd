"""Queries: ingest operators -- error-log keywords, session filter, fleet import
(header watermark, fact delta, changed dimensions), windowed extracts,
histogram ingest, blocked-process reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..sources import fixtures as fx
from ..sources import ingest as ing
from ..sources.tables import read_table, table_path
from .config import Relation
from .fixture_sql import with_fixtures
from .registry import register

T = "snapshot_time"
IMPORT_CUTOFF = "2024-01-20 00:00:00"
HEADER_LIMIT = "2024-01-28 00:00:00"

KEYWORDS = Relation("keyword_id int, keyword1 string, keyword2 string, log_type_id int",
                    [(1, "le", None, 1), (2, "the", "and", 2), (3, "eau", "ou", 1), (4, "LA", None, 3)])
SEEN_LOG = Relation("keyword_id int, log_type_id int, log_date timestamp_ntz",
                    [(1, 1, None), (2, 2, None)])

_LINES_SQL = """SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS log_date,
                       CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS log_type_id,
                       role AS attribute_value, text FROM conversations"""


def _lines(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.select(F.timestamp_add("MINUTE", F.col("turn"), F.timestamp_add(
                        "HOUR", F.col("conv_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))).alias("log_date"),
                    F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
                    .alias("log_type_id"),
                    F.col("role").alias("attribute_value"), "text")


@register("errorlog_ingest", oracle=f"""
    SELECT l.log_date, l.log_type_id, l.attribute_value,
           regexp_replace(trim(l.text), '[\\r\\n]', '', 'g') AS text, k.keyword_id
    FROM ({_LINES_SQL}) l JOIN ({KEYWORDS.sql()}) k
      ON l.log_type_id = k.log_type_id AND strpos(lower(l.text), lower(k.keyword1)) > 0
     AND (k.keyword2 IS NULL OR strpos(lower(l.text), lower(k.keyword2)) > 0)
    WHERE l.log_date > COALESCE((SELECT MAX(w.log_date) FROM (
        SELECT x.log_date, y.keyword_id, x.log_type_id FROM ({_LINES_SQL}) x
        JOIN ({KEYWORDS.sql()}) y ON x.log_type_id = y.log_type_id
        WHERE x.log_date < TIMESTAMP '2024-01-03 00:00:00') w
      WHERE w.keyword_id = k.keyword_id AND w.log_type_id = l.log_type_id), TIMESTAMP '1900-01-01 00:00:00')""")
def q_errorlog_ingest(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    kw = KEYWORDS.df(spark)
    # lines stored by earlier runs: everything logged before the previous run
    seen = (lines.filter(F.col("log_date") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
            .join(kw.select("keyword_id", "log_type_id"), "log_type_id")
            .select("keyword_id", "log_type_id", "log_date"))
    return ing.errorlog_ingest(lines, kw, seen)


@register("session_samples", oracle="""
    SELECT event_id, user_id AS session_id, CAST(round(value) AS BIGINT) AS duration_seconds,
           CASE WHEN event_type = 'error' THEN user_id % 7 ELSE 0 END AS blocking_session_id,
           event_type = 'signup' AS is_blocking
    FROM events
    WHERE round(value) >= 15 OR (CASE WHEN event_type = 'error' THEN user_id % 7 ELSE 0 END) <> 0
       OR event_type = 'signup'""")
def q_session_samples(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "user_id", "value", "event_type")
    s = e.select("event_id", F.col("user_id").alias("session_id"),
                 F.round("value").cast("bigint").alias("duration_seconds"),
                 F.when(F.col("event_type") == "error", F.col("user_id") % 7).otherwise(F.lit(0))
                 .alias("blocking_session_id"),
                 (F.col("event_type") == "signup").alias("is_blocking"))
    return ing.session_samples(s, 15)


@register("header_watermark", oracle=with_fixtures(f"""
    SELECT r.* FROM fx_header r
    LEFT JOIN (SELECT sql_instance, snapshot_type_id, MAX(snapshot_time) AS hw FROM fx_header
               WHERE snapshot_time < TIMESTAMP '{IMPORT_CUTOFF}' GROUP BY 1, 2) l
      USING (sql_instance, snapshot_type_id)
    WHERE l.hw IS NULL OR r.snapshot_time > l.hw""", "fx_header"))
def q_header_watermark(spark, sf_dir):
    h = fx.fx_header(spark, sf_dir)
    local = h.filter(F.col(T) < F.lit(IMPORT_CUTOFF).cast("timestamp_ntz"))
    return ing.header_watermark(h, local)


@register("import_facts", oracle=with_fixtures(f"""
    SELECT r.* FROM fx_sample r
    JOIN (SELECT sql_instance, MAX(snapshot_time) AS hi FROM fx_header
          WHERE snapshot_time <= TIMESTAMP '{HEADER_LIMIT}' GROUP BY 1) h USING (sql_instance)
    LEFT JOIN (SELECT sql_instance, MAX(snapshot_time) AS lo FROM fx_sample
               WHERE snapshot_time < TIMESTAMP '{IMPORT_CUTOFF}' GROUP BY 1) l USING (sql_instance)
    WHERE (l.lo IS NULL OR r.snapshot_time > l.lo) AND r.snapshot_time <= h.hi
      AND EXISTS (SELECT 1 FROM fx_header x WHERE x.snapshot_time <= TIMESTAMP '{HEADER_LIMIT}'
                  AND x.sql_instance = r.sql_instance AND x.snapshot_type_id = r.snapshot_type_id
                  AND x.snapshot_time = r.snapshot_time)
      AND NOT EXISTS (SELECT 1 FROM fx_sample y WHERE y.snapshot_time < TIMESTAMP '{IMPORT_CUTOFF}'
                      AND y.sql_instance = r.sql_instance AND y.instance_name = r.instance_name
                      AND y.snapshot_type_id = r.snapshot_type_id AND y.snapshot_time = r.snapshot_time)""",
    "fx_sample", "fx_header"))
def q_import_facts(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir)
    local = s.filter(F.col(T) < F.lit(IMPORT_CUTOFF).cast("timestamp_ntz"))
    headers = fx.fx_header(spark, sf_dir).filter(F.col(T) <= F.lit(HEADER_LIMIT).cast("timestamp_ntz"))
    return ing.import_facts(s, local, headers, fx.SAMPLE_KEYS + [T])


@register("import_dim", oracle="""
    SELECT r.* FROM (SELECT c_custkey, c_name, c_mktsegment, concat('srv', CAST(c_custkey % 4 AS VARCHAR)) AS sql_instance,
                            TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_nationkey AS BIGINT)) AS date_updated
                     FROM customer) r
    LEFT JOIN (SELECT concat('srv', CAST(c_custkey % 4 AS VARCHAR)) AS sql_instance,
                      MAX(TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c_nationkey AS BIGINT))) AS hw
               FROM customer WHERE c_acctbal < 0 GROUP BY 1) l USING (sql_instance)
    WHERE l.hw IS NULL OR r.date_updated > l.hw""")
def q_import_dim(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")
    r = c.select("c_custkey", "c_name", "c_mktsegment",
                 F.concat(F.lit("srv"), (F.col("c_custkey") % 4).cast("string")).alias("sql_instance"),
                 F.timestamp_add("DAY", F.col("c_nationkey"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
                 .alias("date_updated"), "c_acctbal")
    local = r.filter(F.col("c_acctbal") < 0)
    return ing.import_dim(r.drop("c_acctbal"), local.drop("c_acctbal"), ["c_custkey"], "date_updated")


@register("extract", oracle=with_fixtures("""
    SELECT * FROM fx_check WHERE snapshot_time > TIMESTAMP '2024-01-29 00:00:00'
                             AND snapshot_time <= TIMESTAMP '2024-01-30 12:00:00'""", "fx_check"))
def q_extract(spark, sf_dir):
    return ing.extract(fx.fx_check(spark, sf_dir), T, "2024-01-29 00:00:00", "2024-01-30 12:00:00")


INCLUDE_OBJECTS = Relation("pattern string", [("%BRASS%",), ("STANDARD%",), ("ECONOMY",)])


@register("histogram_ingest", oracle=f"""
    SELECT * FROM (
      SELECT p_type AS object_name, 'size' AS stat, CAST(p_size AS VARCHAR) AS range_hi_key, COUNT(*) AS eq_rows
      FROM part GROUP BY 1, 2, 3
      UNION ALL
      SELECT p_type, 'brand', p_brand, COUNT(*) FROM part GROUP BY 1, 2, 3
      UNION ALL
      SELECT p_type, 'price', CAST(CAST(floor(p_retailprice / 100) AS BIGINT) AS VARCHAR), COUNT(*)
      FROM part GROUP BY 1, 2, 3) u
    WHERE EXISTS (SELECT 1 FROM ({INCLUDE_OBJECTS.sql()}) i WHERE u.object_name LIKE i.pattern)""")
def q_histogram_ingest(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_type", "p_size", "p_brand", "p_retailprice")

    def hist(stat, key):
        return (p.groupBy(F.col("p_type").alias("object_name"), key.alias("range_hi_key"))
                .agg(F.count(F.lit(1)).alias("eq_rows")).withColumn("stat", F.lit(stat))
                .select("object_name", "stat", "range_hi_key", "eq_rows"))

    parts = [hist("size", F.col("p_size")), hist("brand", F.col("p_brand")),
             hist("price", F.floor(F.col("p_retailprice") / 100))]
    return ing.histogram_ingest(parts, INCLUDE_OBJECTS.df(spark))


# --- S2, S3 -------------------------------------------------------------------------------------------------

@register("file_samples", oracle="""
    SELECT l_suppkey AS volume_id, CAST(l_quantity AS DOUBLE) AS used, l_shipdate AS snapshot_time FROM lineitem""")
def q_file_samples(spark, sf_dir):
    """Samples read from files under a declared schema; only its columns are scanned."""
    schema = "l_suppkey bigint, l_quantity double, l_shipdate timestamp_ntz"
    s = ing.read_samples(spark, table_path(sf_dir, "lineitem"), schema)
    return s.select(F.col("l_suppkey").alias("volume_id"), F.col("l_quantity").alias("used"),
                    F.col("l_shipdate").alias("snapshot_time"))


OFFSETS = Relation("session_name string, execution_count bigint, last_event_time timestamp_ntz", [
    ("click", 10, dt.datetime(2024, 1, 5)), ("view", 0, None), ("purchase", 10**9, dt.datetime(2024, 1, 2)),
    ("signup", 5, dt.datetime(2024, 1, 30, 23, 59, 50)),
])
OFFSETS_NOW = "2024-01-31 00:00:00"
_NEW_EVENTS = f"""SELECT e.event_id, e.event_type AS session_name, e.ts AS event_time
    FROM events e JOIN ({OFFSETS.sql()}) o ON o.session_name = e.event_type
    JOIN (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) c ON c.event_type = e.event_type
    WHERE c.n > o.execution_count AND e.ts > COALESCE(o.last_event_time, TIMESTAMP '1970-01-01 00:00:00')
      AND date_diff('second', COALESCE(o.last_event_time, TIMESTAMP '1970-01-01 00:00:00'), TIMESTAMP '{OFFSETS_NOW}') >= 15"""


def _sessions(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "ts")
    e = e.select("event_id", F.col("event_type").alias("session_name"), F.col("ts").cast("timestamp_ntz").alias("event_time"))
    return e, e.groupBy("session_name").agg(F.count(F.lit(1)).alias("execution_count"))


@register("new_events", oracle=_NEW_EVENTS)
def q_new_events(spark, sf_dir):
    """Four sessions: behind, never read, not fired since, read ten seconds ago."""
    e, current = _sessions(spark, sf_dir)
    return ing.new_events(e, OFFSETS.df(spark), current, OFFSETS_NOW, min_interval_s=15)


@register("event_offsets", oracle=f"""
    SELECT o.session_name, COALESCE(c.n, o.execution_count) AS execution_count, COALESCE(x.last, o.last_event_time) AS last_event_time
    FROM ({OFFSETS.sql()}) o
    LEFT JOIN (SELECT session_name, MAX(event_time) AS last FROM ({_NEW_EVENTS}) n GROUP BY 1) x USING (session_name)
    LEFT JOIN (SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1) c ON c.event_type = x.session_name""")
def q_event_offsets(spark, sf_dir):
    e, current = _sessions(spark, sf_dir)
    stored = OFFSETS.df(spark)
    read = ing.new_events(e, stored, current, OFFSETS_NOW, min_interval_s=15)
    return ing.advance_offsets(stored, current, read, OFFSETS_NOW)
