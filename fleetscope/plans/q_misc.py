"""Queries: remaining scalar and dimension helpers -- event timestamps from raw
XML text, plan-handle hex/binary, product versions, message escaping, wait
exclusion flags with key sanitising, synthetic members, report selection,
incomplete-event filter, distinct unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import dims
from ..operators.alerts import select_reports
from ..operators.events import drop_incomplete, event_time_from_text
from ..sources.tables import read_table
from .config import WAIT_VOCABULARY, Relation
from .registry import register


@register("xes_timestamp", oracle="""
    SELECT event_id, ts_text, date_trunc('second', CAST(substr(ts_text, 1, 23) AS TIMESTAMP) + INTERVAL 500 MILLISECOND)
               AS event_time
    FROM (SELECT event_id,
                 substr(xml, strpos(xml, 'timestamp') + 11, 24) AS ts_text
          FROM (SELECT event_id, '<event name="' || event_type || '" package="sqlserver" timestamp="'
                       || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(CAST(date_part('millisecond', ts) % 1000 AS INTEGER)
                       AS VARCHAR), 3, '0') || 'Z"><data name="x"/></event>' AS xml FROM events) e) t""")
def q_xes_timestamp(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "ts")
    x = e.select("event_id", F.concat(F.lit('<event name="'), "event_type", F.lit('" package="sqlserver" timestamp="'),
                                      F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
                                      F.lit('"><data name="x"/></event>')).alias("xml"))
    t = x.select("event_id", sc.xes_timestamp_text("xml").alias("ts_text"))
    return t.withColumn("event_time", event_time_from_text(F.col("ts_text")))


@register("plan_handle_hex", oracle="""
    SELECT event_id, upper(md5(event_type || CAST(user_id AS VARCHAR))) AS plan_handle_text,
           unhex(upper(md5(event_type || CAST(user_id AS VARCHAR)))) AS plan_handle,
           CAST(octet_length(unhex(upper(md5(event_type || CAST(user_id AS VARCHAR))))) AS INTEGER) AS handle_bytes
    FROM events""")
def q_plan_handle_hex(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    t = e.select("event_id", F.upper(F.md5(F.concat("event_type", F.col("user_id").cast("string"))))
                 .alias("plan_handle_text"))
    b = t.withColumn("plan_handle", F.unhex("plan_handle_text"))
    return b.withColumn("handle_bytes", F.octet_length("plan_handle").cast("int"))


_VER_SQL = """CAST(10 + o_orderkey % 7 AS VARCHAR) || '.' || CAST(o_custkey % 3 AS VARCHAR) || '.'
              || CAST(o_orderkey % 5000 AS VARCHAR) || '.' || CAST(o_custkey % 100 AS VARCHAR)"""


@register("version_parse", oracle=f"""
    SELECT o_orderkey, v AS product_version,
           TRY_CAST(substr(v, 1, strpos(v, '.') + 1) AS DECIMAL(10,2)) AS major,
           CASE WHEN len(string_split(v, '.')) <= 4 THEN list_extract(string_split(v, '.'), -2) END AS minor,
           CASE CAST(split_part(v, '.', 1) AS INTEGER) WHEN 11 THEN 2012 WHEN 12 THEN 2014 WHEN 13 THEN 2016
                WHEN 14 THEN 2017 WHEN 15 THEN 2019 ELSE 0 END AS release_year
    FROM (SELECT o_orderkey, {_VER_SQL} AS v FROM orders) o""")
def q_version_parse(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    v = o.select("o_orderkey", F.concat_ws(".", (10 + F.col("o_orderkey") % 7).cast("string"),
                                           (F.col("o_custkey") % 3).cast("string"),
                                           (F.col("o_orderkey") % 5000).cast("string"),
                                           (F.col("o_custkey") % 100).cast("string")).alias("product_version"))
    return v.select("o_orderkey", "product_version", sc.product_version_major("product_version").alias("major"),
                    sc.product_version_minor("product_version").alias("minor"),
                    sc.product_major_year(F.split_part("product_version", F.lit("."), F.lit(1)).cast("int"))
                    .alias("release_year"))


@register("version_union", oracle=f"""
    SELECT {_VER_SQL} AS product_version FROM orders
    UNION
    SELECT CAST(10 + l_orderkey % 7 AS VARCHAR) || '.' || CAST(l_suppkey % 3 AS VARCHAR) || '.'
           || CAST(l_orderkey % 5000 AS VARCHAR) || '.' || CAST(l_suppkey % 100 AS VARCHAR) FROM lineitem""")
def q_version_union(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")

    def ver(k, c):
        return F.concat_ws(".", (10 + F.col(k) % 7).cast("string"), (F.col(c) % 3).cast("string"),
                           (F.col(k) % 5000).cast("string"), (F.col(c) % 100).cast("string")).alias("product_version")

    return o.select(ver("o_orderkey", "o_custkey")).union(li.select(ver("l_orderkey", "l_suppkey"))).distinct()


@register("message_escape", oracle="""
    SELECT p_partkey, exec_type, descr,
           COALESCE(trim(CASE WHEN exec_type = 'T-SQL' THEN replace(descr, '''', '''''')
                              WHEN exec_type = 'PowerShell' THEN replace(descr, '"', '`"') END), '') AS escaped,
           CASE WHEN p_size > 40 THEN NULL ELSE
             'ERROR_NUMBER=' || CAST(p_partkey AS VARCHAR) || chr(10) || 'ERROR_SEVERITY='
             || CAST(p_size % 25 AS VARCHAR) || chr(10) || 'ERROR_STATE=1' || chr(10)
             || 'ERROR_PROCEDURE=''' || p_brand || '''' || chr(10) || 'ERROR_LINE=' || CAST(p_size AS VARCHAR)
             || chr(10) || 'ERROR_MESSAGE=''' || p_type || '''' END
               AS error_detail
    FROM (SELECT p_partkey, p_brand, p_type, p_size,
                 CASE p_size % 3 WHEN 0 THEN 'T-SQL' WHEN 1 THEN 'PowerShell' ELSE 'Email' END AS exec_type,
                 ' ' || p_name || ' "' || p_brand || '" o''' || p_type || ' ' AS descr FROM part) p""")
def q_message_escape(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    d = p.select("p_partkey", "p_brand", "p_type", "p_size",
                 F.when(F.col("p_size") % 3 == 0, "T-SQL").when(F.col("p_size") % 3 == 1, "PowerShell")
                 .otherwise("Email").alias("exec_type"),
                 F.concat(F.lit(" "), "p_name", F.lit(' "'), "p_brand", F.lit("\" o'"), "p_type", F.lit(" "))
                 .alias("descr"))
    return d.select("p_partkey", "exec_type", "descr", sc.escape_for("descr", "exec_type").alias("escaped"),
                    sc.error_detail_text("p_partkey", F.col("p_size") % 25, F.lit(1), "p_brand", "p_size",
                                         F.when(F.col("p_size") <= 40, F.col("p_type"))).alias("error_detail"))


WAIT_EXCLUSIONS = Relation("wait_type string", [(" SLEEP_TASK\r\n",), ("WAITFOR ",), ("\nBROKER_RECEIVE_WAITFOR",),
                                                ("ONDEMAND_TASK_QUEUE",)])


@register("wait_exclusion_flags", oracle=f"""
    SELECT w.wait_type, w.events, x.wait_type IS NOT NULL AS is_excluded
    FROM (SELECT list_extract([{", ".join("'" + v + "'" for v in WAIT_VOCABULARY)}],
                              CAST(event_id % {len(WAIT_VOCABULARY)} AS INTEGER) + 1) AS wait_type, COUNT(*) AS events
          FROM events GROUP BY 1) w
    LEFT JOIN (SELECT DISTINCT trim(regexp_replace(wait_type, '[\\r\\n]', '', 'g')) AS wait_type
               FROM ({WAIT_EXCLUSIONS.sql()}) e) x ON x.wait_type = w.wait_type""")
def q_wait_exclusion_flags(spark, sf_dir):
    from .q_rates import q_wait_category

    dim = q_wait_category(spark, sf_dir).select("wait_type", "events")
    return dims.refresh_exclusion_flag(dim, WAIT_EXCLUSIONS.df(spark), "wait_type")


@register("synthetic_members", oracle="""
    SELECT DISTINCT 'MEMORYCLERK_' || upper(concat('db', CAST(user_id % 3 AS VARCHAR))) AS clerk_name FROM events
    UNION SELECT 'OTHER'""")
def q_synthetic_members(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "user_id")
    d = e.select(F.concat(F.lit("MEMORYCLERK_"), F.upper(F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string"))))
                 .alias("clerk_name")).distinct()
    other = d.sparkSession.createDataFrame([("OTHER",)], "clerk_name string")
    return dims.add_synthetic_members(d, other)


@register("select_reports", oracle="""
    SELECT p_partkey AS report_id, p_name AS report_title, p_size > 10 AS report_active,
           p_retailprice > 950 AS report_enabled, CAST(p_size % 5 AS INTEGER) AS report_batch_id
    FROM part WHERE p_size > 10 AND p_retailprice > 950 AND p_size % 5 = 2 AND p_partkey <> 7""")
def q_select_reports(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_retailprice")
    r = p.select(F.col("p_partkey").alias("report_id"), F.col("p_name").alias("report_title"),
                 (F.col("p_size") > 10).alias("report_active"), (F.col("p_retailprice") > 950).alias("report_enabled"),
                 (F.col("p_size") % 5).cast("int").alias("report_batch_id"))
    return select_reports(r, batch_id=2, triggered_by=7)


@register("drop_incomplete", oracle="""
    SELECT event_id, plan_handle, statement_start_offset, statement_end_offset FROM (
      SELECT event_id,
             CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 17 = 0 THEN unhex('0000000000000000')
                  ELSE unhex(md5(event_type)) END AS plan_handle,
             CAST(event_id % 10 AS INTEGER) AS statement_start_offset,
             CAST(CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 10 + 40 END AS INTEGER) AS statement_end_offset
      FROM events) e
    WHERE plan_handle IS NOT NULL AND plan_handle <> unhex('0000000000000000') AND statement_end_offset IS NOT NULL""")
def q_drop_incomplete(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "event_type")
    d = e.select("event_id",
                 F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("binary"))
                 .when(F.col("event_id") % 17 == 0, F.unhex(F.lit("0000000000000000")))
                 .otherwise(F.unhex(F.md5("event_type"))).alias("plan_handle"),
                 (F.col("event_id") % 10).cast("int").alias("statement_start_offset"),
                 F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.col("event_id") % 10 + 40)
                 .cast("int").alias("statement_end_offset"))
    return drop_incomplete(d)


@register("add_duration", oracle="""
    SELECT event_id, ts AS start_time, CAST(round(value * 1000) AS BIGINT) AS duration_ms,
           ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) AS end_time
    FROM events""")
def q_add_duration(spark, sf_dir):
    from ..functions.timeops import add_duration_ms

    e = read_table(spark, sf_dir, "events", "event_id", "ts", "value")
    d = e.select("event_id", F.col("ts").alias("start_time"),
                 F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"))
    return d.withColumn("end_time", add_duration_ms("start_time", "duration_ms"))


@register("surrogate_keys", oracle="""
    SELECT p.p_brand, p.p_type, COUNT(l.l_partkey) AS facts
    FROM (SELECT DISTINCT p_brand, p_type FROM part) p
    LEFT JOIN (SELECT l_partkey, p_brand, p_type FROM lineitem JOIN part ON p_partkey = l_partkey) l
      ON l.p_brand = p.p_brand AND l.p_type = p.p_type
    GROUP BY p.p_brand, p.p_type""")
def q_surrogate_keys(spark, sf_dir):
    """Facts keyed by a distributed surrogate key of a natural (brand, type) key, counted back per
    natural key: the surrogate is stable across the dimension and the fact side."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    dim = p.select("p_brand", "p_type").distinct().withColumn("type_key", dims.surrogate_key("p_brand", "p_type"))
    li = read_table(spark, sf_dir, "lineitem", "l_partkey")
    per_part = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    facts = per_part.join(p, per_part.l_partkey == p.p_partkey).select(
        dims.surrogate_key("p_brand", "p_type").alias("type_key"), "n")
    counted = facts.groupBy("type_key").agg(F.sum("n").alias("facts"))
    return dim.join(counted, "type_key", "left").select(
        "p_brand", "p_type", F.coalesce(F.col("facts"), F.lit(0)).alias("facts"))


def _table_map_sql() -> str:
    from ..sources.ingest import TABLE_SNAPSHOT_TYPES

    rows = ", ".join(f"('{t}', {i})" for t, i in TABLE_SNAPSHOT_TYPES)
    return f"SELECT * FROM (VALUES {rows}) AS m(table_name, snapshot_type_id)"


@register("table_freshness", oracle=f"""
    WITH h AS (SELECT DISTINCT concat('srv', CAST(user_id // 4 AS VARCHAR)) AS sql_instance,
                      CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                                      WHEN 'signup' THEN 4 ELSE 5 END AS snapshot_type_id,
                      date_trunc('hour', ts) AS snapshot_time FROM events)
    SELECT h.sql_instance, m.table_name, CAST(m.snapshot_type_id AS INTEGER) AS snapshot_type_id,
           MAX(h.snapshot_time) AS last_snapshot_time
    FROM ({_table_map_sql()}) m JOIN h ON h.snapshot_type_id = m.snapshot_type_id
    GROUP BY h.sql_instance, m.table_name, m.snapshot_type_id""")
def q_table_freshness(spark, sf_dir):
    """Latest snapshot per fact table and instance through the fact-table -> type map."""
    from ..operators.joins import broadcast_if_small
    from ..sources import fixtures as fx
    from ..sources.ingest import TABLE_SNAPSHOT_TYPES, table_snapshot_map

    h = fx.fx_header(spark, sf_dir)
    latest = h.groupBy("sql_instance", "snapshot_type_id").agg(F.max("snapshot_time").alias("last_snapshot_time"))
    m = broadcast_if_small(table_snapshot_map(spark))
    return latest.join(m, "snapshot_type_id").select("sql_instance", "table_name", "snapshot_type_id",
                                                     "last_snapshot_time")


@register("database_create_date", oracle="""
    SELECT database_name, CASE WHEN database_name = 'tempdb' THEN TIMESTAMP '1970-01-01 00:00:00'
                               ELSE first_order END AS database_create_date
    FROM (SELECT CASE WHEN o_custkey % 100 = 0 THEN 'tempdb' ELSE 'db' || CAST(o_custkey AS VARCHAR) END
                     AS database_name, MIN(o_orderdate) AS first_order
          FROM orders GROUP BY 1) d""")
def q_database_create_date(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate")
    name = F.when(F.col("o_custkey") % 100 == 0, F.lit("tempdb")) \
            .otherwise(F.concat(F.lit("db"), F.col("o_custkey").cast("string")))
    d = o.groupBy(name.alias("database_name")).agg(F.min("o_orderdate").alias("first_order"))
    return d.select("database_name",
                    sc.database_create_date("database_name", "first_order").alias("database_create_date"))
