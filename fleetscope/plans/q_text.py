"""Queries: text and number scalars over whole documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..sources.tables import read_table
from .registry import register


@register("clean_sql_text", oracle="""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\t', '', 'g'), ' +', ' ', 'g'),
                                  '\n ', '\n', 'g') AS clean_text
    FROM documents""")
def q_clean_sql_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", sc.clean_sql_text("text").alias("clean_text"))


_BYTES_SQL = """CAST(round(o_totalprice * 100) AS BIGINT)
                * CAST(CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END
                       AS BIGINT)"""


def _fmt_sql(b: str) -> str:
    parts = []
    for i, unit in enumerate(("KB", "MB", "GB")):
        v = f"(CAST({b} AS DOUBLE) / CAST({1024 ** (i + 1)} AS DOUBLE))"
        parts.append(f"WHEN {v} < 1000 THEN concat(CAST(CAST({v} AS DECIMAL(10,2)) AS VARCHAR), ' {unit}')")
    v = f"(CAST({b} AS DOUBLE) / CAST({1024 ** 4} AS DOUBLE))"
    return "CASE " + " ".join(parts) + f" ELSE concat(CAST(CAST({v} AS DECIMAL(10,2)) AS VARCHAR), ' TB') END"


@register("format_bytes", oracle=f"""
    SELECT o_orderkey, nbytes, {_fmt_sql('nbytes')} AS formatted
    FROM (SELECT o_orderkey, {_BYTES_SQL} AS nbytes FROM orders) o""")
def q_format_bytes(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    mult = (F.when(F.col("o_orderkey") % 4 == 0, 1).when(F.col("o_orderkey") % 4 == 1, 1024)
            .when(F.col("o_orderkey") % 4 == 2, 1048576).otherwise(1073741824)).cast("bigint")
    b = o.select("o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("bigint") * mult).alias("nbytes"))
    return b.withColumn("formatted", sc.format_bytes("nbytes"))


@register("split_string", oracle="""
    SELECT doc_id, unnest(string_split(text, chr(10))) AS value,
           CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INTEGER) AS seq
    FROM documents""")
def q_split_string(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return sc.split_string(d, "text", "\n").drop("text")


_HOST = "regexp_extract(url, '://([^/:?]+)', 1)"


@register("parsename", oracle=f"""
    SELECT page_id, host,
      CASE WHEN len(string_split(host, '.')) <= 4 THEN list_extract(string_split(host, '.'), -1) END AS part1,
      CASE WHEN len(string_split(host, '.')) <= 4 THEN list_extract(string_split(host, '.'), -2) END AS part2,
      CASE WHEN len(string_split(host, '.')) <= 4 THEN list_extract(string_split(host, '.'), -3) END AS part3,
      CASE WHEN len(string_split(host, '.')) <= 4 THEN list_extract(string_split(host, '.'), -4) END AS part4
    FROM (SELECT page_id, {_HOST} AS host FROM pages) p""")
def q_parsename(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    h = p.select("page_id", F.regexp_extract("url", "://([^/:?]+)", 1).alias("host"))
    return h.select("page_id", "host", *[sc.parsename("host", i).alias(f"part{i}") for i in range(1, 5)])


_APP_SQL = """CASE WHEN event_type = 'error'
                   THEN 'SQLAgent - TSQL JobStep (Job 0x' || upper(md5(CAST(user_id AS VARCHAR)))
                        || ' : Step ' || CAST(event_id % 5 + 1 AS VARCHAR) || ')'
                   ELSE 'app_' || event_type END"""


@register("parse_job_name", oracle=f"""
    SELECT e.event_id, e.app_name, j.job_name,
           CASE WHEN lower(e.app_name) LIKE 'sqlagent - tsql jobstep%'
                THEN replace(e.app_name, substr(replace(e.app_name, 'SQLAgent - TSQL JobStep (Job ', ''), 1, 34),
                             j.job_name)
                ELSE e.app_name END AS app_name_parsed
    FROM (SELECT event_id, {_APP_SQL} AS app_name FROM events) e
    LEFT JOIN (SELECT '0x' || md5(CAST(c_custkey AS VARCHAR)) AS job_id, c_name AS job_name FROM customer) j
      ON j.job_id = CASE WHEN lower(e.app_name) LIKE 'sqlagent - tsql jobstep%'
                         THEN lower(substr(replace(e.app_name, 'SQLAgent - TSQL JobStep (Job ', ''), 1, 34)) END""")
def q_parse_job_name(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    app = F.when(F.col("event_type") == "error",
                 F.concat(F.lit("SQLAgent - TSQL JobStep (Job 0x"), F.upper(F.md5(F.col("user_id").cast("string"))),
                          F.lit(" : Step "), (F.col("event_id") % 5 + 1).cast("string"), F.lit(")"))) \
           .otherwise(F.concat(F.lit("app_"), F.col("event_type")))
    e = ev.select("event_id", app.alias("app_name")).withColumn("job_id", sc.parse_job_id("app_name"))
    jobs = read_table(spark, sf_dir, "customer", "c_custkey", "c_name").select(
        F.concat(F.lit("0x"), F.md5(F.col("c_custkey").cast("string"))).alias("job_id"),
        F.col("c_name").alias("job_name"))
    j = e.join(jobs, "job_id", "left")
    return j.select("event_id", "app_name", "job_name",
                    sc.parse_job_name("app_name", "job_name").alias("app_name_parsed"))


_PATH_SQL = """CASE page_id % 3
      WHEN 0 THEN '\\\\' || replace(regexp_replace(url, '^[a-z]+://', ''), '/', '\\')
      WHEN 1 THEN 'd:\\' || replace(regexp_replace(url, '^[a-z]+://', ''), '/', '\\')
      ELSE '/' || regexp_replace(url, '^[a-z]+://', '') END"""


def _ld_sql(p: str) -> str:
    lt = f"ltrim({p})"
    return (f"CASE WHEN starts_with({lt}, '\\\\') AND regexp_extract({lt}, '^(\\\\\\\\[^\\\\]*\\\\[^\\\\]*)\\\\', 1) <> '' "
            f"THEN regexp_extract({lt}, '^(\\\\\\\\[^\\\\]*\\\\[^\\\\]*)\\\\', 1) "
            f"WHEN strpos(substr({lt}, 3), '\\') > 0 THEN upper(regexp_extract({lt}, '^(.{{2}}[^\\\\]*)\\\\', 1)) "
            f"ELSE {p} END")


@register("logical_disk", oracle=f"""
    SELECT page_id, path, {_ld_sql('path')} AS logical_disk FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages) p""")
def q_logical_disk(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    win = F.replace(rest, F.lit("/"), F.lit("\\"))
    path = (F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("\\\\"), win))
            .when(F.col("page_id") % 3 == 1, F.concat(F.lit("d:\\"), win))
            .otherwise(F.concat(F.lit("/"), rest)))
    d = p.select("page_id", path.alias("path"))
    return d.withColumn("logical_disk", sc.logical_disk("path"))


@register("statement_text", oracle="""
    SELECT doc_id, s_off, e_off,
           substr(text, CAST(floor(s_off / 2) + 1 AS INTEGER),
                  CAST(floor(((CASE WHEN e_off = -1 THEN length(text) * 2 ELSE e_off END) - s_off) / 2) + 1 AS INTEGER))
               AS statement
    FROM (SELECT doc_id, text, (doc_id % 50) * 2 AS s_off,
                 CASE WHEN doc_id % 3 = 0 THEN -1 ELSE (doc_id % 50) * 2 + (n_chars % 400) * 2 END AS e_off
          FROM documents) d""")
def q_statement_text(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    d = d.select("doc_id", "text", ((F.col("doc_id") % 50) * 2).alias("s_off"),
                 F.when(F.col("doc_id") % 3 == 0, F.lit(-1))
                  .otherwise((F.col("doc_id") % 50) * 2 + (F.col("n_chars") % 400) * 2).alias("e_off"))
    return d.select("doc_id", "s_off", "e_off", sc.statement_text("text", "s_off", "e_off").alias("statement"))


_SPACE_SQL = """CAST(o_orderkey % 1000 AS VARCHAR) || '.' || CAST(o_custkey % 100 AS VARCHAR) || ' '
                || CASE o_orderkey % 5 WHEN 0 THEN 'KB' WHEN 1 THEN 'MB' WHEN 2 THEN 'GB' WHEN 3 THEN 'TB' ELSE 'B' END"""


@register("space_to_bytes", oracle=f"""
    SELECT o_orderkey, txt,
      CAST(CAST(regexp_replace(txt, '\\s*[A-Za-z]+$', '') AS DECIMAL(19,2))
           * CAST(CASE upper(regexp_extract(txt, '([A-Za-z]+)$', 1)) WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576
                  WHEN 'GB' THEN 1073741824 WHEN 'TB' THEN 1099511627776 ELSE 1 END AS DECIMAL(19,0))
           AS DECIMAL(19,2)) AS nbytes
    FROM (SELECT o_orderkey, {_SPACE_SQL} AS txt FROM orders) o""")
def q_space_to_bytes(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    unit = (F.when(F.col("o_orderkey") % 5 == 0, "KB").when(F.col("o_orderkey") % 5 == 1, "MB")
            .when(F.col("o_orderkey") % 5 == 2, "GB").when(F.col("o_orderkey") % 5 == 3, "TB").otherwise("B"))
    t = o.select("o_orderkey", F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit("."),
                                        (F.col("o_custkey") % 100).cast("string"), F.lit(" "), unit).alias("txt"))
    return t.withColumn("nbytes", sc.space_to_bytes("txt"))
