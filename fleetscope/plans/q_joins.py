"""Queries: header and star joins, insert-if-new, set difference, null-safe keys,
pattern exclusion, include/exclude lists, counter selection, exclusion rules,
long-event filter, snapshot registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import counter_filter, exclude_by_pattern, exclude_rules, include_exclude
from ..operators.events import EXCLUDED_LONG_QUERY_APPS, long_event_filter
from ..operators.joins import broadcast_if_small, insert_new, null_safe_join, star_join, with_header
from ..sources import fixtures as fx
from ..sources.ingest import register_headers
from ..sources.tables import read_table
from .config import COUNTER_DIM, Relation
from .fixture_sql import with_fixtures
from .registry import register

T = "snapshot_time"
CUTOFF = "2024-01-20 00:00:00"

_HDR_CTE = ("hdr", """SELECT sql_instance, snapshot_type_id, snapshot_time,
                      snapshot_time + to_minutes(CAST(CAST(right(sql_instance, 1) AS INTEGER) * 60 AS BIGINT))
                          AS report_time,
                      CAST(CAST(right(sql_instance, 1) AS INTEGER) * 60 AS INTEGER) AS snapshot_time_utc_offset
               FROM fx_header""")


def header_with_report_time(spark, sf_dir):
    off = (F.substring("sql_instance", -1, 1).cast("int") * 60).cast("int")
    h = fx.fx_header(spark, sf_dir)
    return h.select("*", F.timestamp_add("MINUTE", off.cast("bigint"), F.col(T)).alias("report_time"),
                    off.alias("snapshot_time_utc_offset"))


# --- J1 -----------------------------------------------------------------------------------------

@register("fact_header", headline=True, oracle=with_fixtures("""
    SELECT s.*, h.report_time, h.snapshot_time_utc_offset FROM fx_sample s
    JOIN hdr h USING (sql_instance, snapshot_type_id, snapshot_time)""", "fx_sample", "fx_header",
    extra=[_HDR_CTE]))
def q_fact_header(spark, sf_dir):
    return with_header(fx.fx_sample(spark, sf_dir), header_with_report_time(spark, sf_dir))


# --- J2 -----------------------------------------------------------------------------------------

@register("star_join", oracle=with_fixtures(f"""
    SELECT s.sql_instance, s.instance_name, s.snapshot_type_id, s.snapshot_time, s.cntr_value,
           d.object_name, d.counter_name, n.n_name AS server_nation, r.r_name AS server_region
    FROM fx_sample s
    JOIN ({COUNTER_DIM.sql()}) d ON d.snapshot_type_id = s.snapshot_type_id
    JOIN (SELECT concat('srv', CAST(n_nationkey AS VARCHAR)) AS sql_instance, n_name, n_regionkey FROM nation) n
      ON n.sql_instance = s.sql_instance
    JOIN region r ON r.r_regionkey = n.n_regionkey""", "fx_sample"))
def q_star_join(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir).select(*fx.SAMPLE_KEYS, T, "cntr_value")
    servers = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").select(
        F.concat(F.lit("srv"), F.col("n_nationkey").cast("string")).alias("sql_instance"),
        F.col("n_name").alias("server_nation"), F.col("n_regionkey").alias("r_regionkey"))
    regions = read_table(spark, sf_dir, "region", "r_regionkey", "r_name").withColumnRenamed(
        "r_name", "server_region")
    counters = COUNTER_DIM.df(spark).drop("cntr_type")
    out = star_join(s, {"counter": (counters, ["snapshot_type_id"]),
                        "server": (servers, ["sql_instance"]),
                        "region": (regions, ["r_regionkey"])})
    return out.drop("r_regionkey")


# --- S1 / J4 / U-3 ----------------------------------------------------------------------------------

@register("register_headers", oracle=with_fixtures(f"""
    SELECT DISTINCT sql_instance, snapshot_type_id, snapshot_time FROM fx_sample
    EXCEPT
    SELECT sql_instance, snapshot_type_id, snapshot_time FROM fx_header WHERE snapshot_time < TIMESTAMP '{CUTOFF}'
    """, "fx_sample", "fx_header"))
def q_register_headers(spark, sf_dir):
    existing = fx.fx_header(spark, sf_dir).filter(F.col(T) < F.lit(CUTOFF).cast("timestamp_ntz"))
    return register_headers(fx.fx_sample(spark, sf_dir), existing)


@register("insert_new", oracle=with_fixtures(f"""
    SELECT c.* FROM fx_check c
    WHERE NOT EXISTS (SELECT 1 FROM fx_check t WHERE t.snapshot_time < TIMESTAMP '{CUTOFF}'
                      AND t.sql_instance = c.sql_instance AND t.check_id = c.check_id
                      AND t.snapshot_time = c.snapshot_time)""", "fx_check"))
def q_insert_new(spark, sf_dir):
    c = fx.fx_check(spark, sf_dir)
    target = c.filter(F.col(T) < F.lit(CUTOFF).cast("timestamp_ntz"))
    return insert_new(c, target, ["sql_instance", "check_id", T])


@register("except_heads", oracle=with_fixtures("""
    SELECT monitor_loop, blocking_spid AS session_id, blocking_ecid AS ecid FROM fx_edge
    EXCEPT
    SELECT monitor_loop, blocked_spid, blocked_ecid FROM fx_edge""", "fx_edge"))
def q_except_heads(spark, sf_dir):
    e = fx.fx_edge(spark, sf_dir)
    blockers = e.select("monitor_loop", F.col("blocking_spid").alias("session_id"),
                        F.col("blocking_ecid").alias("ecid"))
    blocked = e.select("monitor_loop", F.col("blocked_spid").alias("session_id"),
                       F.col("blocked_ecid").alias("ecid"))
    return blockers.subtract(blocked)


# --- J15 ---------------------------------------------------------------------------------------------

@register("null_safe_join", oracle="""
    SELECT a.p_partkey, a.k_brand, a.k_type, b.total_qty
    FROM (SELECT p_partkey, p_brand AS k_brand, nullif(p_type, 'ECONOMY') AS k_type FROM part) a
    JOIN (SELECT p_brand AS k_brand, nullif(p_type, 'ECONOMY') AS k_type,
                 CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_qty
          FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) b
      ON COALESCE(a.k_brand, '') = COALESCE(b.k_brand, '') AND COALESCE(a.k_type, '') = COALESCE(b.k_type, '')""")
def q_null_safe_join(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    keyed = p.select("p_partkey", F.col("p_brand").alias("k_brand"),
                     F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("k_type"))
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity")
    per_part = li.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))
    stats = (per_part.join(keyed, per_part.l_partkey == keyed.p_partkey)
             .groupBy("k_brand", "k_type").agg(F.sum("qty").alias("total_qty")))
    return null_safe_join(keyed, stats, ["k_brand", "k_type"])


# --- F4 / F5 ------------------------------------------------------------------------------------------

NAME_PATTERNS = Relation("pattern string", [("%ring%",), ("red %",), ("_lue%",)])


@register("exclude_patterns", oracle=f"""
    SELECT p_partkey, p_name FROM part
    WHERE NOT EXISTS (SELECT 1 FROM ({NAME_PATTERNS.sql()}) x WHERE p_name LIKE x.pattern)""")
def q_exclude_patterns(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    return exclude_by_pattern(p, "p_name", NAME_PATTERNS.df(spark))


LIST_SPEC = "-%ring%,-%steel%,small%,large%,%widget"


@register("include_exclude_list", oracle="""
    SELECT p_partkey, p_name FROM part
    WHERE NOT (p_name LIKE '%ring%' OR p_name LIKE '%steel%')
      AND (p_name LIKE 'small%' OR p_name LIKE 'large%' OR p_name LIKE '%widget')""")
def q_include_exclude_list(spark, sf_dir):
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    return include_exclude(p, "p_name", LIST_SPEC)


# --- F6 / F7 -----------------------------------------------------------------------------------------------

COUNTER_CONFIG = Relation(
    "object_name string, counter_name string, instance_name string, base_counter_name string",
    [
        ("General Statistics", "User Connections", "<* !_Total>", None),
        ("SQL Statistics", "Batch Requests/sec", "_Total", None),
        ("Buffer Manager", "Buffer cache hit ratio", "db1", "Buffer cache hit ratio base"),
        ("Locks", "Average Wait Time (ms)", "<* !_Total>", "Average Wait Time Base"),
        ("Statistics", "Elapsed Time:Requests", "db2", None),
    ],
)

_CS_CTE = ("cs", f"""SELECT s.sql_instance, CASE WHEN s.instance_name = 'db0' THEN '_Total' ELSE s.instance_name END
                         AS instance_name, s.snapshot_type_id, s.snapshot_time, s.cntr_value,
                         d.object_name, d.counter_name
                  FROM fx_sample s JOIN ({COUNTER_DIM.sql()}) d USING (snapshot_type_id)""")


@register("counter_filter", oracle=with_fixtures(f"""
    SELECT cs.*, c.base_counter_name FROM cs JOIN ({COUNTER_CONFIG.sql()}) c
      ON rtrim(cs.object_name) LIKE '%' || c.object_name AND rtrim(cs.counter_name) = c.counter_name
     AND (rtrim(cs.instance_name) = c.instance_name
          OR (c.instance_name = '<* !_Total>' AND rtrim(cs.instance_name) <> '_Total'))""",
    "fx_sample", extra=[_CS_CTE]))
def q_counter_filter(spark, sf_dir):
    s = fx.fx_sample(spark, sf_dir).join(broadcast_if_small(COUNTER_DIM.df(spark)), "snapshot_type_id")
    s = s.select("sql_instance",
                 F.when(F.col("instance_name") == "db0", "_Total").otherwise(F.col("instance_name"))
                 .alias("instance_name"), "snapshot_type_id", T, "cntr_value", "object_name", "counter_name")
    return counter_filter(s, COUNTER_CONFIG.df(spark))


# --- F8 / F9 --------------------------------------------------------------------------------------------------

EXCLUSION_RULES = Relation(
    "sql_text string, client_app_name string, client_hostname string, username string",
    [
        (None, "app_click", None, None),
        ("%purchase%", None, "srv1", None),
        (None, None, None, "user3"),
        ("%sign_p%", "app%", "srv_", "user_"),
        (None, None, None, None),
    ],
)

_LQ_COLS = """event_id, concat('SELECT * FROM t_', event_type) AS sql_text, concat('app_', event_type) AS client_app_name,
              concat('srv', CAST(user_id % 4 AS VARCHAR)) AS client_hostname,
              concat('user', CAST(user_id % 7 AS VARCHAR)) AS username"""


def _long_queries(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "event_type", "user_id")
    return ev.select("event_id",
                     F.concat(F.lit("SELECT * FROM t_"), "event_type").alias("sql_text"),
                     F.concat(F.lit("app_"), "event_type").alias("client_app_name"),
                     F.concat(F.lit("srv"), (F.col("user_id") % 4).cast("string")).alias("client_hostname"),
                     F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")).alias("username"))


_RULE_FIELDS = ["sql_text", "client_app_name", "client_hostname", "username"]


@register("exclude_rules", oracle=f"""
    SELECT q.* FROM (SELECT {_LQ_COLS} FROM events) q
    WHERE NOT EXISTS (
      SELECT 1 FROM ({EXCLUSION_RULES.sql()}) r
      WHERE NOT (r.sql_text IS NULL AND r.client_app_name IS NULL AND r.client_hostname IS NULL AND r.username IS NULL)
        AND (r.sql_text IS NULL OR q.sql_text LIKE r.sql_text)
        AND (r.client_app_name IS NULL OR q.client_app_name LIKE r.client_app_name)
        AND (r.client_hostname IS NULL OR q.client_hostname LIKE r.client_hostname)
        AND (r.username IS NULL OR q.username LIKE r.username))""")
def q_exclude_rules(spark, sf_dir):
    return exclude_rules(_long_queries(spark, sf_dir), EXCLUSION_RULES.df(spark), _RULE_FIELDS)


_XE_EVENTS = ["module_end", "rpc_completed", "sp_statement_completed", "sql_statement_completed"]


def _xe_sql() -> str:
    names = ", ".join(f"'{n}'" for n in _XE_EVENTS)
    apps = ", ".join("'" + a + "'" for a in EXCLUDED_LONG_QUERY_APPS + ["app_click", "app_view"])
    return f"""SELECT event_id, list_extract([{names}], CAST(event_id % 4 AS INTEGER) + 1) AS event_name,
               CAST(round(value * 100000) AS BIGINT) AS duration, CAST(user_id % 5 AS BIGINT) AS cpu_time,
               CAST(event_id % 3 AS BIGINT) AS logical_reads, CAST(event_id % 5 AS BIGINT) AS physical_reads,
               CAST(event_id % 2 AS BIGINT) AS writes, CAST(user_id % 3 AS INTEGER) AS result,
               user_id % 11 = 0 AS is_system,
               list_extract([{apps}], CAST(user_id % 8 AS INTEGER) + 1) AS client_app_name
        FROM events"""


def _xe_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "value")
    names = F.array(*[F.lit(n) for n in _XE_EVENTS])
    apps = F.array(*[F.lit(a) for a in EXCLUDED_LONG_QUERY_APPS + ["app_click", "app_view"]])
    return ev.select(
        "event_id", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("event_name"),
        F.round(F.col("value") * 100000).cast("bigint").alias("duration"),
        (F.col("user_id") % 5).alias("cpu_time"), (F.col("event_id") % 3).alias("logical_reads"),
        (F.col("event_id") % 5).alias("physical_reads"), (F.col("event_id") % 2).alias("writes"),
        (F.col("user_id") % 3).cast("int").alias("result"), (F.col("user_id") % 11 == 0).alias("is_system"),
        F.element_at(apps, (F.col("user_id") % 8 + 1).cast("int")).alias("client_app_name"))


@register("long_event_filter", oracle=f"""
    SELECT * FROM ({_xe_sql()}) e
    WHERE duration > 5000000 AND NOT is_system
      AND client_app_name NOT IN ({", ".join("'" + a + "'" for a in EXCLUDED_LONG_QUERY_APPS)})
      AND (event_name = 'module_end'
           OR (cpu_time > 0 AND (logical_reads > 0 OR physical_reads > 0 OR writes > 0
                                 OR (event_name = 'rpc_completed' AND result = 2))))""")
def q_long_event_filter(spark, sf_dir):
    return long_event_filter(_xe_events(spark, sf_dir))
