"""Queries: blocking chains, dependency levels, circular references, distinct blocked sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregates import distinct_count
from ..operators.graph import blocking_chains, dependency_levels
from ..operators.joins import circular_refs
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .fixture_sql import with_fixtures
from .registry import register

_DETAILS = ["event_time", "lock_mode", "database_name", "blocking_duration_ms", "o_orderkey"]
_PIECE = "CAST({s} AS VARCHAR) || '.' || CAST({e} AS VARCHAR) || '/'"


def _piece(s, e):
    return _PIECE.format(s=s, e=e)


_CHAINS_SQL = with_fixtures(f"""
    SELECT h.monitor_loop, h.session_id, h.ecid,
           h.blocking_spid AS blocking_session_id,
           h.blocking_level, h.blocking_chain,
           '    ' || chr(160) || chr(160) || repeat('|         ', h.blocking_level)
             || CASE WHEN h.blocking_level = 0 THEN 'HEAD BLOCKER -  ' ELSE '|------  ' END
             || 'SPID ' || CASE WHEN h.session_id <= 50 THEN '(SYSTEM)' ELSE '' END || ': '
             || CAST(h.session_id AS VARCHAR) AS blocking_tree,
           {", ".join(f"CASE WHEN h.blocking_level = 0 THEN bh.{c} ELSE bp.{c} END AS {c}" for c in _DETAILS)},
           row_number() OVER (ORDER BY h.monitor_loop, h.blocking_chain) AS sequence
    FROM h
    LEFT JOIN bproc bp ON bp.rn = 1 AND bp.monitor_loop = h.monitor_loop AND bp.blocked_spid = h.session_id
         AND bp.blocked_ecid = h.ecid AND bp.blocking_spid = h.blocking_spid AND bp.blocking_ecid = h.blocking_ecid
    LEFT JOIN bhead bh ON bh.rn = 1 AND bh.monitor_loop = h.monitor_loop AND bh.blocking_spid = h.session_id
         AND bh.blocking_ecid = h.ecid""", "fx_edge", recursive=True, extra=[
    ("heads", """SELECT monitor_loop, blocking_spid AS session_id, blocking_ecid AS ecid FROM fx_edge
                 EXCEPT SELECT monitor_loop, blocked_spid, blocked_ecid FROM fx_edge"""),
    ("step", """SELECT DISTINCT monitor_loop, blocked_spid, blocked_ecid, blocking_spid, blocking_ecid FROM fx_edge"""),
    ("h", f"""SELECT monitor_loop, session_id, ecid, '/' || {_piece('session_id', 'ecid')} AS blocking_chain,
                     CAST(NULL AS INTEGER) AS blocking_spid, CAST(NULL AS INTEGER) AS blocking_ecid,
                     0 AS blocking_level FROM heads
              UNION ALL
              SELECT h.monitor_loop, s.blocked_spid, s.blocked_ecid,
                     h.blocking_chain || {_piece('s.blocked_spid', 's.blocked_ecid')},
                     s.blocking_spid, s.blocking_ecid, h.blocking_level + 1
              FROM h JOIN step s ON s.monitor_loop = h.monitor_loop AND s.blocking_spid = h.session_id
                                AND s.blocking_ecid = h.ecid
              WHERE NOT contains(h.blocking_chain, '/' || {_piece('s.blocked_spid', 's.blocked_ecid')})"""),
    ("bproc", f"""SELECT *, row_number() OVER (PARTITION BY monitor_loop, blocked_spid, blocked_ecid, blocking_spid,
                                  blocking_ecid ORDER BY {", ".join(_DETAILS)}) AS rn FROM fx_edge"""),
    ("bhead", """SELECT *, row_number() OVER (PARTITION BY monitor_loop, blocking_spid, blocking_ecid
                                  ORDER BY event_time, blocked_spid, blocked_ecid) AS rn FROM fx_edge"""),
])


@register("blocking_chains", headline=True, oracle=_CHAINS_SQL)
def q_blocking_chains(spark, sf_dir):
    return blocking_chains(fx.fx_edge(spark, sf_dir))


@register("dependency_levels", oracle=with_fixtures("""
    SELECT node AS child, MAX(lvl) AS level FROM r GROUP BY node""", "fx_edge", recursive=True, extra=[
    ("e", """SELECT DISTINCT CAST(monitor_loop AS VARCHAR) || ':' || CAST(blocked_spid AS VARCHAR) AS child,
                    CAST(monitor_loop AS VARCHAR) || ':' || CAST(blocking_spid AS VARCHAR) AS parent FROM fx_edge"""),
    ("nodes", "SELECT child AS node FROM e UNION SELECT parent FROM e"),
    ("r", """SELECT node, 1 AS lvl FROM nodes
             UNION ALL SELECT e.child, r.lvl + 1 FROM r JOIN e ON e.parent = r.node"""),
]))
def q_dependency_levels(spark, sf_dir):
    e = fx.fx_edge(spark, sf_dir)
    loop = F.col("monitor_loop").cast("string")
    edges = e.select(F.concat(loop, F.lit(":"), F.col("blocked_spid").cast("string")).alias("child"),
                     F.concat(loop, F.lit(":"), F.col("blocking_spid").cast("string")).alias("parent"))
    return dependency_levels(edges)


_LANES = """SELECT s.s_nationkey AS a, c.c_nationkey AS b, CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS qty
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
    GROUP BY 1, 2"""
_HEAVY = f"""SELECT a, b FROM (SELECT a, b, qty, AVG(qty) OVER () AS avg_qty FROM ({_LANES}) x) y
    WHERE qty > avg_qty"""


@register("circular_refs", oracle=f"""
    SELECT x.a, x.b FROM ({_HEAVY}) x
    WHERE EXISTS (SELECT 1 FROM ({_HEAVY}) y WHERE y.a = x.b AND y.b = x.a)""")
def q_circular_refs(spark, sf_dir):
    """Trade lanes (supplier nation -> customer nation) heavier than the average lane
    whose reverse lane is heavy too: the pairs referencing each other."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    lanes = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey)
             .groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
             .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
    # the average lane volume is a scalar subquery: computed once, compared on every lane
    heavy = lanes.filter(F.col("qty") > lanes.agg(F.avg("qty")).scalar()).select("a", "b")
    return circular_refs(heavy, heavy, "a", "b")


@register("distinct_blocked", oracle=with_fixtures("""
    SELECT monitor_loop, COUNT(DISTINCT blocked_spid) AS blocked_sessions,
           COUNT(DISTINCT blocking_spid) AS blocking_sessions FROM fx_edge GROUP BY monitor_loop""", "fx_edge"))
def q_distinct_blocked(spark, sf_dir):
    e = fx.fx_edge(spark, sf_dir)
    a = distinct_count(e, ["monitor_loop"], "blocked_spid", "blocked_sessions")
    b = distinct_count(e, ["monitor_loop"], "blocking_spid", "blocking_sessions")
    return a.join(b, "monitor_loop")
