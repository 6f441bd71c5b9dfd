"""The telemetry fixtures as portable SQL CTEs, for the DuckDB oracle.

Each body mirrors the DataFrame construction in ``fleetscope.sources.fixtures``.
``with_fixtures(sql, 'fx_sample', ...)`` prefixes a query with the CTEs it
needs (dependencies included, in order).
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_ev": ((), """
        SELECT event_id, ts, user_id, event_type, value,
               concat('srv', CAST(user_id // 4 AS VARCHAR)) AS sql_instance,
               concat('db', CAST(user_id % 3 AS VARCHAR)) AS instance_name,
               CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                               WHEN 'signup' THEN 4 ELSE 5 END AS snapshot_type_id,
               date_trunc('hour', ts) AS snapshot_time,
               CAST(round(value * 100) AS BIGINT) AS v100
        FROM events"""),
    "fx_header": (("fx_ev",), """
        SELECT DISTINCT sql_instance, snapshot_type_id, snapshot_time FROM fx_ev"""),
    "fx_inc": (("fx_ev",), """
        SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time,
               CAST(SUM(v100) AS BIGINT) AS inc, COUNT(*) AS n
        FROM fx_ev GROUP BY sql_instance, instance_name, snapshot_type_id, snapshot_time"""),
    "fx_sample": (("fx_inc",), """
        SELECT sql_instance, instance_name, snapshot_type_id, snapshot_time,
               CAST(SUM(inc) OVER w AS BIGINT) AS cntr_value,
               CAST(SUM(n) OVER w AS BIGINT) AS base_cntr_value
        FROM fx_inc
        WINDOW w AS (PARTITION BY sql_instance, instance_name, snapshot_type_id,
                     date_trunc('day', snapshot_time) ORDER BY snapshot_time)"""),
    "fx_check": (("fx_inc",), """
        SELECT sql_instance, check_id, snapshot_time, sum100, n,
               CAST(sum100 AS DOUBLE) / CAST(n * 100 AS DOUBLE) AS check_value,
               CASE WHEN sum100 > n * 8000 THEN 'CRITICAL'
                    WHEN sum100 > n * 5000 THEN 'WARNING' ELSE 'OK' END AS check_status
        FROM (SELECT sql_instance, snapshot_type_id AS check_id, snapshot_time,
                     CAST(SUM(inc) AS BIGINT) AS sum100, CAST(SUM(n) AS BIGINT) AS n
              FROM fx_inc GROUP BY sql_instance, snapshot_type_id, snapshot_time) c"""),
    "fx_edge": ((), """
        SELECT o_orderkey % 50 AS monitor_loop, o_orderdate AS event_time,
               CAST(floor(o_orderkey / 50) + 2 AS INTEGER) AS blocked_spid, 0 AS blocked_ecid,
               CAST(floor(floor(o_orderkey / 50) / 3) + 1 AS INTEGER) AS blocking_spid, 0 AS blocking_ecid,
               o_orderstatus AS lock_mode, o_orderpriority AS database_name,
               CAST(round(o_totalprice) AS BIGINT) AS blocking_duration_ms, o_orderkey
        FROM orders"""),
    "fx_volume": ((), """
        SELECT volume_id, snapshot_time,
               CAST(10000000 - SUM(used) OVER (PARTITION BY volume_id ORDER BY snapshot_time) AS BIGINT)
                   AS free_bytes,
               CAST(10000000 AS BIGINT) AS total_bytes
        FROM (SELECT l_suppkey AS volume_id, date_trunc('month', l_shipdate) AS snapshot_time,
                     CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS used
              FROM lineitem GROUP BY l_suppkey, date_trunc('month', l_shipdate)) m"""),
}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for dep in FIXTURE_SQL[name][0]:
            visit(dep)
        out.append(name)

    for n in names:
        visit(n)
    return out


def with_fixtures(body: str, *names: str, extra: list[tuple[str, str]] | None = None,
                  recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs of the named fixtures plus ``extra`` (name, sql)."""
    ctes = [f"{n} AS ({FIXTURE_SQL[n][1].strip()})" for n in _ordered(names)]
    ctes += [f"{n} AS ({sql.strip()})" for n, sql in (extra or [])]
    head = "WITH RECURSIVE " if recursive else "WITH "
    prefix = (head + ",\n".join(ctes) + "\n") if ctes else ""
    return prefix + body.strip()
