"""Queries: growth of volumes, databases and tables; baseline time shifts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeops import trunc_ntz

from ..operators.growth import growth
from ..operators.windows import running_sum
from ..sources import fixtures as fx
from ..sources.tables import read_table
from .fixture_sql import with_fixtures
from .registry import register


def _growth_sql(src: str, key: str, value: str, direction: int, total: str | None, remaining: bool) -> str:
    tot_cols = f", arg_max({total}, snapshot_time) AS {total}_current" if total else ""
    rem = (f""", CASE WHEN growth_per_day > 0 THEN {value}_current // growth_per_day ELSE 9999 END
                 AS days_until_full""" if remaining else "")
    ratio = (f", CAST({value}_current AS DOUBLE) / CAST(NULLIF({total}_current, 0) AS DOUBLE) AS free_ratio"
             if total else "")
    return f"""
    SELECT *{rem}{ratio} FROM (
      SELECT *, CAST(CASE WHEN total_growth_days > 0 AND bytes_growth > 0 THEN bytes_growth // total_growth_days
                          ELSE 0 END AS BIGINT) AS growth_per_day
      FROM (SELECT {key}, MIN(snapshot_time) AS first_snapshot_time, MAX(snapshot_time) AS last_snapshot_time,
                   arg_max({value}, snapshot_time) AS {value}_current{tot_cols},
                   (arg_max({value}, snapshot_time) - arg_min({value}, snapshot_time)) * {direction} AS bytes_growth,
                   date_diff('day', MIN(snapshot_time), MAX(snapshot_time)) AS total_growth_days
            FROM {src} GROUP BY {key}) a) b"""


@register("growth_volume", oracle=with_fixtures(_growth_sql("fx_volume", "volume_id", "free_bytes", -1,
                                                            "total_bytes", True), "fx_volume"))
def q_growth_volume(spark, sf_dir):
    return growth(fx.fx_volume(spark, sf_dir), ["volume_id"], "snapshot_time", "free_bytes",
                  total="total_bytes", direction=-1, remaining="free_bytes")


_DB_CTE = ("dbs", """SELECT database_id, snapshot_time,
                     CAST(SUM(cents) OVER (PARTITION BY database_id ORDER BY snapshot_time) AS BIGINT) AS size_bytes
                     FROM (SELECT o_custkey AS database_id, date_trunc('month', o_orderdate) AS snapshot_time,
                                  CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
                           FROM orders GROUP BY 1, 2) m""")


@register("growth_database", oracle=with_fixtures(_growth_sql("dbs", "database_id", "size_bytes", 1, None, False),
                                                  extra=[_DB_CTE]))
def q_growth_database(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    m = (o.groupBy(F.col("o_custkey").alias("database_id"), trunc_ntz("month", "o_orderdate").alias("snapshot_time"))
         .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")))
    sized = running_sum(m, ["database_id"], "snapshot_time", "cents", "size_bytes", bucket="year")
    return growth(sized.drop("cents"), ["database_id"], "snapshot_time", "size_bytes")


_TBL_CTE = ("tbl", """SELECT table_id, snapshot_time,
                      CAST(SUM(n) OVER (PARTITION BY table_id ORDER BY snapshot_time) AS BIGINT) AS row_count
                      FROM (SELECT l_partkey AS table_id, date_trunc('month', l_shipdate) AS snapshot_time,
                                   COUNT(*) AS n FROM lineitem GROUP BY 1, 2) m""")


@register("growth_table", oracle=with_fixtures(_growth_sql("tbl", "table_id", "row_count", 1, None, False),
                                               extra=[_TBL_CTE]))
def q_growth_table(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate")
    m = (li.groupBy(F.col("l_partkey").alias("table_id"), trunc_ntz("month", "l_shipdate").alias("snapshot_time"))
         .agg(F.count(F.lit(1)).alias("n")))
    sized = running_sum(m, ["table_id"], "snapshot_time", "n", "row_count", bucket="year")
    return growth(sized.drop("n"), ["table_id"], "snapshot_time", "row_count")


# --- J19 time-shifted baselines --------------------------------------------------------------------------

@register("baseline_shift", oracle=with_fixtures("""
    SELECT c.sql_instance, c.check_id, c.snapshot_time, c.sum100,
           d.sum100 AS sum100_1_day_ago, w.sum100 AS sum100_1_week_ago
    FROM fx_check c
    LEFT JOIN fx_check d ON d.sql_instance = c.sql_instance AND d.check_id = c.check_id
                        AND d.snapshot_time = c.snapshot_time - INTERVAL 1 DAY
    LEFT JOIN fx_check w ON w.sql_instance = c.sql_instance AND w.check_id = c.check_id
                        AND w.snapshot_time = c.snapshot_time - INTERVAL 7 DAY""", "fx_check"))
def q_baseline_shift(spark, sf_dir):
    from ..operators.baselines import baseline_shift

    c = fx.fx_check(spark, sf_dir).select("sql_instance", "check_id", "snapshot_time", "sum100")
    return baseline_shift(c, ["sql_instance", "check_id"], "snapshot_time", "sum100",
                          {"1_day_ago": ("DAY", 1), "1_week_ago": ("WEEK", 1)})
