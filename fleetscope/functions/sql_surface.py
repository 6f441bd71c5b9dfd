"""The scalar functions as SQL functions.

One catalogue names each function with its parameters; its body is the Column function itself, whose analysed expression is
printed as SQL and registered as a temporary SQL function. So both surfaces have one definition, and a call is inlined
into the plan of the query like any built-in expression: no Python runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import patterns as pt
from . import scalars as sc
from . import timeops as to


def _boundary(unit: str) -> Callable[[Column, Column], Column]:
    return lambda start, end: to.datediff_boundary(unit, start, end)


#: Name, parameters, and the function of the parameters as columns.
CATALOGUE: dict[str, tuple[str, Callable[..., Column]]] = {
    "clean_sql_text": ("text string", sc.clean_sql_text),
    "format_bytes": ("nbytes bigint", sc.format_bytes),
    "parsename": ("name string, part int", lambda name, part: F.element_at(F.array(*[sc.parsename(name, i) for i in (1, 2, 3, 4)]), part)),
    "logical_disk": ("path string", sc.logical_disk),
    "parse_job_id": ("app_name string", sc.parse_job_id),
    "parse_job_name": ("app_name string, job_name string", sc.parse_job_name),
    "statement_text": ("batch_text string, start_offset int, end_offset int", sc.statement_text),
    "anonymise": ("value string", sc.anonymise),
    "wait_duration_ms": ("wait_info string", lambda w: sc.parse_wait_info(w)[0]),
    "wait_type": ("wait_info string", lambda w: sc.parse_wait_info(w)[1]),
    "grouped_number": ("text string", sc.grouped_number),
    "space_to_bytes": ("text string", sc.space_to_bytes),
    "product_major_year": ("major_version int", sc.product_major_year),
    "xes_timestamp_text": ("event_xml string", sc.xes_timestamp_text),
    "product_version_major": ("version string", sc.product_version_major),
    "product_version_minor": ("version string", sc.product_version_minor),
    "escape_for": ("text string, exec_type string", sc.escape_for),
    "error_detail_text": ("number int, severity int, state int, procedure string, line int, message string", sc.error_detail_text),
    "database_create_date": ("name string, create_date timestamp_ntz", sc.database_create_date),
    "wait_category": ("wait_type string", pt.wait_category),
    "time_group": ("ts timestamp_ntz, minutes int", to.time_group),
    "report_time": ("ts timestamp_ntz, offset_minutes int", to.report_time),
    "to_local": ("ts_utc timestamp_ntz, offset_minutes int", to.to_local),
    "to_utc": ("ts_local timestamp_ntz, offset_minutes int", to.to_utc),
    **{f"datediff_{u}": ("start timestamp_ntz, stop timestamp_ntz", _boundary(u)) for u in ("second", "minute", "hour", "day")},
    "hhmmss_to_seconds": ("value int", to.hhmmss_to_seconds),
    "yyyymmdd_hhmmss_to_ts": ("date_int int, time_int int", to.yyyymmdd_hhmmss_to_ts),
    "add_duration_ms": ("ts timestamp_ntz, ms bigint", to.add_duration_ms),
    "us_week_of_year": ("ts timestamp_ntz", to.us_week_of_year),
}


def register_functions(spark: SparkSession, names: list[str] | None = None, prefix: str = "") -> list[str]:
    """Register the functions of the catalogue (or those in ``names``) in the session; returns their SQL names."""
    out = []
    for name in names or CATALOGUE:
        params, fn = CATALOGUE[name]
        empty = spark.createDataFrame([], params)
        typed = empty.select(fn(*[F.col(c) for c in empty.columns]).alias("x"))
        body = typed._jdf.queryExecution().analyzed().expressions().head().child().sql()
        kind = typed.schema[0].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({params}) RETURNS {kind} RETURN {body}")
        out.append(prefix + name)
    return out
