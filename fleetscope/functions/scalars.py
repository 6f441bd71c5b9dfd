"""Scalar text/number functions as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import col


def clean_sql_text(text) -> Column:
    """Drop tabs, squeeze runs of spaces to one, drop spaces right after a line feed."""
    t = F.regexp_replace(col(text), "\t", "")
    t = F.regexp_replace(t, " +", " ")
    return F.regexp_replace(t, "\n ", "\n")


# Byte-size units, 1024-based, switching below 1000 of the unit.
BYTE_UNITS = ("KB", "MB", "GB", "TB")


def format_bytes(nbytes) -> Column:
    """Human-readable size: '12.34 MB'; a unit is used while the value < 1000."""
    b = col(nbytes).cast("double")
    expr = None
    for i, unit in enumerate(BYTE_UNITS):
        v = b / F.lit(1024.0 ** (i + 1))
        text = F.concat(v.cast("decimal(10,2)").cast("string"), F.lit(" " + unit))
        if i == len(BYTE_UNITS) - 1:
            return expr.otherwise(text)
        expr = F.when(v < 1000, text) if expr is None else expr.when(v < 1000, text)
    return expr


def split_string(df: DataFrame, text_col: str, delimiter: str = ",",
                 value_col: str = "value", seq_col: str = "seq") -> DataFrame:
    """One row per delimited item with its 1-based position; empty items kept,
    NULL input gives no rows (a table function over each row)."""
    import re

    parts = F.split(F.col(text_col), re.escape(delimiter), -1)
    return df.select("*", F.posexplode(parts).alias("_pos", value_col)) \
             .withColumn(seq_col, (F.col("_pos") + 1).cast("int")).drop("_pos")


def parsename(name, part: int) -> Column:
    """The ``part``-th dotted component counted from the right (1 = last);
    NULL when there are more than four components or fewer than ``part``."""
    parts = F.split(col(name), "[.]", -1)
    return F.when(F.size(parts) <= 4, F.try_element_at(parts, F.lit(-part)))


def logical_disk(path) -> Column:
    """Drive (``C:``) or UNC share (``\\\\server\\share``) a file path lives on."""
    p = F.ltrim(col(path))
    unc = F.regexp_extract(p, r"^(\\\\[^\\]*\\[^\\]*)\\", 1)
    drive = F.upper(F.regexp_extract(p, r"^(.{2}[^\\]*)\\", 1))
    return (F.when(p.startswith("\\\\") & (unc != ""), unc)
            .when(F.locate("\\", p, 3) > 0, drive)
            .otherwise(col(path)))


# Fixed value: prefix of the application name agent job steps connect with.
JOB_STEP_APP_PREFIX = "SQLAgent - TSQL JobStep (Job "


_JOB_STEP_LIKE = "sqlagent - tsql jobstep%"


def _job_id_text(app_name) -> Column:
    import re

    rest = F.regexp_replace(col(app_name), "(?i)" + re.escape(JOB_STEP_APP_PREFIX), "")
    return F.substr(rest, F.lit(1), F.lit(34))


def parse_job_id(app_name) -> Column:
    """The 0x-prefixed job id inside an agent job-step application name, else NULL."""
    return F.when(F.lower(col(app_name)).like(_JOB_STEP_LIKE), F.lower(_job_id_text(app_name)))


def parse_job_name(app_name, job_name) -> Column:
    """Replace the job id inside an agent application name with the job's name
    (NULL when the job is unknown); other application names pass through."""
    a = col(app_name)
    return F.when(F.lower(a).like(_JOB_STEP_LIKE), F.replace(a, _job_id_text(a), col(job_name))) \
            .otherwise(a)


def statement_text(batch_text, start_offset, end_offset) -> Column:
    """Statement of a batch by byte offsets into UTF-16 text (-1 end = to the end)."""
    t = col(batch_text)
    start = col(start_offset)
    end = F.when(col(end_offset) == -1, F.length(t) * 2).otherwise(col(end_offset))
    length = (F.floor((end - start) / 2) + 1).cast("int")
    return F.substr(t, (F.floor(start / 2) + 1).cast("int"), length)


def render_template(template, tokens: Mapping[str, Column]) -> Column:
    """Replace each ``{TOKEN}`` of a template by its column value (NULL -> '')."""
    out = col(template)
    for token, value in tokens.items():
        out = F.replace(out, F.lit(token), F.coalesce(value.cast("string"), F.lit("")))
    return out


def anonymise(value) -> Column:
    """md5 of a name, to share statistics without naming servers."""
    return F.md5(col(value).cast("string"))


def parse_wait_info(wait_info) -> tuple[Column, Column]:
    """'(1234ms)LCK_M_S:...' -> (1234 as bigint, 'LCK_M_S')."""
    w = col(wait_info)
    ms = F.regexp_extract(w, r"\((\d+)ms\)", 1)
    typ = F.regexp_extract(w, r"\(\d+ms\)([^:]*)", 1)
    return F.when(ms != "", ms.cast("bigint")), F.when(typ != "", typ)


def grouped_number(text) -> Column:
    """'1,234,567' -> 1234567.0"""
    return F.replace(F.trim(col(text)), F.lit(","), F.lit("")).cast("double")


def space_to_bytes(text) -> Column:
    """Space-usage text such as '7.63 MB' or '12 KB' -> bytes as decimal(19,2)."""
    t = F.trim(col(text))
    num = F.regexp_replace(t, r"\s*[A-Za-z]+$", "").cast("decimal(19,2)")
    unit = F.upper(F.regexp_extract(t, r"([A-Za-z]+)$", 1))
    mult = (F.when(unit == "KB", F.lit(1024)).when(unit == "MB", F.lit(1024 ** 2))
            .when(unit == "GB", F.lit(1024 ** 3)).when(unit == "TB", F.lit(1024 ** 4))
            .otherwise(F.lit(1)))
    return (num * mult.cast("decimal(19,0)")).cast("decimal(19,2)")


def product_major_year(major_version) -> Column:
    """Product major version number -> release year (0 when unknown)."""
    m = col(major_version)
    # Major version -> release year.
    years = {11: 2012, 12: 2014, 13: 2016, 14: 2017, 15: 2019}
    expr = None
    for k, v in years.items():
        expr = F.when(m == k, v) if expr is None else expr.when(m == k, v)
    return expr.otherwise(0)


def xes_timestamp_text(event_xml) -> Column:
    """The 24 characters after the first ``timestamp="`` of an event's XML text."""
    x = col(event_xml)
    pos = F.locate("timestamp", x)
    return F.when(pos > 0, F.substr(x, pos + F.lit(len('timestamp="')), F.lit(24)))


def product_version_major(version) -> Column:
    """'15.0.2000.5' -> 15.0 (the text up to one character after the first dot, as decimal(10,2))."""
    v = col(version)
    return F.substring(v, 1, F.locate(".", v) + 1).try_cast("decimal(10,2)")


def product_version_minor(version) -> Column:
    """Second dotted part from the right ('15.0.2000.5' -> 2000)."""
    return parsename(version, 2)


def escape_for(text, exec_type) -> Column:
    """Quote escaping of text embedded in an action of the given type: T-SQL
    doubles single quotes, PowerShell back-ticks double quotes; trimmed; '' otherwise."""
    t = col(text)
    return F.coalesce(F.trim(F.when(col(exec_type) == "T-SQL", F.replace(t, F.lit("'"), F.lit("''")))
                             .when(col(exec_type) == "PowerShell", F.replace(t, F.lit('"'), F.lit('`"')))),
                      F.lit(""))


def error_detail_text(number, severity, state, procedure, line, message) -> Column:
    """Error details as six ``NAME=value`` lines (procedure and message quoted);
    NULL when there is no error message."""
    def v(c):
        return F.coalesce(col(c).cast("string"), F.lit(""))

    text = F.concat(F.lit("ERROR_NUMBER="), v(number), F.lit("\nERROR_SEVERITY="), v(severity),
                    F.lit("\nERROR_STATE="), v(state), F.lit("\nERROR_PROCEDURE='"), v(procedure),
                    F.lit("'\nERROR_LINE="), v(line), F.lit("\nERROR_MESSAGE='"), v(message), F.lit("'"))
    return F.when(col(message).isNotNull(), text)


# Fixed value: creation date reported for the tempdb database (recreated at every start).
TEMPDB_CREATE_DATE = "1970-01-01 00:00:00"


def database_create_date(name, create_date) -> Column:
    """Creation date of a database, constant for tempdb so that its dimension key is stable."""
    return F.when(col(name) == "tempdb", F.lit(TEMPDB_CREATE_DATE).cast("timestamp_ntz")) \
            .otherwise(col(create_date))
