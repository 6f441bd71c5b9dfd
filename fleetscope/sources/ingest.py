"""Ingest operators (S1-S15): samples, events, error logs, job history and fleet import.

Readers declare schemas (no inference). Incremental loads filter on
high-watermarks computed as aggregates and applied by join, never collected
to the driver, so the same plan serves one server or the whole fleet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.timeops import hhmmss_to_seconds, to_utc, yyyymmdd_hhmmss_to_ts
from ..operators.joins import HEADER_KEYS, broadcast_if_small, spread_join

# Fact table -> snapshot type id (diagnostics facts use type 10).
TABLE_SNAPSHOT_TYPES = [
    ("agent_job_history", 16),
    ("disk_utilisation_database", 2),
    ("disk_utilisation_volume", 17),
    ("index_missing_stats", 3),
    ("index_usage_stats", 14),
    ("index_histogram", 15),
    ("perf_file_stats", 1),
    ("perf_os_memory_clerks", 1),
    ("perf_os_performance_counters", 1),
    ("perf_os_process_memory", 1),
    ("perf_os_schedulers", 1),
    ("perf_os_wait_stats", 1),
    ("whoisactive", 11),
    ("xes_blockers", 9),
    ("xes_iosubsystem", 10),
    ("xes_long_queries", 7),
    ("xes_query_processing", 10),
    ("xes_waits_stats", 6),
    ("check", 18),
    ("check_action", 18),
    ("disk_utilisation_table", 22),
]


def table_snapshot_map(spark: SparkSession) -> DataFrame:
    """Static relation of fact table name and snapshot type id."""
    return spark.createDataFrame(TABLE_SNAPSHOT_TYPES, "table_name string, snapshot_type_id int")


def read_samples(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                 **options) -> DataFrame:
    """Raw cumulative samples from files with a declared schema.

    ``fmt`` is any file source (parquet, json, csv, orc); for JDBC pass
    ``fmt='jdbc'`` and the connection options.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt != "jdbc":
        reader = reader.schema(schema)
    return reader.load(path) if fmt != "jdbc" else reader.load()


def read_events(spark: SparkSession, path: str, schema: StructType | str, since=None,
                object_name: str | None = None, fmt: str = "parquet", time_col: str = "event_time") -> DataFrame:
    """Event rows newer than a stored offset, optionally of one object (S3).

    Both filters reach the scan. The streaming form is ``streaming.operators.file_stream``, whose offsets are the
    query's checkpoint.
    """
    df = spark.read.format(fmt).schema(schema).load(path)
    if since is not None:
        df = df.filter(F.col(time_col) > F.lit(since))
    if object_name is not None:
        df = df.filter(F.col("object_name") == object_name)
    return df


def new_events(events: DataFrame, stored: DataFrame, current: DataFrame, now, min_interval_s: int = 0,
               session: str = "session_name", time: str = "event_time") -> DataFrame:
    """Events of each session after its stored offset (S3).

    ``stored``: session, execution_count, last_event_time (NULL: never read). ``current``: session, execution_count.
    Sessions read less than ``min_interval_s`` ago and sessions that did not fire since are skipped.
    """
    from ..operators.timeseries import _ts

    start = F.coalesce("last_event_time", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    waited = F.timestamp_diff("SECOND", start, _ts(now)) >= min_interval_s
    offsets = (stored.withColumnRenamed("execution_count", "_seen").join(current, session)
               .filter(waited & (F.coalesce("execution_count", F.lit(0)) > F.coalesce("_seen", F.lit(0))))
               .select(session, start.alias("_since")))
    return spread_join(events, offsets, [session], time, "inner").filter(F.col(time) > F.col("_since")).drop("_since")


def advance_offsets(stored: DataFrame, current: DataFrame, read: DataFrame, now, session: str = "session_name",
                    time: str = "event_time") -> DataFrame:
    """The offsets to store after ``read`` has been stored: sessions with events move to the last one and to their
    current execution count; the others stay (a run that fails before this is simply repeated)."""
    last = read.groupBy(session).agg(F.max(time).alias("_last"))
    moved = last.join(current.withColumnRenamed("execution_count", "_count"), session)
    j = stored.join(moved, session, "left")
    return j.select(session, F.coalesce("_count", "execution_count").alias("execution_count"),
                    F.coalesce("_last", "last_event_time").alias("last_event_time"))


def register_headers(samples: DataFrame, existing: DataFrame, keys: Sequence[str] = HEADER_KEYS) -> DataFrame:
    """New snapshot headers: distinct sample keys not registered yet."""
    keys = list(keys)
    return samples.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")


def errorlog_ingest(lines: DataFrame, keywords: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Error-log lines matching a keyword pair, newer than the last seen per keyword.

    ``lines``: log_date, log_type_id, text (+ attribute_value).
    ``keywords``: keyword_id, keyword1, keyword2 (nullable), log_type_id.
    ``seen``: keyword_id, log_type_id, log_date of lines already stored.
    A line matches when it contains keyword1 and, if given, keyword2
    (case-insensitive); text is trimmed and CR/LF removed.
    """
    kw = broadcast_if_small(keywords.select("keyword_id", "keyword1", "keyword2",
                                            F.col("log_type_id").alias("_kw_type")))
    lt = F.lower(F.col("text"))
    cond = ((F.col("log_type_id") == F.col("_kw_type"))
            & lt.contains(F.lower(F.col("keyword1")))
            & (F.col("keyword2").isNull() | lt.contains(F.lower(F.col("keyword2")))))
    m = lines.join(kw, cond, "inner").drop("_kw_type", "keyword1", "keyword2")
    if seen is not None:
        hw = seen.groupBy("keyword_id", "log_type_id").agg(F.max("log_date").alias("_hw"))
        m = spread_join(m, hw, ["keyword_id", "log_type_id"], "log_date") \
             .filter(F.col("_hw").isNull() | (F.col("log_date") > F.col("_hw"))).drop("_hw")
    clean = F.regexp_replace(F.trim(F.col("text")), "[\r\n]", "")
    return m.withColumn("text", clean)


def job_history_ingest(history: DataFrame, seen: DataFrame | None = None,
                       offset_minutes_col: str | None = None) -> DataFrame:
    """New job-history rows with durations in seconds and UTC run times.

    ``history``: instance_id, job_id, step_id, run_status, run_date (yyyymmdd
    int), run_time (hhmmss int), run_duration (hhmmss int).
    """
    h = history
    if seen is not None:
        h = h.join(seen.select("instance_id"), "instance_id", "left_anti")
    start = yyyymmdd_hhmmss_to_ts("run_date", "run_time")
    if offset_minutes_col:
        start = to_utc(start, offset_minutes_col)
    secs = hhmmss_to_seconds("run_duration")
    return h.select("*", start.alias("run_start_utc"), secs.alias("run_duration_s"),
                    F.timestamp_add("SECOND", secs, start).alias("run_end_utc"))


def session_samples(df: DataFrame, min_seconds: int = 15) -> DataFrame:
    """Sessions running at least ``min_seconds``, or blocked, or blocking."""
    return df.filter((F.col("duration_seconds") >= min_seconds)
                     | (F.coalesce(F.col("blocking_session_id"), F.lit(0)) != 0)
                     | F.coalesce(F.col("is_blocking"), F.lit(False)))


def header_watermark(remote_headers: DataFrame, local_headers: DataFrame,
                     keys: Sequence[str] = ("sql_instance", "snapshot_type_id"),
                     time: str = "snapshot_time") -> DataFrame:
    """Remote headers newer than the local maximum of their (instance, type)."""
    hw = local_headers.groupBy(*keys).agg(F.max(time).alias("_hw"))
    j = spread_join(remote_headers, hw, keys, time)
    return j.filter(F.col("_hw").isNull() | (F.col(time) > F.col("_hw"))).drop("_hw")


def import_facts(remote: DataFrame, local: DataFrame, headers: DataFrame, pk: Sequence[str],
                 instance: str = "sql_instance", time: str = "snapshot_time",
                 header_keys: Sequence[str] = HEADER_KEYS) -> DataFrame:
    """Delta load of a fact table.

    Rows newer than the local maximum time of their instance, not newer than
    the newest header of that instance, with an existing header, and not
    already present by primary key. Never updates.
    """
    local_hw = local.groupBy(instance).agg(F.max(time).alias("_lo"))
    head_hw = headers.groupBy(instance).agg(F.max(time).alias("_hi"))
    limits = head_hw.join(local_hw, instance, "left")  # one row per instance
    r = (spread_join(remote, limits, [instance], time, "inner")
         .filter((F.col("_lo").isNull() | (F.col(time) > F.col("_lo"))) & (F.col(time) <= F.col("_hi")))
         .drop("_lo", "_hi"))
    r = r.join(headers.select(*header_keys).distinct(), list(header_keys), "left_semi")
    return r.join(local.select(*pk), list(pk), "left_anti")


def import_dim(remote: DataFrame, local: DataFrame, keys: Sequence[str], watermark: str,
               instance: str = "sql_instance") -> DataFrame:
    """Changed dimension rows: ``watermark`` newer than the local maximum per instance.

    Feed the result to ``operators.dims.upsert``.
    """
    hw = local.groupBy(instance).agg(F.max(watermark).alias("_hw"))
    j = spread_join(remote, hw, [instance], watermark)
    return j.filter(F.col("_hw").isNull() | (F.col(watermark) > F.col("_hw"))).drop("_hw")


def extract(fact: DataFrame, time: str, last_run, now) -> DataFrame:
    """The (last_run, now] slice of a fact, for a windowed extract."""
    return fact.filter((F.col(time) > F.lit(last_run)) & (F.col(time) <= F.lit(now)))


def write_extract(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write an extract; file sinks are idempotent per path (overwrite)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def failed_checks_since(results: DataFrame, last_check, time: str = "check_time",
                        result_col: str = "result") -> DataFrame:
    """Count of failed external check results since the last check."""
    return (results.filter((F.col(time) > F.lit(last_check)) & (F.lower(F.col(result_col)) == "failed"))
            .agg(F.count(F.lit(1)).alias("failed_count")))


def histogram_ingest(parts: Sequence[DataFrame], include: DataFrame, object_col: str = "object_name",
                     pattern_col: str = "pattern", key_cols: Sequence[str] = ("range_hi_key",)) -> DataFrame:
    """Histogram steps of included objects; typed key columns unified as strings."""
    casted = [p.select(*[F.col(c).cast("string").alias(c) if c in key_cols else F.col(c) for c in p.columns])
              for p in parts]
    u = casted[0]
    for p in casted[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    pats = broadcast_if_small(include.select(F.col(pattern_col).alias("_p")).distinct())
    return u.join(pats, F.like(u[object_col], F.col("_p")), "left_semi")
