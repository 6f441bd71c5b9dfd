"""Event analytics (E1-E10, F9, F10): filters, shredding, de-duplication, dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Applications whose long queries are not captured.
EXCLUDED_LONG_QUERY_APPS = [
    "Microsoft SQL Server Management Studio",
    "Microsoft SQL Server Management Studio - Transact-SQL IntelliSense",
    "SQLServerCEIP",
    "SQLAgent - Job Manager",
    "SQLAgent - Job invocation engine",
    "SQLAgent - Schedule Saver",
]
# Fixed value: minimum duration of a long query, microseconds.
LONG_QUERY_MIN_DURATION_US = 5_000_000
# Fixed value: minimum duration of a captured wait, milliseconds.
LONG_WAIT_MIN_DURATION_MS = 1000


def long_event_filter(df: DataFrame, min_duration_us: int = LONG_QUERY_MIN_DURATION_US,
                      excluded_apps: Sequence[str] = tuple(EXCLUDED_LONG_QUERY_APPS)) -> DataFrame:
    """Keep long-running events that did work.

    All events: duration above the minimum, not a system session, application
    not excluded. Except ``module_end`` events, they must also have used CPU
    and done reads or writes (``rpc_completed`` also passes with result 2).
    """
    base = ((F.col("duration") > min_duration_us) & ~F.col("is_system")
            & ~F.coalesce(F.col("client_app_name").isin(*excluded_apps), F.lit(False)))
    work = (F.col("logical_reads") > 0) | (F.col("physical_reads") > 0) | (F.col("writes") > 0)
    did_work = (F.col("cpu_time") > 0) & (work | ((F.col("event_name") == "rpc_completed")
                                                  & (F.col("result") == 2)))
    return df.filter(base & ((F.col("event_name") == "module_end") | did_work))


def drop_incomplete(df: DataFrame, handle_col: str = "plan_handle",
                    offsets: Sequence[str] = ("statement_start_offset", "statement_end_offset")) -> DataFrame:
    """Drop events without a usable plan handle or offsets."""
    cond = F.col(handle_col).isNotNull() & (F.hex(F.col(handle_col)).rlike("[^0]"))
    for o in offsets:
        cond = cond & F.col(o).isNotNull()
    return df.filter(cond)


def text_dictionary(lines: DataFrame, text_col: str, time_col: str,
                    existing: DataFrame | None = None) -> DataFrame:
    """Occurrence dictionary: per distinct text its count, first and last time.

    ``existing`` is the dictionary accumulated by earlier runs; it is merged
    (counts added, first = min, last = max) so reruns need only new lines.
    """
    new = lines.groupBy(text_col).agg(F.count(F.lit(1)).alias("occurrences"),
                                      F.min(time_col).alias("first_occurrence"),
                                      F.max(time_col).alias("last_occurrence"))
    if existing is None:
        return new
    both = new.unionByName(existing.select(text_col, "occurrences", "first_occurrence", "last_occurrence"))
    return both.groupBy(text_col).agg(F.sum("occurrences").alias("occurrences"),
                                      F.min("first_occurrence").alias("first_occurrence"),
                                      F.max("last_occurrence").alias("last_occurrence"))


def event_dedupe(df: DataFrame, hash_col: str, time_col: str, keep: Sequence[str],
                 count_col: str = "occurrence") -> DataFrame:
    """One row per event hash: the first occurrence's columns plus the count."""
    first = F.min_by(F.struct(*keep), F.col(time_col))
    g = df.groupBy(hash_col).agg(first.alias("_first"), F.min(time_col).alias(f"first_{time_col}"),
                                 F.max(time_col).alias(f"last_{time_col}"),
                                 F.count(F.lit(1)).alias(count_col))
    return g.select(hash_col, "_first.*", f"first_{time_col}", f"last_{time_col}", count_col)


def one_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Keep the first row per key by a declared, deterministic order.

    An aggregation (``min_by`` over a struct of the order columns) rather
    than a ``row_number`` window: partial aggregation keeps a hot key from
    sending all of its rows to one task.
    """
    others = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order_cols)).alias("_r"))
    return g.select(*keys, "_r.*")


# --- XML shredding --------------------------------------------------------------------------------------

# Typed fields of an extended event, (name, element kind, type).
EVENT_FIELDS = [
    ("duration", "data", "bigint"),
    ("cpu_time", "data", "bigint"),
    ("physical_reads", "data", "bigint"),
    ("logical_reads", "data", "bigint"),
    ("writes", "data", "bigint"),
    ("row_count", "data", "bigint"),
    ("last_row_count", "data", "bigint"),
    ("line_number", "data", "int"),
    ("offset", "data", "int"),
    ("offset_end", "data", "int"),
    ("sql_text", "action", "string"),
    ("client_app_name", "action", "string"),
    ("client_hostname", "action", "string"),
    ("database_name", "action", "string"),
    ("plan_handle", "action", "string"),
    ("session_id", "action", "int"),
    ("username", "action", "string"),
]

EVENT_XML_SCHEMA = ("_name string, _timestamp string, "
                    "data array<struct<_name: string, value: string, text: string>>, "
                    "action array<struct<_name: string, value: string, text: string>>")


def _named(arr: str, name: str) -> Column:
    """Value (or text) of the first element of array<struct<_name, value, text>> that has this name."""
    first = F.get(F.filter(F.col(arr), lambda x: x["_name"] == name), F.lit(0))
    return F.coalesce(first["value"], first["text"])


# An event that is read without an XML parser, as a regular expression. Attributes and values hold no
# markup, references or control characters but tab and line feed (single characters, which the expression finds in one
# table); each field has one value, after an optional type and before an optional text.
_CONTROL = "".join(f"\\x{i:02X}" for i in range(0x20))
_PLAIN_ATTR = rf'"[^"<>&{_CONTROL}]*+"'
_PLAIN_NAME = rf'"[^"<>&\x20{_CONTROL}]*+"'
_PLAIN_TEXT = rf"[^<&{_CONTROL.replace(r'\x09', '').replace(r'\x0A', '')}]*+"
_PLAIN_INNER = (rf"(?: package={_PLAIN_NAME})?>(?:<type name={_PLAIN_NAME} package={_PLAIN_NAME}(?:/>|></type>))?"
                rf"<value>{_PLAIN_TEXT}</value>(?:<text>{_PLAIN_TEXT}</text>)?")
PLAIN_EVENT = (rf"\A<event name={_PLAIN_ATTR}(?: package={_PLAIN_ATTR})? timestamp={_PLAIN_ATTR}>"
               rf"(?:<data name={_PLAIN_NAME}{_PLAIN_INNER}</data>|<action name={_PLAIN_NAME}{_PLAIN_INNER}</action>)*+</event>\z")


def _is_plain(xml: Column) -> Column:
    refused = [xml.contains(x) for x in ("]]>", "\uFFFE", "\uFFFF")]
    return xml.rlike(PLAIN_EVENT) & ~(refused[0] | refused[1] | refused[2])


def _plain_attr(xml: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(F.substring_index(xml, ">", 1), rf' {name}="([^"]*)"', 1))


def event_time_from_text(ts_text) -> Column:
    """Event time from an XML timestamp attribute ('2024-01-01T10:00:07.179Z'), rounded
    to whole seconds like a datetime2(0) column."""
    text = F.substring(ts_text, 1, 23)
    whole = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}\z")  # a cast reads this without a formatter
    t = F.when(whole, text.cast("timestamp_ntz")).otherwise(F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")))
    return F.date_trunc("second", F.timestamp_add("MILLISECOND", F.lit(500), t)).cast("timestamp_ntz")


def shred_event(df: DataFrame, xml_col: str = "event_data", keep: Sequence[str] = ()) -> DataFrame:
    """Parse event XML once into typed columns.

    Adds event_name, event_time and the 17 event fields; ``sql_text`` is
    cleaned (tabs dropped, spaces squeezed). ``keep`` columns pass through.
    ``from_xml`` takes most of the time of a row, so events of the plain form
    (``PLAIN_EVENT``) are read by expressions, with the same result; all
    others are parsed.
    """
    from ..functions.scalars import clean_sql_text

    e = df.select(*keep, F.col(xml_col).alias("_x"), _is_plain(F.col(xml_col)).alias("_plain"))
    # names and values of a plain event, in order; one value for each name
    e = e.select(*keep, "_x", "_plain", F.when(~F.col("_plain"), F.from_xml(F.col("_x"), EVENT_XML_SCHEMA)).alias("_e"),
                 F.when(F.col("_plain"), F.regexp_extract_all("_x", F.lit(r'<((?:data|action) name="[^"]*)"'), F.lit(1))).alias("_names"),
                 F.when(F.col("_plain"), F.regexp_extract_all("_x", F.lit("<value>([^<]*)"), F.lit(1))).alias("_values"))
    x, plain = F.col("_x"), F.col("_plain")

    def either(fast: Column, parsed: Column) -> Column:
        return F.when(plain, fast).otherwise(parsed)

    e = e.select(*keep, "_plain", either(_plain_attr(x, "name"), F.col("_e._name")).alias("event_name"),
                 either(_plain_attr(x, "timestamp"), F.col("_e._timestamp")).alias("_t"),
                 "_names", "_values", F.col("_e.data").alias("_d"), F.col("_e.action").alias("_a"))
    cols = []
    for name, kind, typ in EVENT_FIELDS:
        nth = F.array_position("_names", F.lit(f'{kind} name="{name}'))  # 0 without one
        value = F.btrim(F.get("_values", (nth - 1).cast("int")), F.lit(" \t\n"))
        v = either(value, _named("_d" if kind == "data" else "_a", name))
        v = v.try_cast(typ) if typ != "string" else v
        if name == "sql_text":
            v = clean_sql_text(v)
        cols.append(v.alias(name))
    return e.select(*keep, "event_name", event_time_from_text(F.col("_t")).alias("event_time"), *cols)


def long_queries(shredded: DataFrame, rules: DataFrame | None, seen: DataFrame | None,
                 keys: Sequence[str] = ("event_time", "session_id", "sql_instance"),
                 rule_fields: Sequence[str] = ("sql_text", "client_app_name", "client_hostname", "username"))\
        -> DataFrame:
    """Long queries to store (E4): drop excluded ones (F8) and those already stored."""
    from ..functions.patterns import exclude_rules

    out = shredded
    if rules is not None:
        out = exclude_rules(out, rules, list(rule_fields))
    if seen is not None:
        out = out.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return out


FRAME_SCHEMA = "frame array<struct<_level: int, _handle: string, _offsetStart: int, _offsetEnd: int>>"


def wait_events(shredded_waits: DataFrame, excluded: Sequence[str] = (), min_duration_ms: int = 0,
                stack_col: str = "tsql_stack") -> DataFrame:
    """One row per wait event and stack frame, excluded wait types dropped (E5).

    ``stack_col`` holds the frames XML text; frames are parsed with
    ``from_xml`` and exploded (events without frames keep one row).
    """
    w = shredded_waits
    if excluded:
        w = w.filter(~F.col("wait_type").isin(*excluded))
    if min_duration_ms:
        w = w.filter(F.col("duration") > min_duration_ms)
    frames = F.from_xml(F.concat(F.lit("<value>"), F.col(stack_col), F.lit("</value>")), FRAME_SCHEMA)
    w = w.withColumn("_f", frames["frame"])
    return (w.select("*", F.explode_outer("_f").alias("_fr"))
            .select(*[c for c in w.columns if c not in ("_f", stack_col)],
                    F.col("_fr._level").alias("frame_level"), F.col("_fr._handle").alias("frame_handle"),
                    F.col("_fr._offsetStart").alias("offset_start"), F.col("_fr._offsetEnd").alias("offset_end")))


def health_events(df: DataFrame, xml_col: str, inner_schema: str, seen_max=None,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Diagnostics results: component, state and the attributes of the embedded
    component element, only events newer than ``seen_max`` (E6)."""
    e = df.select(*keep, F.from_xml(F.col(xml_col), EVENT_XML_SCHEMA).alias("_e"))
    e = e.select(*keep, event_time_from_text(F.col("_e._timestamp")).alias("event_time"), F.col("_e.data").alias("_d"))
    if seen_max is not None:
        e = e.filter(F.col("event_time") > F.lit(seen_max))
    inner = F.from_xml(F.concat(F.lit("<value>"), _named("_d", "data"), F.lit("</value>")),
                       inner_schema)
    return e.select(*keep, "event_time", _named("_d", "component").alias("component"),
                    _named("_d", "state").alias("state"), inner.alias("detail")) \
            .select(*keep, "event_time", "component", "state", "detail.*")


def plan_dictionary(plans: DataFrame, existing: DataFrame | None = None, hash_col: str = "query_plan_hash",
                    time: str = "event_time", order: Sequence[str] = ("event_time", "plan_handle")) -> DataFrame:
    """One plan per plan hash with first and last seen times.

    The kept plan is the first by a declared order; merging with ``existing``
    keeps the existing plan text and widens the seen range.
    """
    cols = [c for c in plans.columns if c not in (hash_col,)]
    first = plans.groupBy(hash_col).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"),
                                        F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    new = first.select(hash_col, "_r.*", "first_seen", "last_seen").drop(time)
    if existing is None:
        return new
    ex = existing.select(*new.columns)
    both = ex.withColumn("_pri", F.lit(0)).unionByName(new.withColumn("_pri", F.lit(1)))
    other = [c for c in new.columns if c not in (hash_col, "first_seen", "last_seen")]
    g = both.groupBy(hash_col).agg(F.min_by(F.struct(*other), F.col("_pri")).alias("_r"),
                                   F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return g.select(hash_col, "_r.*", "first_seen", "last_seen")


def event_enrich(events: DataFrame, plans: DataFrame, databases: DataFrame,
                 default_procedure: str = "Ad-Hoc Query") -> DataFrame:
    """Long queries with plan hash, database id and procedure (J3): left joins on
    the plan handle and the database name, procedure defaulted for ad-hoc SQL."""
    from .joins import broadcast_if_small

    j = events.join(broadcast_if_small(plans), "plan_handle", "left") \
              .join(broadcast_if_small(databases), "database_name", "left")
    return j.withColumn("procedure_name", F.coalesce(F.col("procedure_name"), F.lit(default_procedure)))


def dense_rank_global(df: DataFrame, order_cols: Sequence[str], alias: str = "rank",
                      partitions: int | None = None, distinct_keys: bool = True) -> DataFrame:
    """Global dense rank by ``order_cols`` without a single-partition window.

    Distinct keys are range-partitioned, numbered within each partition and
    shifted by the key counts of the preceding partitions (a table with one
    row per partition); the numbering is joined back on the keys. With
    ``distinct_keys=False`` the ordering columns must identify rows and the
    result is a row number.
    """
    from pyspark.sql import Window

    keys = df.select(*order_cols).distinct() if distinct_keys else df.select(*order_cols)
    from .joins import shuffle_partitions

    n = partitions or shuffle_partitions(df.sparkSession)
    from .graph import _cut

    ranged = keys.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id())
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    # materialised once: the ranges come from a sample, so two evaluations might not agree
    numbered = _cut(ranged.withColumn("_rn", F.row_number().over(w)))
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    # a running total over the count table: one row per partition, so a single task is fine
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(wo), F.lit(0)).alias("_off"))
    ranks = numbered.join(offs, "_pid").select(*order_cols, (F.col("_off") + F.col("_rn")).cast("bigint").alias(alias))
    # null-safe: a NULL key has a rank like any other
    renamed = ranks.select(F.col(alias), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(order_cols)])
    same = [df[c].eqNullSafe(renamed[f"_k{i}"]) for i, c in enumerate(order_cols)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(renamed, on, "left").select(*[df[c] for c in df.columns], renamed[alias])


BLOCKED_REPORT_SCHEMA = (
    "_monitorLoop long, "
    "`blocked-process` struct<process: struct<_spid: int, _ecid: int, _lockMode: string, _clientapp: string, "
    "_hostname: string, _currentdbname: string, inputbuf: string>>, "
    "`blocking-process` struct<process: struct<_spid: int, _ecid: int, _clientapp: string, _hostname: string, "
    "_currentdbname: string, inputbuf: string>>")


def blocked_process_edges(reports: DataFrame, xml_col: str = "report_xml", seen: DataFrame | None = None,
                          keep: Sequence[str] = ("event_time", "duration")) -> DataFrame:
    """Blocked-process reports -> blocking edges, new ones only.

    ``duration`` is in microseconds and becomes ``blocking_duration_ms``.
    ``seen`` holds stored edges; rows matching on the six edge keys are dropped.
    """
    r = reports.select(*keep, xml_col, F.from_xml(F.col(xml_col), BLOCKED_REPORT_SCHEMA).alias("_r"))
    bd, bg = "_r.`blocked-process`.process", "_r.`blocking-process`.process"
    edges = r.select(
        F.col("_r._monitorLoop").alias("monitor_loop"), "event_time",
        F.col(f"{bd}._spid").alias("blocked_spid"), F.col(f"{bd}._ecid").alias("blocked_ecid"),
        F.col(f"{bg}._spid").alias("blocking_spid"), F.col(f"{bg}._ecid").alias("blocking_ecid"),
        F.col(f"{bd}._lockMode").alias("lock_mode"),
        F.col(f"{bd}._clientapp").alias("blocked_clientapp"), F.col(f"{bg}._clientapp").alias("blocking_clientapp"),
        F.col(f"{bd}._hostname").alias("blocked_hostname"), F.col(f"{bg}._hostname").alias("blocking_hostname"),
        F.col(f"{bd}._currentdbname").alias("blocked_currentdbname"),
        F.col(f"{bg}._currentdbname").alias("blocking_currentdbname"),
        F.col(f"{bd}.inputbuf").alias("blocked_inputbuf"), F.col(f"{bg}.inputbuf").alias("blocking_inputbuf"),
        (F.col("duration") / 1000).alias("blocking_duration_ms"))
    if seen is not None:
        k = ["monitor_loop", "event_time", "blocked_spid", "blocked_ecid", "blocking_spid", "blocking_ecid"]
        edges = edges.join(seen.select(*k).distinct(), k, "left_anti")
    return edges


def with_ids(values: DataFrame, columns: Sequence[str], id_col: str, existing: DataFrame | None = None) -> DataFrame:
    """Distinct ``columns`` with surrogate ids: stored values keep theirs, new ones are numbered after them."""
    new = values.select(*columns).distinct()
    if existing is None:
        return dense_rank_global(new, columns, alias=id_col)
    stored = existing.select(*columns, id_col)
    new = new.join(stored.select(*columns), list(columns), "left_anti")
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    numbered = dense_rank_global(new, columns, alias="_n")
    return stored.unionByName(numbered.select(*columns, (F.col("_n") + top.scalar()).cast("bigint").alias(id_col)))


def errorlog_star(lines: DataFrame, attributes: DataFrame | None = None, texts: DataFrame | None = None):
    """Error-log lines as a star (E9): (attributes, texts, facts).

    Attributes are (attribute_name, attribute_value) with attribute_id, the name told by the log type; texts carry
    errorlog_text_id and the occurrence dictionary; facts count records per (log_date, attribute, text, keyword, log
    type) by id. ``attributes`` and ``texts`` are the stored dimensions, whose ids stay.
    """
    name = F.when(F.col("log_type_id") == 1, "ProcessInfo").when(F.col("log_type_id") == 2, "ErrorLevel").otherwise("")
    named = lines.withColumn("attribute_name", name)
    attrs = with_ids(named, ["attribute_name", "attribute_value"], "attribute_id", attributes)
    ids = with_ids(named, ["text"], "errorlog_text_id", None if texts is None else texts.select("text", "errorlog_text_id"))
    counted = text_dictionary(named, "text", "log_date", None if texts is None else texts.drop("errorlog_text_id"))
    facts = (named.join(attrs, ["attribute_name", "attribute_value"]).join(ids, "text")
             .groupBy("log_date", "attribute_id", "errorlog_text_id", "keyword_id", "log_type_id")
             .agg(F.count(F.lit(1)).alias("record_count")))
    return attrs, ids.join(counted, "text"), facts


IO_SUBSYSTEM_SCHEMA = ("ioSubsystem struct<_ioLatchTimeouts: bigint, _totalLongIos: bigint, longestPendingRequests: "
                       "struct<pendingRequest: array<struct<_filePath: string, _duration: bigint>>>>")


def io_subsystem_events(df: DataFrame, xml_col: str, seen_max=None, keep: Sequence[str] = ()) -> DataFrame:
    """I/O part of the diagnostics results (E6): latch time-outs, long I/Os and the first pending request; events
    without an I/O element give no row."""
    h = health_events(df, xml_col, IO_SUBSYSTEM_SCHEMA, seen_max=seen_max, keep=keep).filter(F.col("ioSubsystem").isNotNull())
    first = F.get("ioSubsystem.longestPendingRequests.pendingRequest", F.lit(0))
    return h.select(*keep, "event_time", F.col("ioSubsystem._ioLatchTimeouts").alias("io_latch_timeouts"),
                    F.col("ioSubsystem._totalLongIos").alias("total_long_ios"),
                    first["_filePath"].alias("longest_pending_request_file"),
                    first["_duration"].alias("longest_pending_request_duration"))
