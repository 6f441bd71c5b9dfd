"""Pattern predicates and classifiers.

LIKE keeps SQL semantics: ``%`` is any run and ``_`` any single character
(``'LCK_%'`` matches ``'LCKX'``). Pattern tables are joined with the pattern
side broadcast behind a size check, since a LIKE join is a nested loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_small
from ._util import col

ALL_BUT_TOTAL = "<* !_Total>"


def like(value, pattern) -> Column:
    """SQL LIKE with a Column pattern or a literal pattern string."""
    return F.like(col(value), pattern if isinstance(pattern, Column) else F.lit(pattern))


def ilike(value, pattern) -> Column:
    """Case-insensitive LIKE (the usual collation of server object names)."""
    return F.like(F.lower(col(value)), F.lower(pattern if isinstance(pattern, Column) else F.lit(pattern)))


def exclude_by_pattern(df: DataFrame, value_col: str, patterns: DataFrame,
                       pattern_col: str = "pattern") -> DataFrame:
    """Rows whose ``value_col`` matches none of the patterns."""
    pats = broadcast_if_small(patterns.select(F.col(pattern_col).alias("_pat")).distinct())
    return df.join(pats, F.like(df[value_col], F.col("_pat")), "left_anti")


def include_exclude(df: DataFrame, value_col: str, spec: str) -> DataFrame:
    """Filter by a list spec like ``"ALL"``, ``"master,msdb"`` or ``"-tempdb,-%Report%"``.

    Passes when the spec is ALL, or when (no exclusion matches) and (an
    inclusion matches or there are no inclusions). Items starting with ``-``
    are exclusions; every item is a LIKE pattern; items are taken verbatim
    (spaces kept), as split on commas.
    """
    if spec == "ALL":
        return df
    items = spec.split(",")
    excl = [i[1:] for i in items if i.startswith("-")]
    incl = [i for i in items if not i.startswith("-")]
    v = F.col(value_col)
    cond = F.lit(True)
    if excl:
        any_ex = None
        for p in excl:
            m = F.like(v, F.lit(p))
            any_ex = m if any_ex is None else (any_ex | m)
        cond = cond & ~F.coalesce(any_ex, F.lit(False))
    if incl:
        any_in = None
        for p in incl:
            m = F.like(v, F.lit(p))
            any_in = m if any_in is None else (any_in | m)
        cond = cond & F.coalesce(any_in, F.lit(False))
    return df.filter(cond)


def counter_filter(samples: DataFrame, config: DataFrame) -> DataFrame:
    """Keep samples selected by a counter configuration.

    Object names match by suffix (``object LIKE '%' || cfg_object``), counter
    names exactly, instance names exactly or by the ``<* !_Total>`` wildcard
    (every instance except ``_Total``). Adds the config's ``base_counter_name``.
    """
    cfg = broadcast_if_small(config.select(
        F.col("object_name").alias("_cfg_object"), F.col("counter_name").alias("_cfg_counter"),
        F.col("instance_name").alias("_cfg_instance"), F.col("base_counter_name")))
    s = samples
    cond = (
        F.like(F.rtrim(s["object_name"]), F.concat(F.lit("%"), F.col("_cfg_object")))
        & (F.rtrim(s["counter_name"]) == F.col("_cfg_counter"))
        & ((F.rtrim(s["instance_name"]) == F.col("_cfg_instance"))
           | ((F.col("_cfg_instance") == F.lit(ALL_BUT_TOTAL)) & (F.rtrim(s["instance_name"]) != F.lit("_Total"))))
    )
    return s.join(cfg, cond, "inner").drop("_cfg_object", "_cfg_counter", "_cfg_instance")


def exclude_rules(df: DataFrame, rules: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Drop rows matched by any rule; a rule matches when each of its non-NULL
    fields LIKE-matches the row's value (F8).

    Rules whose fields are all NULL would match every row; they are ignored.
    """
    some = None
    for f in fields:
        c = F.col(f).isNotNull()
        some = c if some is None else (some | c)
    r = broadcast_if_small(rules.filter(some).select(*[F.col(f).alias(f"_r_{f}") for f in fields]))
    cond = None
    for f in fields:
        c = F.col(f"_r_{f}").isNull() | F.coalesce(F.like(df[f], F.col(f"_r_{f}")), F.lit(False))
        cond = c if cond is None else (cond & c)
    return df.join(r, cond, "left_anti")


def decode(value, mapping: Mapping, default=None) -> Column:
    """Enum decode through a literal map (F12); ``default`` when unmapped."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = F.try_element_at(m, col(value))
    return out if default is None else F.coalesce(out, F.lit(default))


# Wait-type categories, first match wins, in this order.
# Each entry: (category, LIKE patterns, exact names, names excluded from the patterns).
WAIT_CATEGORY_RULES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("CPU", [], ["SOS_SCHEDULER_YIELD"], []),
    ("CPU - Unavailable Worker Threads", [], ["THREADPOOL"], []),
    ("Lock", ["LCK_%"], ["LOCK"], []),
    ("Latch", ["LATCH_%"], [], []),
    ("Buffer Latch", ["PAGELATCH_%"], [], []),
    ("Buffer IO", ["PAGEIOLATCH_%"], [], []),
    ("Always On - Secondary Synch", ["HADR_SYNC_COMMIT"], [], []),
    ("Always On", ["HADR_%", "PWAIT_HADR_%"], [], []),
    ("FileTable", ["FFT_%"], [], []),
    ("Memory - Compilation", ["RESOURCE_SEMAPHORE_%", "RESOURCE_SEMAPHORE_QUERY_COMPILE"], [], []),
    ("Memory", [], ["UTIL_PAGE_ALLOC", "SOS_VIRTUALMEMORY_LOW", "SOS_RESERVEDMEMBLOCKLIST",
                    "RESOURCE_SEMAPHORE", "CMEMTHREAD", "CMEMPARTITIONED", "EE_PMOLOCK",
                    "MEMORY_ALLOCATION_EXT", "RESERVED_MEMORY_ALLOCATION_EXT", "MEMORY_GRANT_UPDATE"], []),
    ("SQL CLR", ["CLR%", "SQLCLR%"], [], []),
    ("Mirroring", ["DBMIRROR%"], ["MIRROR_SEND_MESSAGE"], []),
    ("Transaction", ["XACT%", "DTC%", "TRAN_MARKLATCH_%", "MSQL_XACT_%"], ["TRANSACTION_MUTEX"], []),
    ("External APIs or XPs", ["PREEMPTIVE_%"], [], []),
    ("Service Broker", ["BROKER_%"], [], ["BROKER_RECEIVE_WAITFOR"]),
    ("Tran Log IO", [], ["LOGMGR", "LOGBUFFER", "LOGMGR_RESERVE_APPEND", "LOGMGR_FLUSH",
                         "LOGMGR_PMM_LOG", "CHKPT", "WRITELOG"], []),
    ("Network IO", [], ["ASYNC_NETWORK_IO", "NET_WAITFOR_PACKET", "PROXY_NETWORK_IO",
                        "EXTERNAL_SCRIPT_NETWORK_IO"], []),
    ("CPU - Parallelism", [], ["CXPACKET", "EXCHANGE", "CXCONSUMER"], []),
    ("User Wait", [], ["WAITFOR", "WAIT_FOR_RESULTS", "BROKER_RECEIVE_WAITFOR"], []),
    ("Tracing", [], ["TRACEWRITE", "SQLTRACE_LOCK", "SQLTRACE_FILE_BUFFER",
                     "SQLTRACE_FILE_WRITE_IO_COMPLETION", "SQLTRACE_FILE_READ_IO_COMPLETION",
                     "SQLTRACE_PENDING_BUFFER_WRITERS", "SQLTRACE_SHUTDOWN", "QUERY_TRACEOUT",
                     "TRACE_EVTNOTIF"], []),
    ("Full Text Search", ["FT_%"], ["FULLTEXT GATHERER", "MSSEARCH",
                                    "PWAIT_RESOURCE_SEMAPHORE_FT_PARALLEL_QUERY_SYNC"], []),
    ("Other Disk IO", [], ["ASYNC_IO_COMPLETION", "IO_COMPLETION", "WRITE_COMPLETION",
                           "IO_QUEUE_LIMIT", "IO_RETRY"], []),
    ("Backup IO", [], ["BACKUPIO", "BACKUPBUFFER"], []),
    ("Replication", ["SE_REPL_%", "REPL_%"], ["REPLICA_WRITES", "FCB_REPLICA_WRITE",
                                             "FCB_REPLICA_READ", "PWAIT_HADRSIM"], []),
    ("Log Rate Governor", [], ["LOG_RATE_GOVERNOR", "POOL_LOG_RATE_GOVERNOR",
                               "HADR_THROTTLE_LOG_RATE_GOVERNOR", "INSTANCE_LOG_RATE_GOVERNOR"], []),
    ("Snapshots", [], ["REPLICA_WRITE"], []),
    ("In-Memory OLTP Logging", [], ["WAIT_XTP_OFFLINE_CKPT_LOG_IO", "WAIT_XTP_CKPT_CLOSE"], []),
    ("Query Store", ["QDS%"], [], []),
    ("In-Memory OLTP", ["XTP%", "WAIT_XTP%"], [], []),
    ("Parallel Redo", ["PARALLEL_REDO%"], [], []),
    ("Columnstore", ["COLUMNSTORE%"], [], []),
]
WAIT_CATEGORY_OTHER = "Other"


def wait_category(wait_type) -> Column:
    """Category of a wait type: ordered first match over the rules."""
    w = F.upper(col(wait_type))
    expr = None
    for category, patterns, exact, excluded in WAIT_CATEGORY_RULES:
        cond = None
        for p in patterns:
            c = w.like(p)
            cond = c if cond is None else (cond | c)
        if exact:
            c = w.isin(*exact)
            cond = c if cond is None else (cond | c)
        if excluded:
            cond = cond & ~w.isin(*excluded)
        expr = F.when(cond, category) if expr is None else expr.when(cond, category)
    return expr.otherwise(WAIT_CATEGORY_OTHER)


def wait_category_sql(wait_type: str) -> str:
    """The same classifier as portable SQL text (for oracles and SQL users)."""
    w = f"upper({wait_type})"
    parts = []
    for category, patterns, exact, excluded in WAIT_CATEGORY_RULES:
        conds = [f"{w} LIKE '{p}'" for p in patterns]
        if exact:
            conds.append(f"{w} IN (" + ", ".join(f"'{e}'" for e in exact) + ")")
        cond = "(" + " OR ".join(conds) + ")"
        if excluded:
            cond += f" AND {w} NOT IN (" + ", ".join(f"'{e}'" for e in excluded) + ")"
        parts.append(f"WHEN {cond} THEN '{category}'")
    return "CASE " + " ".join(parts) + f" ELSE '{WAIT_CATEGORY_OTHER}' END"
