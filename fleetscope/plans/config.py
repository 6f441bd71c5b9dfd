"""Small configuration relations (counter dimension, wait types, thresholds...).

Each is declared once as rows and exposed both as a Spark DataFrame and as a
SQL ``VALUES`` text for the oracle. They are configuration, not data: their
size is fixed and independent of the telemetry volume.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, _dt.datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'"
    return "'" + str(v).replace("'", "''") + "'"


class Relation:
    def __init__(self, ddl: str, rows: list[tuple]):
        self.ddl = ddl
        self.rows = rows
        self.names = [c.strip().split()[0] for c in ddl.split(",")]
        self.types = [c.strip().split()[1] for c in ddl.split(",")]

    def df(self, spark: SparkSession) -> DataFrame:
        # an inline table: the planner knows its size
        body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in self.rows)
        cols = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(self.names, self.types))
        return spark.sql(f"SELECT {cols} FROM VALUES {body} AS v({', '.join(self.names)})")

    def sql(self) -> str:
        casts = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
        body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in self.rows)
        cols = ", ".join(f"CAST({n} AS {casts[t]}) AS {n}" for n, t in zip(self.names, self.types))
        return f"SELECT {cols} FROM (VALUES {body}) AS v({', '.join(self.names)})"


# Counter dimension of the derived fleet: snapshot type -> counter.
COUNTER_DIM = Relation(
    "snapshot_type_id int, object_name string, counter_name string, cntr_type int",
    [
        (1, "SQLServer:General Statistics", "User Connections", 65792),
        (2, "SQLServer:SQL Statistics", "Batch Requests/sec", 272696576),
        (3, "SQLServer:Buffer Manager", "Buffer cache hit ratio", 537003264),
        (4, "SQLServer:Locks", "Average Wait Time (ms)", 1073874176),
        (5, "Batch Resp Statistics", "Elapsed Time:Requests", 272696576),
    ],
)

# Rate counters for the derived-rate pivot: snapshot type -> counter names.
RATE_COUNTERS = Relation(
    "snapshot_type_id int, counter_name string",
    [
        (1, "Index Searches/sec"),
        (2, "Full Scans/sec"),
        (3, "SQL Compilations/sec"),
        (4, "Batch Requests/Sec"),
        (5, "SQL Re-Compilations/sec"),
        (3, "Page Splits/sec"),
        (5, "Page lookups/sec"),
    ],
)

# Wait-type dimension of the derived fleet: (type, counter instance) -> wait type.
WAIT_TYPES = Relation(
    "snapshot_type_id int, instance_name string, wait_type string",
    [
        (1, "db0", "LCK_M_X"), (1, "db1", "PAGEIOLATCH_SH"), (1, "db2", "SOS_SCHEDULER_YIELD"),
        (2, "db0", "CXPACKET"), (2, "db1", "WRITELOG"), (2, "db2", "ASYNC_NETWORK_IO"),
        (3, "db0", "HADR_SYNC_COMMIT"), (3, "db1", "HADR_THROTTLE_LOG_RATE_GOVERNOR"),
        (3, "db2", "PAGELATCH_EX"),
        (4, "db0", "BROKER_RECEIVE_WAITFOR"), (4, "db1", "BROKER_TASK_STOP"), (4, "db2", "RESOURCE_SEMAPHORE"),
        (5, "db0", "LATCH_EX"), (5, "db1", "MSQL_XACT_MUTEX"), (5, "db2", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP"),
    ],
)

# A vocabulary of wait-type names touching every classifier rule, including
# the ordering traps; events are spread over it by event id.
WAIT_VOCABULARY = [
    "SOS_SCHEDULER_YIELD", "THREADPOOL", "LCK_M_S", "LOCK", "LATCH_SH", "PAGELATCH_UP",
    "PAGEIOLATCH_EX", "HADR_SYNC_COMMIT", "HADR_WORK_QUEUE", "PWAIT_HADR_CHANGE_NOTIFIER",
    "FFT_RECOVERY", "RESOURCE_SEMAPHORE_QUERY_COMPILE", "CMEMTHREAD", "CLR_AUTO_EVENT",
    "SQLCLR_APPDOMAIN", "DBMIRROR_SEND", "MIRROR_SEND_MESSAGE", "XACT_OWN_TRANSACTION",
    "DTC_STATE", "TRANSACTION_MUTEX", "PREEMPTIVE_OS_WRITEFILE", "BROKER_TASK_STOP",
    "BROKER_RECEIVE_WAITFOR", "WRITELOG", "ASYNC_NETWORK_IO", "CXCONSUMER", "WAITFOR",
    "TRACEWRITE", "FT_IFTS_RWLOCK", "MSSEARCH", "IO_COMPLETION", "BACKUPIO", "REPL_SCHEMA_ACCESS",
    "SE_REPL_CATCHUP_THROTTLE", "LOG_RATE_GOVERNOR", "HADR_THROTTLE_LOG_RATE_GOVERNOR",
    "REPLICA_WRITE", "WAIT_XTP_CKPT_CLOSE", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP", "XTP_PREEMPTIVE_TASK",
    "PARALLEL_REDO_WORKER_SYNC", "COLUMNSTORE_BUILD_THROTTLE", "lck_m_x", "LCKX", "SLEEP_TASK",
    "ONDEMAND_TASK_QUEUE",
]
