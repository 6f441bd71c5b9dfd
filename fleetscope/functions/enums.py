"""Enum decodes (F12). Each map is a fixed value table; unmapped codes get the default."""

from __future__ import annotations

from pyspark.sql import Column

from .patterns import decode

# Database file type.
FILE_TYPE = {0: "Rows", 1: "Log", 2: "FILESTREAM", 3: "3", 4: "Full-text"}
FILE_TYPE_DEFAULT = "UNKNOWN"

# Agent job run status.
JOB_RUN_STATUS = {0: "Failed", 1: "Succeeded", 2: "Retry", 3: "Canceled", 4: "In Progress"}
JOB_RUN_STATUS_DEFAULT = "Unknown Status"

# Table data compression.
DATA_COMPRESSION = {
    0: "NONE",
    1: "ROW",
    2: "PAGE",
    3: "COLUMNSTORE : Applies to: SQL Server 2012 (11.x) and later",
    4: "COLUMNSTORE_ARCHIVE : Applies to: SQL Server 2014 (12.x) and later",
}
DATA_COMPRESSION_DEFAULT = "UNKNOWN"

# Error-log type.
LOG_TYPE = {1: "SQL Server", 2: "SQL Agent"}
LOG_TYPE_DEFAULT = "Other"


def file_type_desc(c) -> Column:
    return decode(c, FILE_TYPE, FILE_TYPE_DEFAULT)


def job_status_desc(c) -> Column:
    return decode(c, JOB_RUN_STATUS, JOB_RUN_STATUS_DEFAULT)


def compression_desc(c) -> Column:
    return decode(c, DATA_COMPRESSION, DATA_COMPRESSION_DEFAULT)


def log_type_desc(c) -> Column:
    return decode(c, LOG_TYPE, LOG_TYPE_DEFAULT)


def case_sql(expr: str, mapping: dict, default: str) -> str:
    """The same decode as SQL text."""
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE '{default}' END"


def decode_or_code(c, mapping: dict) -> Column:
    """Decode with the code itself (as text) for unmapped values."""
    from pyspark.sql import functions as F

    from ._util import col

    return F.coalesce(decode(c, mapping), col(c).cast("string"))


def case_or_code_sql(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE CAST({expr} AS VARCHAR) END"


# Replica availability mode.
AVAILABILITY_MODE = {0: "ASYNCHRONOUS_COMMIT", 1: "SYNCHRONOUS_COMMIT", 4: "CONFIGURATION_ONLY"}
# Replica failover mode.
FAILOVER_MODE = {0: "AUTOMATIC", 1: "MANUAL"}
# Database synchronization state.
SYNC_STATE = {0: "NOT SYNCHRONIZING", 1: "SYNCHRONIZING", 2: "SYNCHRONIZED", 3: "REVERTING", 4: "INITIALIZING"}
# Synchronization health.
SYNC_HEALTH = {0: "NOT_HEALTHY", 1: "PARTIALLY_HEALTHY", 2: "HEALTHY"}
# Database state.
DATABASE_STATE = {0: "ONLINE", 1: "RESTORING", 2: "RECOVERING", 3: "RECOVERY_PENDING", 4: "SUSPECT",
                  5: "EMERGENCY", 6: "OFFLINE"}
# Suspend reason.
SUSPEND_REASON = {0: "SUSPEND_FROM_USER", 1: "SUSPEND_FROM_PARTNER", 2: "SUSPEND_FROM_REDO", 3: "SUSPEND_FROM_APPLY",
                  4: "SUSPEND_FROM_CAPTURE", 5: "SUSPEND_FROM_RESTART", 6: "SUSPEND_FROM_UNDO",
                  7: "SUSPEND_FROM_REVALIDATION", 8: "SUSPEND_FROM_XRF_UPDATE"}
