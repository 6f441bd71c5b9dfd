"""Metric deltas (M1-M7): reset-safe counter deltas against the previous snapshot.

"Previous" means the previous *snapshot of that type on that instance*, not
the previous row of the key: a counter missing from the last snapshot has no
previous value. The operator therefore
  1. finds each header's previous snapshot time (skew-tolerant lag on the
     header, which is far smaller than the facts), and
  2. equi-joins each sample to the sample of the same key at that time.
Step 2 is a shuffle join on (key, time): a hot instance spreads over all its
timestamps instead of landing in one window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import spread_join
from .windows import previous_values

INSTANCE_TYPE = ["sql_instance", "snapshot_type_id"]


def previous_snapshot(header: DataFrame, keys: Sequence[str] = INSTANCE_TYPE,
                      time: str = "snapshot_time", bucket: str = "day", carry: Sequence[str] = ()) -> DataFrame:
    """Header rows with ``prev_snapshot_time`` = previous snapshot of the same (instance, type).

    ``carry`` names header columns (e.g. ``report_time``) kept on each row, so
    facts joined to this table get them without a second header join.
    """
    hp = previous_values(header.select(*keys, time, *carry).distinct(), keys, time, [], bucket=bucket,
                         prefix="prev_")
    return hp.select(*keys, time, *carry, F.col(f"prev_{time}").alias("prev_snapshot_time"))


def positive_delta(cur, prev) -> Column:
    """``cur - prev`` if the counter grew, else 0 (a reset or no change)."""
    cur, prev = (F.col(c) if isinstance(c, str) else c for c in (cur, prev))
    return F.when(cur > prev, cur - prev).otherwise(F.lit(0))


def _first_value(policy: str, cur: Column) -> Column:
    if policy == "zero":
        return F.lit(0)
    if policy == "value":
        return cur
    if policy == "null":
        return F.lit(None)
    raise ValueError(f"unknown first-row policy {policy!r}")


def join_previous(samples: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str],
                  header: DataFrame | None = None, header_keys: Sequence[str] = INSTANCE_TYPE,
                  header_cols: Sequence[str] = ()) -> DataFrame:
    """Attach ``prev_<c>`` for each column and ``prev_snapshot_time`` (header previous).

    ``prev_<c>`` is NULL when the key is absent from the previous snapshot;
    ``has_prev`` says whether the key was present there. ``header_cols`` are
    header columns attached on the way (the join is the fact-header join, J1).
    """
    keys = list(keys)
    if header is None:
        header = samples.select(*header_keys, time)
    hp = previous_snapshot(header, header_keys, time, carry=header_cols)
    cur = samples.join(hp, list(header_keys) + [time], "inner")
    prev = samples.select(
        *keys, F.col(time).alias("prev_snapshot_time"),
        F.lit(True).alias("has_prev"),
        *[F.col(c).alias(f"prev_{c}") for c in cols],
    )
    j = cur.join(prev, keys + ["prev_snapshot_time"], "left")
    return j.withColumn("has_prev", F.coalesce(F.col("has_prev"), F.lit(False)))


def counter_delta(samples: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str],
                  first: str = "zero", header: DataFrame | None = None,
                  header_keys: Sequence[str] = INSTANCE_TYPE, suffix: str = "_delta") -> DataFrame:
    """Reset-safe delta of cumulative counters (M1, M1n, M3).

    ``<c>_delta`` = cur - prev when cur > prev, else 0. With no previous
    sample of the key in the previous snapshot: 0 (``first='zero'``), the
    value itself (``'value'``) or NULL (``'null'``). ``delta_seconds`` is the
    time since the previous sample, NULL without one.
    """
    j = join_previous(samples, keys, time, cols, header, header_keys)
    out = [F.col(c) for c in samples.columns]
    for c in cols:
        cur, prev = F.col(c), F.col(f"prev_{c}")
        out.append(F.when(F.col("has_prev"), F.when(cur > prev, cur - prev).otherwise(F.lit(0)))
                   .otherwise(_first_value(first, cur)).alias(f"{c}{suffix}"))
    out.append(F.when(F.col("has_prev"), F.timestamp_diff("SECOND", F.col("prev_snapshot_time"), F.col(time)))
               .alias("delta_seconds"))
    return j.select(*out)


def gauge_delta(samples: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str],
                header: DataFrame | None = None, header_keys: Sequence[str] = INSTANCE_TYPE) -> DataFrame:
    """Signed change of a gauge since the previous snapshot, 0 without one (M2)."""
    j = join_previous(samples, keys, time, cols, header, header_keys)
    out = [F.col(c) for c in samples.columns]
    out += [F.coalesce(F.col(c) - F.col(f"prev_{c}"), F.lit(0)).alias(f"{c}_delta") for c in cols]
    return j.select(*out)


def wait_delta(samples: DataFrame, keys: Sequence[str], time: str, tasks_col: str, cols: Sequence[str],
               header: DataFrame | None = None) -> DataFrame:
    """Significant waits only: rows whose task count grew since the previous snapshot (M6)."""
    all_cols = [tasks_col] + [c for c in cols if c != tasks_col]
    d = counter_delta(samples, keys, time, all_cols, first="zero", header=header)
    return d.filter(F.col(f"{tasks_col}_delta") > 0)


def active_since(samples: DataFrame, keys: Sequence[str], time: str, last_exec_col: str,
                 cols: Sequence[str] = (), header: DataFrame | None = None) -> DataFrame:
    """Only rows whose ``last_exec_col`` advanced since the previous snapshot (M7).

    First sight counts as executed; ``cols`` get deltas with the full value on
    first sight (the procedure-statistics policy).
    """
    j = join_previous(samples, keys, time, [last_exec_col] + list(cols), header)
    out = [F.col(c) for c in samples.columns]
    for c in cols:
        cur, prev = F.col(c), F.col(f"prev_{c}")
        out.append(F.when(F.col("has_prev"), F.when(cur > prev, cur - prev).otherwise(F.lit(0)))
                   .otherwise(cur).alias(f"{c}_delta"))
    advanced = (~F.col("has_prev")) | (F.col(last_exec_col) > F.col(f"prev_{last_exec_col}"))
    return j.filter(advanced).select(*out)


def counter_delta_incremental(new: DataFrame, stored: DataFrame, keys: Sequence[str], time: str,
                              cols: Sequence[str], new_header: DataFrame | None = None,
                              stored_header: DataFrame | None = None, first: str = "zero",
                              header_keys: Sequence[str] = INSTANCE_TYPE) -> DataFrame:
    """Deltas for a new batch of samples only, reading just the boundary of the stored history.

    The previous snapshot of the first new snapshot is the latest stored
    snapshot of that (instance, type); only the stored samples *at* that time
    are joined in (a semi join on the per-pair latest time), so the work grows
    with the increment, not with the stored history. Output rows are those of
    ``new``, with the same values ``counter_delta`` gives over the whole history.
    """
    hk = list(header_keys)
    if new_header is None:
        new_header = new.select(*hk, time).distinct()
    if stored_header is None:
        stored_header = stored.select(*hk, time).distinct()
    last = stored_header.groupBy(*hk).agg(F.max(time).alias(time))
    boundary = stored.join(last, hk + [time], "left_semi")
    cols_all = list(new.columns)
    u = boundary.select(*cols_all).unionByName(new.select(*cols_all))
    hdr = last.unionByName(new_header.select(*hk, time))
    d = counter_delta(u, keys, time, cols, first=first, header=hdr, header_keys=hk)
    return spread_join(d, last.withColumnRenamed(time, "_stored_max"), hk, time) \
            .filter(F.col("_stored_max").isNull() | (F.col(time) > F.col("_stored_max"))).drop("_stored_max")
