"""Joining rows back to a per-key table when one key may hold a third of the rows; tasks by the number of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least this share of the rows count as heavy; there can be no more than its inverse of them.
HEAVY_SHARE = 1 / 1000
#: Rows that one task of :func:`few` takes.
TASK_ROWS = 50_000


def few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df`` (about ``rows`` rows) in no more tasks than one for ``each`` rows, or one a core: a shuffle of few rows has as many
    partitions as one of many, and a task costs more than its rows then."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // each + 1))


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row per value of ``keys``; ``size`` counts the rows of the key).

    ``total`` is the sum of ``size``, or more. At most 1 / HEAVY_SHARE keys can hold HEAVY_SHARE of the rows each, so the
    table of heavy keys is broadcast with a proven bound and their rows never shuffle; the other keys are joined
    by a shuffle in which no key is large. Null keys match nothing.
    """
    least = max(2, int(total * HEAVY_SHARE) + 1)
    heavy, light = groups.filter(F.col(size) >= least), groups.filter(F.col(size) < least)
    extra = [c for c in groups.columns if c not in keys]
    out = rows.join(F.broadcast(heavy), list(keys), "left")
    done = out.filter(F.col(size).isNotNull())
    rest = out.filter(F.col(size).isNull()).drop(*extra)
    return done.unionByName(rest.join(light, list(keys), "left"))
