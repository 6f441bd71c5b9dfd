"""Join operators: fact-header, star, insert-if-new, null-tolerant keys.

Joins are declared, never hinted blindly: a dimension is broadcast only when
its size is checked (``broadcast_if_small``), otherwise the planner (and AQE
at run time) decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER_KEYS = ["sql_instance", "snapshot_type_id", "snapshot_time"]

# A side is broadcast explicitly when the planner's size for it is at most this.
BROADCAST_BYTES = 8 << 20


def plan_bytes(df: DataFrame) -> int | None:
    """The planner's size of ``df`` in bytes: exact for literal relations, from file sizes for scans,
    not reduced by filters and aggregations; a huge number where nothing is known."""
    if not hasattr(df, "_jdf"):  # a remote session does not show its plans
        return None
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its size is known and within ``max_bytes``.

    The size is read from the optimised plan, so it holds after projections,
    filters and renames. A side without the hint is left to the planner
    (``spark.sql.autoBroadcastJoinThreshold``, a sort-merge join beyond it) and
    to AQE, which re-plans with measured sizes at run time.
    """
    size = plan_bytes(df)
    return F.broadcast(df) if size is not None and size <= max_bytes else df


def shuffle_partitions(spark) -> int:
    """The session's shuffle partition count (falling back to the default parallelism)."""
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        return spark.sparkContext.defaultParallelism


# Copies of a group's row in a spread join: the rows of one key are dealt over so many tasks.
SPREAD = 32


def spread_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], spread_by: str, how: str = "left",
                copies: int = SPREAD) -> DataFrame:
    """Join ``rows`` to ``groups`` (at most one row per value of ``keys``, far fewer than ``rows``) when one key may
    hold a large share of the rows: every row of ``groups`` is copied, and the rows of a key are dealt over the copies
    by a hash of their column ``spread_by``. Only for inner, left, left semi and left anti joins."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(spread_by), F.lit(copies)).cast("int"))
    copied = groups.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return dealt.join(copied, [*keys, "_deal"], how).drop("_deal")


def with_header(fact: DataFrame, header: DataFrame, keys: Sequence[str] = HEADER_KEYS) -> DataFrame:
    """Fact rows that belong to a registered snapshot, with header columns."""
    return fact.join(header, list(keys), "inner")


def star_join(fact: DataFrame, dims: Mapping[str, tuple[DataFrame, Sequence[str]]],
              how: str = "inner") -> DataFrame:
    """Join a fact to several dimensions, each on its own key list."""
    out = fact
    for _name, (dim, keys) in dims.items():
        out = out.join(broadcast_if_small(dim), list(keys), how)
    return out


def insert_new(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source`` whose key is not yet in ``target``."""
    return source.join(target.select(*keys).distinct(), list(keys), "left_anti")


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner",
                   empty_as_null: bool = True) -> DataFrame:
    """Join treating NULL keys (and '' when ``empty_as_null``) as equal.

    Returns the columns of ``a`` and the non-key columns of ``b``.
    """
    la, lb = a.alias("_nsa"), b.alias("_nsb")
    cond = None
    for k in keys:
        left, right = F.col(f"_nsa.{k}"), F.col(f"_nsb.{k}")
        if empty_as_null:
            c = F.coalesce(left, F.lit("")) == F.coalesce(right, F.lit(""))
        else:
            c = left.eqNullSafe(right)
        cond = c if cond is None else cond & c
    cols = [F.col(f"_nsa.{c}") for c in a.columns] + [F.col(f"_nsb.{c}") for c in b.columns if c not in keys]
    return la.join(lb, cond, how).select(*cols)


def circular_refs(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs (x, y) in ``a`` whose reverse (y, x) exists in ``b``."""
    rev = b.select(F.col(right).alias(left), F.col(left).alias(right))
    return a.join(rev, [left, right], "left_semi")
