"""Skew-tolerant ordered-window helpers.

A plain ``lag`` over ``Window.partitionBy(key)`` sends every row of a key to
one task. One busy server can hold a third of all samples, so the helpers
here window within (key, time bucket) and carry the last row of the previous
non-empty bucket in through a small (keys x buckets) table instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._util import col


def _bucket(order_col: str, bucket: str | Column) -> Column:
    if isinstance(bucket, str):
        return F.date_trunc(bucket, F.col(order_col))
    return bucket


def previous_values(df: DataFrame, keys: Sequence[str], order_col: str, cols: Sequence[str],
                    bucket: str | Column = "day", prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` for ``order_col`` and each of ``cols``: the previous row's value.

    Equivalent to ``lag(c) over (partition by keys order by order_col)`` for a
    unique ``order_col`` per key, but bounded per task by the bucket size.
    """
    keys = list(keys)
    carried = [order_col] + [c for c in cols if c != order_col]
    b = _bucket(order_col, bucket)
    w = Window.partitionBy(*keys, b).orderBy(order_col)
    d = df.select(
        "*", b.alias("_bkt"),
        *[F.lag(c).over(w).alias(f"_lag_{c}") for c in carried],
        (F.row_number().over(w) == 1).alias("_first"),
    )
    last = (d.groupBy(*keys, "_bkt")
            .agg(F.max_by(F.struct(*carried), F.col(order_col)).alias("_last")))
    wb = Window.partitionBy(*keys).orderBy("_bkt")
    carry = last.select(*keys, "_bkt", F.lag("_last").over(wb).alias("_carry"))
    j = d.join(carry, keys + ["_bkt"], "left")
    out = j.select(
        *[F.col(c) for c in df.columns],
        *[F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"{prefix}{c}")
          for c in carried],
    )
    return out


def _linked(keys: Sequence[str], order_col: str, before: Column, bucket: str) -> Column:
    """Whether a row has the row at ``before`` as an earlier one of its series: neither time is NULL, and rows with a
    NULL key see those of their own bucket only."""
    own = F.col(order_col)
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    return before.isNotNull() & (named | (F.date_trunc(bucket, before) == F.date_trunc(bucket, own)))


def series_previous(df: DataFrame, keys: Sequence[str], order_col: str, cols: Sequence[str],
                    bucket: str = "day", prefix: str = "prev_") -> DataFrame:
    """``previous_values`` for series: keys with one row per snapshot, so that a key's rows are few enough for one task
    (the sort spills), however busy its server is.

    One window over the key. Where buckets hold few rows each, the table of last rows per bucket is as large as the
    data; this needs neither it nor its join, and series operators on the same keys share one shuffle.
    """
    carried = [order_col] + [c for c in cols if c != order_col]
    w = Window.partitionBy(*keys).orderBy(order_col)
    d = df.select("*", *[F.lag(c).over(w).alias(f"_lag_{c}") for c in carried])
    there = _linked(keys, order_col, F.col(f"_lag_{order_col}"), bucket)
    return d.select(*[F.col(c) for c in df.columns], *[F.when(there, F.col(f"_lag_{c}")).alias(f"{prefix}{c}") for c in carried])


def series_running_sum(df: DataFrame, keys: Sequence[str], order_col: str, value: str, alias: str) -> DataFrame:
    """``running_sum`` for series (see ``series_previous``)."""
    return df.withColumn(alias, F.sum(value).over(Window.partitionBy(*keys).orderBy(order_col)))


def series_previous_rows(df: DataFrame, keys: Sequence[str], order_col: str, cols: Sequence[str], n: int,
                         bucket: str = "day", alias: str = "prev_rows") -> DataFrame:
    """``with_previous_rows`` for series (see ``series_previous``)."""
    w = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(-n, -1)
    d = df.withColumn("_rows", F.collect_list(F.struct(order_col, *cols)).over(w))
    rows = F.filter("_rows", lambda r: _linked(keys, order_col, r[order_col], bucket))
    return d.select(*[F.col(c) for c in df.columns], rows.alias(alias))


def running_sum(df: DataFrame, keys: Sequence[str], order_col: str, value: str, alias: str,
                bucket: str | Column = "month") -> DataFrame:
    """Running sum per key ordered by ``order_col``, bounded per task by bucket.

    Sums within (key, bucket) with a window, and adds the total of all earlier
    buckets from a (keys x buckets) table.
    """
    keys = list(keys)
    b = _bucket(order_col, bucket)
    w = Window.partitionBy(*keys, b).orderBy(order_col)
    d = df.select("*", b.alias("_bkt"), F.sum(value).over(w).alias("_in"))
    tot = d.groupBy(*keys, "_bkt").agg(F.sum(value).alias("_tot"))
    wb = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, "_bkt", F.coalesce(F.sum("_tot").over(wb), F.lit(0)).alias("_carry"))
    j = d.join(carry, keys + ["_bkt"], "left")
    return j.select(*[F.col(c) for c in df.columns], (F.col("_in") + F.col("_carry")).alias(alias))


def changed(cur, prev) -> Column:
    """Null-safe inequality used for change flags."""
    return ~col(cur).eqNullSafe(col(prev))


def with_previous_rows(df: DataFrame, keys: Sequence[str], order_col: str, cols: Sequence[str], n: int,
                       bucket: str = "day", alias: str = "prev_rows") -> DataFrame:
    """Attach ``alias``: the previous ``n`` rows (structs of ``order_col`` and ``cols``),
    oldest first, per key ordered by ``order_col``.

    Bounded frame without a whole-key window: rows are windowed within
    (key, bucket), and each bucket also receives the last ``n`` rows before it.
    They lie in the ``n`` non-empty buckets before it at most, however far back
    those are, so they come from a (keys x buckets) table that holds the last
    ``n`` rows of each bucket.
    """
    keys = list(keys)
    row = F.struct(order_col, *cols)

    def last_n(rows: Column) -> Column:
        return F.slice(rows, F.greatest(F.size(rows) - (n - 1), F.lit(1)), n)

    own = df.withColumn("_bkt", F.date_trunc(bucket, F.col(order_col)))
    newest = Window.partitionBy(*keys, "_bkt").orderBy(F.col(order_col).desc())
    tails = (own.select(*keys, "_bkt", row.alias("_row"), F.row_number().over(newest).alias("_rk"))
             .filter(F.col("_rk") <= n).groupBy(*keys, "_bkt").agg(F.sort_array(F.collect_list("_row")).alias("_tail")))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(-n, -1)
    carried = tails.select(*keys, "_bkt", last_n(F.flatten(F.collect_list("_tail").over(before))).alias("_carry"))
    within = Window.partitionBy(*keys, "_bkt").orderBy(order_col).rowsBetween(-n, -1)
    out = own.withColumn("_rows", F.collect_list(row).over(within)).join(carried, keys + ["_bkt"], "left")
    both = F.concat(F.coalesce("_carry", F.slice("_rows", 1, 0)), F.col("_rows"))
    return out.select(*[F.col(c) for c in df.columns], last_n(both).alias(alias))


def next_values(df: DataFrame, keys: Sequence[str], order_col: str, cols: Sequence[str],
                bucket: str | Column = "day", prefix: str = "next_") -> DataFrame:
    """Add ``next_<c>``: the value of the following row per key (a skew-tolerant ``lead``).

    Mirror of ``previous_values``: rows are windowed within (key, bucket) and
    the first row of the following non-empty bucket is carried in.
    """
    keys = list(keys)
    carried = [order_col] + [c for c in cols if c != order_col]
    d = df.withColumn("_bkt", _bucket(order_col, bucket))
    w = Window.partitionBy(*keys, "_bkt").orderBy(F.col(order_col).desc())
    d = d.select("*", *[F.lag(c).over(w).alias(f"_lead_{c}") for c in carried],
                 (F.row_number().over(w) == 1).alias("_last"))
    first = (d.groupBy(*keys, "_bkt")
             .agg(F.min_by(F.struct(*carried), F.col(order_col)).alias("_first")))
    wb = Window.partitionBy(*keys).orderBy(F.col("_bkt").desc())
    carry = first.select(*keys, "_bkt", F.lag("_first").over(wb).alias("_carry"))
    j = d.join(carry, keys + ["_bkt"], "left")
    return j.select(
        *[F.col(c) for c in df.columns],
        *[F.when(F.col("_last"), F.col(f"_carry.{c}")).otherwise(F.col(f"_lead_{c}")).alias(f"{prefix}{c}")
          for c in carried],
    )
