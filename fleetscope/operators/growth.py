"""Growth between the first and the last snapshot.

One aggregation per entity (``min_by``/``max_by``) replaces the
first-snapshot and last-snapshot self joins: a single shuffle keyed by entity
with map-side partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timeops import datediff_boundary

# Fixed value: days-until-full reported when a volume is not growing.
NOT_GROWING_DAYS = 9999


def growth(df: DataFrame, keys: Sequence[str], time: str, value: str, total: str | None = None,
           direction: int = 1, remaining: str | None = None) -> DataFrame:
    """Growth of ``value`` from the first to the last snapshot of each entity.

    ``direction=-1`` measures shrinking (free space falling means usage grows).
    Output: first/last snapshot time, current value, ``bytes_growth``,
    ``total_growth_days`` (day boundaries crossed), ``growth_per_day``
    (integer division, 0 unless both are positive), and with ``remaining``:
    ``days_until_full`` (9999 when not growing); with ``total``: ``free_ratio``.
    """
    aggs = [F.min(time).alias("first_snapshot_time"), F.max(time).alias("last_snapshot_time"),
            F.min_by(value, time).alias("_first"), F.max_by(value, time).alias(f"{value}_current")]
    if total:
        aggs.append(F.max_by(total, time).alias(f"{total}_current"))
    g = df.groupBy(*keys).agg(*aggs)
    grown = (F.col(f"{value}_current") - F.col("_first")) * F.lit(direction)
    days = datediff_boundary("day", "first_snapshot_time", "last_snapshot_time")
    g = g.select("*", grown.alias("bytes_growth"), days.alias("total_growth_days")).drop("_first")
    per_day = F.when((F.col("total_growth_days") > 0) & (F.col("bytes_growth") > 0),
                     F.expr("bytes_growth div total_growth_days")).otherwise(F.lit(0))
    g = g.withColumn("growth_per_day", per_day.cast("bigint"))
    if remaining:
        rem = f"{remaining}_current" if remaining == value else remaining
        g = g.withColumn("days_until_full",
                         F.when(F.col("growth_per_day") > 0, F.expr(f"`{rem}` div growth_per_day"))
                         .otherwise(F.lit(NOT_GROWING_DAYS).cast("bigint")))
    if total:
        g = g.withColumn("free_ratio", F.col(f"{value}_current").cast("double")
                         / F.nullif(F.col(f"{total}_current"), F.lit(0)).cast("double"))
    return g
