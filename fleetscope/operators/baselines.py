"""Baseline helpers (J19): compare a series with itself shifted by a period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baseline_shift(df: DataFrame, keys: Sequence[str], time: str, value: str,
                   periods: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Attach ``<value>_<name>``: the value of the same key one period earlier.

    Each period is an equi-join of the current time minus the period to the
    history: a shuffle join on (key, time), so no key's history is handled by a
    single task. The period is taken off the current row (March 31 looks at
    February 29), so a row of the history may serve several current rows, but a
    current row never gets more than one value.
    """
    out = df
    for name, (unit, n) in periods.items():
        history = df.select(*keys, F.col(time).alias("_then"), F.col(value).alias(f"{value}_{name}"))
        out = (out.withColumn("_then", F.timestamp_add(unit, F.lit(-n), F.col(time)))
               .join(history, list(keys) + ["_then"], "left").drop("_then"))
    return out.select(*df.columns, *[f"{value}_{name}" for name in periods])
