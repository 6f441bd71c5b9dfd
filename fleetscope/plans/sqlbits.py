"""Reusable SQL fragments for oracles."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
NOW_PY = "2024-01-31 00:00:00"


def tg_sql(expr: str, n: int) -> str:
    """n-minute bucket from 1900-01-01, as SQL."""
    return (f"(TIMESTAMP '1900-01-01 00:00:00' + to_minutes(CAST(floor(date_diff('minute', "
            f"TIMESTAMP '1900-01-01 00:00:00', {expr}) / {n}) * {n} AS BIGINT)))")


def week_sql(r: str) -> str:
    return (f"CAST(floor((dayofyear({r}) + dayofweek(make_date(year({r}), 1, 1)) + 1 - 2) / 7) + 1 AS INTEGER)")
