"""Dimension maintenance (U1-U13): upserts, soft deletes, throttled last-seen,
type-2 history, key hygiene and configuration rule checks.

Open-source Spark has no MERGE for parquet tables, so every operator returns
the *new version* of the table (full outer join of target and source); the
caller writes it to a new path and swaps, which is also what makes a rerun
after a lost executor safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeops import datediff_boundary
from .joins import spread_join
from .timeseries import _ts
from .windows import next_values, previous_values

# Fixed value: hours between refreshes of a last-seen date.
LAST_SEEN_REFRESH_HOURS = 24


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], cols: Sequence[str], now,
           updated_col: str = "date_updated", protect_col: str | None = None) -> DataFrame:
    """Type-1 upsert.

    Matched rows take the source values (unless ``protect_col`` marks the
    target row as user-modified); ``updated_col`` is set to ``now`` only when
    a value actually changed (or the row is new); unmatched target rows are
    kept unchanged.
    """
    keys = list(keys)
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in cols],
                      F.col(updated_col).alias("_t_upd"),
                      *([F.col(protect_col).alias("_t_protect")] if protect_col else []), F.lit(True).alias("_in_t"))
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in_s"))
    j = t.join(s, keys, "full_outer")
    in_t, in_s = F.coalesce(F.col("_in_t"), F.lit(False)), F.coalesce(F.col("_in_s"), F.lit(False))
    take_source = in_s & ~(F.coalesce(F.col("_t_protect"), F.lit(False)) if protect_col else F.lit(False))
    out = [F.when(take_source, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in cols]
    diff = None
    for c in cols:
        d = ~F.col(f"_t_{c}").eqNullSafe(F.col(f"_s_{c}"))
        diff = d if diff is None else (diff | d)
    upd = (F.when(in_s & ~in_t, _ts(now)).when(take_source & in_t & diff, _ts(now))
           .otherwise(F.col("_t_upd")))
    extra = [F.coalesce(F.col("_t_protect"), F.lit(False)).alias(protect_col)] if protect_col else []
    return j.select(*keys, *out, upd.alias(updated_col), *extra)


def soft_delete(target: DataFrame, source: DataFrame, keys: Sequence[str], scope: Sequence[str], cols: Sequence[str],
                now, current_col: str = "is_current", seen_col: str = "date_last_seen",
                hours: int = LAST_SEEN_REFRESH_HOURS) -> DataFrame:
    """Merge a fresh inventory into a dimension with soft deletes.

    * in source and target: current again, attributes from source, last-seen
      refreshed only when at least ``hours`` old (boundary count)
    * only in target and its ``scope`` (e.g. instance) was scraped: not current
    * only in target, scope not scraped: unchanged
    * only in source: inserted, current, seen now
    """
    keys, scope = list(keys), list(scope)
    scraped = source.select(*scope).distinct().withColumn("_scraped", F.lit(True))
    t = target.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in cols], F.col(current_col).alias("_t_cur"),
                      F.col(seen_col).alias("_t_seen"), F.lit(True).alias("_in_t"))
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in_s"))
    dealt = next((k for k in keys if k not in scope), keys[0])
    j = spread_join(t.join(s, keys, "full_outer"), scraped, scope, dealt)
    in_t, in_s = F.coalesce(F.col("_in_t"), F.lit(False)), F.coalesce(F.col("_in_s"), F.lit(False))
    now_c = _ts(now)
    refresh = datediff_boundary("hour", F.col("_t_seen"), now_c) >= hours
    current = (F.when(in_s, F.lit(True))
               .when(F.coalesce(F.col("_scraped"), F.lit(False)), F.lit(False))
               .otherwise(F.col("_t_cur")))
    seen = (F.when(in_s & ~in_t, now_c)
            .when(in_s & (F.col("_t_seen").isNull() | refresh), now_c)
            .otherwise(F.col("_t_seen")))
    attrs = [F.when(in_s, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c) for c in cols]
    return j.select(*keys, *attrs, current.alias(current_col), seen.alias(seen_col))


def last_seen(target: DataFrame, source: DataFrame, keys: Sequence[str], now, seen_col: str = "date_last_seen",
              hours: int = LAST_SEEN_REFRESH_HOURS) -> DataFrame:
    """Refresh ``seen_col`` of target rows present in source, only when it is at
    least ``hours`` old (U3); other rows unchanged."""
    keys = list(keys)
    s = source.select(*keys).distinct().withColumn("_in_s", F.lit(True))
    j = target.join(s, keys, "left")
    refresh = F.coalesce(F.col("_in_s"), F.lit(False)) & (
        F.col(seen_col).isNull() | (datediff_boundary("hour", F.col(seen_col), _ts(now)) >= hours))
    return j.withColumn(seen_col, F.when(refresh, _ts(now)).otherwise(F.col(seen_col))).drop("_in_s")


def scd2(history: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
         bucket: str = "month") -> DataFrame:
    """Type-2 history from observations (U4, batch form).

    A version starts at each observation whose values differ from the
    previous observation of the key; it is valid until the next version
    starts (NULL while open).
    """
    keys = list(keys)
    p = previous_values(history, keys, time, list(values), bucket=bucket)
    change = F.col(f"prev_{time}").isNull()
    for v in values:
        change = change | ~F.col(v).eqNullSafe(F.col(f"prev_{v}"))
    versions = p.filter(change).select(*keys, *values, F.col(time).alias("valid_from"))
    n = next_values(versions, keys, "valid_from", [], bucket=bucket)
    return n.select(*keys, *values, "valid_from", F.col("next_valid_from").alias("valid_until"))


def scd2_merge(current: DataFrame, snapshot: DataFrame, keys: Sequence[str], values: Sequence[str],
               snapshot_time) -> DataFrame:
    """Type-2 incremental merge (U4): close open versions that changed or
    disappeared, open versions for new or changed keys. Only *open* versions
    are compared, so closed history is never re-closed."""
    keys = list(keys)
    t_open = current.filter(F.col("valid_until").isNull())
    closed = current.filter(F.col("valid_until").isNotNull())
    s = snapshot.select(*keys, *[F.col(v).alias(f"_s_{v}") for v in values], F.lit(True).alias("_in_s"))
    j = t_open.join(s, keys, "full_outer")
    in_s = F.coalesce(F.col("_in_s"), F.lit(False))
    in_t = F.col("valid_from").isNotNull()
    diff = None
    for v in values:
        d = ~F.col(v).eqNullSafe(F.col(f"_s_{v}"))
        diff = d if diff is None else (diff | d)
    ts = _ts(snapshot_time)
    kept = j.filter(in_t).select(*keys, *values, "valid_from",
                                 F.when(~in_s | diff, ts).otherwise(F.lit(None)).cast("timestamp_ntz")
                                 .alias("valid_until"))
    opened = j.filter(in_s & (~in_t | diff)).select(*keys, *[F.col(f"_s_{v}").alias(v) for v in values],
                                                     ts.alias("valid_from"),
                                                     F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    return closed.select(*keys, *values, "valid_from", "valid_until").unionByName(kept).unionByName(opened)


def delete_unmatched(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key still exists in the source."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_semi")


def surrogate_key(*cols) -> Column:
    """Stable distributed surrogate key of a natural key."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def sanitize_key(c) -> Column:
    """Trim and strip CR/LF from a text key before joining on it."""
    return F.trim(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[\r\n]", ""))


def refresh_exclusion_flag(dim: DataFrame, exclusions: DataFrame, key: str, flag: str = "is_excluded") -> DataFrame:
    """Recompute an exclusion flag from an exclusion list (U8)."""
    ex = exclusions.select(sanitize_key(key).alias(key)).distinct().withColumn("_ex", F.lit(True))
    return dim.join(ex, key, "left").withColumn(flag, F.coalesce(F.col("_ex"), F.lit(False))).drop("_ex")


def add_synthetic_members(dim: DataFrame, members: DataFrame) -> DataFrame:
    """Union synthetic members (e.g. an 'OTHER' bucket) not yet present."""
    common = [c for c in dim.columns if c in members.columns]
    return dim.unionByName(members.select(*common).join(dim.select(*common), common, "left_anti"),
                           allowMissingColumns=True)


def rule_violations(baselines: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Configuration rule violations as rows (U13): more than one default
    baseline per instance, duplicate baseline windows, reserved (negative)
    ids, and actions with not exactly one of exec/report."""
    parts = [
        baselines.filter(F.col("is_default")).groupBy("sql_instance").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).select(F.lit("MULTIPLE_DEFAULT_BASELINES").alias("rule"),
                                       F.col("sql_instance").alias("subject")),
        baselines.groupBy("sql_instance", "baseline_start", "baseline_end").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1).select(F.lit("DUPLICATE_BASELINE_WINDOW").alias("rule"),
                                       F.concat_ws("|", "sql_instance", F.col("baseline_start").cast("string"),
                                                   F.col("baseline_end").cast("string")).alias("subject")),
        baselines.filter(F.col("baseline_id") < 0).select(F.lit("RESERVED_ID").alias("rule"),
                                                          F.col("baseline_id").cast("string").alias("subject")),
    ]
    if actions is not None:
        one = (F.col("action_exec").isNotNull().cast("int") + F.col("action_report_id").isNotNull().cast("int")) != 1
        parts.append(actions.filter(one).select(F.lit("ACTION_EXEC_XOR_REPORT").alias("rule"),
                                                F.col("action_id").cast("string").alias("subject")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def baseline_overlaps(baselines: DataFrame, instance: str = "sql_instance") -> DataFrame:
    """Baselines that begin while another one of their instance is open (U13), by a sweep over starts and ends.

    Windows are half-open: one that begins when another ends does not overlap it. Of windows with equal starts all but the one with the
    smallest id count as beginning within it. A window that ends at or before its start is never open.
    The number of open windows before each start is a running sum over the sorted starts and ends of the instance; no pairs are made.
    """
    kept = baselines.filter(F.col("baseline_end") > F.col("baseline_start"))
    points = kept.select(instance, "baseline_id", F.explode(F.array(
        F.struct(F.col("baseline_start").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("baseline_end").alias("at"), F.lit(-1).alias("step")))).alias("p")).select(instance, "baseline_id", "p.at", "p.step")
    before = Window.partitionBy(instance).orderBy("at", "step", "baseline_id").rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.sum("step").over(before), F.lit(0))
    return points.withColumn("open_before", open_before).filter((F.col("step") == 1) & (F.col("open_before") > 0)).select(
        F.lit("OVERLAPPING_BASELINE").alias("rule"), F.concat_ws("|", instance, F.col("baseline_id").cast("string")).alias("subject"),
        F.col("open_before").cast("bigint").alias("detail"))


def baseline_date_changes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Baselines whose dates differ from their stored version (U13: the dates of a baseline are immutable).

    The detail is the number of dates that changed. New ids and removed ones are no changes; a date that became NULL is one."""
    old = stored.select("baseline_id", F.col("baseline_start").alias("_start"), F.col("baseline_end").alias("_end"))
    start, end = ~F.col("baseline_start").eqNullSafe(F.col("_start")), ~F.col("baseline_end").eqNullSafe(F.col("_end"))
    return new.join(old, "baseline_id").filter(start | end).select(
        F.lit("BASELINE_DATES_CHANGED").alias("rule"), F.col("baseline_id").cast("string").alias("subject"),
        (start.cast("bigint") + end.cast("bigint")).alias("detail"))
