"""Alert decisions (L10-L13, L15, L16): action type, suppression, queue, messages.

The stateless part (NEW / RECOVERY / REPEAT on change) is a skew-tolerant
previous-row comparison. Repeat-by-period and the hourly limit depend on the
actions actually sent before, which is sequential per (instance, check,
action): that part replays the *candidate* rows only (rows that could send),
split into independent episodes at quiet gaps, in time order within sorted
partitions (``mapInArrow``).
"""

from __future__ import annotations

import datetime as dt
from collections import namedtuple
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import render_template as _render
from ..functions.timeops import datediff_boundary
from .checks import OK, threshold_comparator, threshold_value
from .joins import broadcast_if_small
from .timeseries import _ts
from .windows import series_previous, series_running_sum

# Action types.
NEW, RECOVERY, REPEAT, NONE = "NEW", "RECOVERY", "REPEAT", "NONE"
# Queue retry policy.
RETRY_AFTER_MINUTES = 5
MAX_RETRIES = 5
_HOUR, _EPOCH = dt.timedelta(hours=1), dt.datetime(1970, 1, 1)


def action_candidates(history: DataFrame, actions: DataFrame,
                      keys: Sequence[str] = ("sql_instance", "check_id"), time: str = "snapshot_time",
                      status: str = "check_status", value: str = "check_value") -> DataFrame:
    """Stateless action decision per check result and configured action.

    ``action_type``: NEW (not OK after OK/nothing), RECOVERY (OK after not OK,
    when recovery actions are on), REPEAT (still failing and the value
    changed, when every failure is actioned), else NONE.
    ``repeat_candidate``: still failing with the same status and a repeat
    period set: whether it repeats depends on the last sent action.
    """
    if f"prev_{status}" in history.columns and f"prev_{value}" in history.columns:
        p = history  # previous values already attached (e.g. by checks.status_change)
    else:
        p = series_previous(history, keys, time, [status, value]).drop(f"prev_{time}")
    a = broadcast_if_small(actions)
    j = p.join(a, "check_id")
    cur, prev = F.col(status), F.coalesce(F.col(f"prev_{status}"), F.lit(OK))
    changed = F.col(f"prev_{value}").isNull() | (F.col(value) != F.col(f"prev_{value}"))
    t = (F.when((cur != OK) & (prev == OK), NEW)
         .when((cur == OK) & (prev != OK) & F.col("action_recovery"), RECOVERY)
         .when((cur != OK) & (prev != OK) & changed & F.col("action_every_failure"), REPEAT)
         .otherwise(NONE))
    rep = ((cur != OK) & (F.col(f"prev_{status}") == cur) & F.col("action_repeat_period_minutes").isNotNull())
    return j.withColumn("action_type", t).withColumn("repeat_candidate", F.coalesce(rep, F.lit(False)))


_SUPPRESS_SCHEMA = ("sql_instance string, check_id int, action_id int, snapshot_time timestamp_ntz, "
                    "action_type string, sent boolean, suppressed_reason string, action_count_last_hour int")


def _decide(r, state: dict):
    """One step of the replay: (action type, sent, reason, count last hour).

    ``state`` holds the send times of the last hour (``sent``, for the hourly
    limit) and the time of the last send ever (``last``, for repeat periods
    longer than an hour); it is updated in place.
    """
    t = r.snapshot_time
    hour_ago = t - _HOUR
    state["sent"] = [x for x in state["sent"] if x > hour_ago]
    count = len(state["sent"])
    reason = None
    typ = r.action_type
    if bool(r.is_flapping) and not bool(r.action_every_failure):
        reason, typ = "FLAPPING", None
    elif r.action_hourly_limit is not None and count > r.action_hourly_limit:
        reason, typ = "HOURLY LIMIT", None
    elif typ == NONE and bool(r.repeat_candidate):
        last_t = state["last"] if state["last"] is not None else _EPOCH
        whole = t.replace(second=0, microsecond=0) - last_t.replace(second=0, microsecond=0)
        if whole.total_seconds() // 60 > r.action_repeat_period_minutes:
            typ = REPEAT
    sent = typ is not None and typ != NONE
    if sent:
        state["sent"].append(t)
        state["last"] = t
    return (typ if typ else NONE), sent, reason, count


_OUT = pa.schema([("sql_instance", pa.string()), ("check_id", pa.int32()), ("action_id", pa.int32()), ("snapshot_time", pa.timestamp("us")),
                  ("action_type", pa.string()), ("sent", pa.bool_()), ("suppressed_reason", pa.string()), ("action_count_last_hour", pa.int32())])
_STEP = ["snapshot_time", "action_type", "repeat_candidate", "is_flapping", "action_every_failure", "action_hourly_limit",
         "action_repeat_period_minutes"]
_Step = namedtuple("_Step", _STEP)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replay rows sorted by (key, episode, time), one Arrow batch at a time; an episode starts without state."""
    current, state = None, {}
    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in ("sql_instance", "check_id", "action_id", "episode")), strict=True)
        steps = zip(*(b.column(c).to_pylist() for c in _STEP), strict=True)
        out = []
        for k, step in zip(keys, steps, strict=True):
            if k != current:
                current, state = k, {"sent": [], "last": None}
            out.append(_decide(_Step(pd.NaT if step[0] is None else step[0], *step[1:]), state))
        typ, sent, reason, count = zip(*out, strict=True) if out else ((), (), (), ())
        made = [pa.array(x, f.type) for x, f in zip((typ, sent, reason, count), list(_OUT)[4:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(f.name).cast(f.type) for f in list(_OUT)[:4]), *made], schema=_OUT)


def action_suppress(candidates: DataFrame, flapping_col: str = "is_flapping") -> DataFrame:
    """Apply flapping suppression, the hourly limit and repeat periods in order.

    Only rows that could send are processed; NONE rows that cannot repeat are
    dropped beforehand. The replay is sequential per (instance, check,
    action), but its state -- sends of the last hour and the last send time --
    is irrelevant after a quiet gap longer than both one hour and the repeat
    period, so candidate rows are split into independent episodes at such
    gaps. Episodes are co-located, sorted (the sort spills) and replayed in time
    order by ``mapInArrow``; a task holds one Arrow batch and a few timestamps,
    however long an episode is.
    """
    keys = ["sql_instance", "check_id", "action_id"]
    c = candidates.filter((F.col("action_type") != NONE) | F.col("repeat_candidate"))
    c = c.select(*keys, "snapshot_time", "action_type", "repeat_candidate",
                 F.coalesce(F.col(flapping_col), F.lit(False)).alias("is_flapping"),
                 "action_every_failure", "action_hourly_limit", "action_repeat_period_minutes")
    p = series_previous(c, keys, "snapshot_time", [])
    quiet = F.greatest(F.lit(60), F.coalesce(F.col("action_repeat_period_minutes"), F.lit(0)))
    gap = F.timestamp_diff("MINUTE", F.col("prev_snapshot_time"), F.col("snapshot_time"))
    starts = F.when(F.col("prev_snapshot_time").isNull() | (gap > quiet), 1).otherwise(0).cast("bigint")
    e = series_running_sum(p.withColumn("_start", starts).drop("prev_snapshot_time"), keys, "snapshot_time",
                           "_start", "episode").drop("_start")
    ordered = e.repartition(*keys, "episode").sortWithinPartitions(*keys, "episode", "snapshot_time")
    return ordered.mapInArrow(_replay, _SUPPRESS_SCHEMA)


def queue_next(queue: DataFrame, now, n: int = 1, retry_after: int = RETRY_AFTER_MINUTES) -> DataFrame:
    """Next items to execute: never attempted, or RETRYING and last tried more than
    ``retry_after`` minutes ago; oldest first per instance (L12, O2).

    ``row_number() <= n`` is planned as a group limit applied on each map
    partition before the shuffle (WindowGroupLimit), so a busy instance's queue
    is cut to ``n`` rows per partition before it moves.
    """
    ready = (F.col("exec_status").isNull()
             | ((F.col("exec_status") == "RETRYING")
                & (datediff_boundary("minute", F.coalesce(F.col("exec_time_end"), F.col("time_queued")), _ts(now))
                   > retry_after)))
    r = queue.filter(ready)
    from pyspark.sql import Window

    w = Window.partitionBy("sql_instance").orderBy("time_queued", "queue_item_id")
    return r.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def queue_update(queue: DataFrame, results: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Apply execution results: OK stays OK; ERROR becomes RETRYING until the
    retry count reaches ``max_retries``, then FAILED (L12)."""
    r = results.select("queue_item_id", F.col("exec_status").alias("_res"), F.col("exec_time_end").alias("_end"))
    j = queue.join(r, "queue_item_id", "left")
    retries = F.coalesce(F.col("retry_count"), F.lit(0))
    new_retries = F.when(F.col("_res") == "ERROR", retries + 1).otherwise(retries)
    status = (F.when(F.col("_res").isNull(), F.col("exec_status"))
              .when(F.col("_res") != "ERROR", F.col("_res"))
              .when(new_retries >= max_retries, F.lit("FAILED"))
              .otherwise(F.lit("RETRYING")))
    return j.select(*[c for c in queue.columns if c not in ("exec_status", "retry_count", "exec_time_end")],
                    status.alias("exec_status"), new_retries.alias("retry_count"),
                    F.coalesce(F.col("_end"), F.col("exec_time_end")).alias("exec_time_end"))


# Tokens of message templates.
TEMPLATE_TOKENS = ["{CHECK_STATUS}", "{CHECK_NAME}", "{SQL_INSTANCE}", "{CHECK_ID}", "{CHECK_VALUE}",
                   "{CHECK_LAST_VALUE}", "{CHECK_LAST_STATUS}", "{LAST_STATUS_CHANGE}", "{CHECK_TIME}",
                   "{THRESHOLD_WARNING}", "{THRESHOLD_CRITICAL}", "{CHECK_DESCRIPTION}", "{CHECK_QUERY}",
                   "{SQL_VERSION}"]


def render_messages(df: DataFrame, templates: DataFrame, tokens: Mapping[str, Column]) -> DataFrame:
    """Subject and body per action from its template by action type.

    ``templates``: action_template_id, fail/recover/repeat subject and body.
    ``tokens``: token text -> column giving its value.
    """
    t = broadcast_if_small(templates)
    j = df.join(t, "action_template_id", "left")

    def pick(kind: str) -> Column:
        return (F.when(F.col("action_type") == NEW, F.col(f"fail_{kind}"))
                .when(F.col("action_type") == RECOVERY, F.col(f"recover_{kind}"))
                .when(F.col("action_type") == REPEAT, F.col(f"repeat_{kind}"))
                .otherwise(F.lit("UNDEFINED")))

    return j.select(*df.columns, _render(pick("subject"), tokens).alias("subject"),
                    _render(pick("body"), tokens).alias("body"))


def report_threshold(df: DataFrame, value: str, threshold: str) -> DataFrame:
    """Rows whose ``value`` satisfies a '{THRESHOLD}' text such as '>5' (L15)."""
    cmp, tv = threshold_comparator(F.lit(threshold)), threshold_value(F.lit(threshold))
    v = F.col(value).cast("decimal(28,5)")
    cond = (F.when(cmp == "<=", v <= tv).when(cmp == ">=", v >= tv).when(cmp == "<>", v != tv)
            .when(cmp == "<", v < tv).when(cmp == ">", v > tv).otherwise(v == tv))
    return df.filter(F.coalesce(cond, F.lit(False)))


def select_reports(reports: DataFrame, report_id: int | None = None, batch_id: int | None = None,
                   triggered_by: int | None = None) -> DataFrame:
    """Reports to run: by id or batch, active and enabled, not the triggering one."""
    r = reports.filter(F.col("report_active") & F.col("report_enabled"))
    if report_id is not None:
        r = r.filter(F.col("report_id") == report_id)
    if batch_id is not None:
        r = r.filter(F.col("report_batch_id") == batch_id)
    if triggered_by is not None:
        r = r.filter(F.col("report_id") != triggered_by)
    return r


def expand_checks(templates: DataFrame, objects: DataFrame, id_base: int = 1_000_000) -> DataFrame:
    """Checks generated from templates for every matching object.

    ``templates``: template_id, object_kind, check_name with '{OBJECT}', thresholds.
    ``objects``: sql_instance, object_kind, object_id, object_name.
    Templates are configuration and broadcast; the object side is the data.
    """
    t = broadcast_if_small(templates)
    j = objects.join(t, "object_kind")
    return j.select("sql_instance", "template_id", "object_id", "object_kind",
                    (F.col("template_id") * id_base + F.col("object_id")).alias("check_id"),
                    F.replace(F.col("check_name"), F.lit("{OBJECT}"), F.col("object_name")).alias("check_name"),
                    "check_threshold_warning", "check_threshold_critical")


def merge_expanded(stored: DataFrame, expanded: DataFrame, keys: Sequence[str] = ("sql_instance", "check_name"),
                   template: str = "template_id") -> DataFrame:
    """Stored checks after a template expansion (L9): new checks are added; stored ones take the expanded values unless
    the user modified them; stored checks of a template that the expansion no longer yields go, modified or not;
    checks that belong to no template stay."""
    keys = list(keys)
    values = [c for c in expanded.columns if c not in keys]
    new = expanded.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_there"))
    j = stored.withColumn("_stored", F.lit(True)).join(new, keys, "full_outer")
    modified = F.coalesce(F.col("user_modified"), F.lit(False))
    keep = F.col("_there").isNotNull() | F.col(template).isNull()
    take = F.col("_there").isNotNull() & (F.col("_stored").isNull() | ~modified)
    return j.filter(keep).select(*keys, *[F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values],
                                 modified.alias("user_modified"))


def default_actions(checks: DataFrame, template_actions: DataFrame, stored: DataFrame | None = None,
                    template: str = "template_id") -> DataFrame:
    """Actions of the templates given to their expanded checks; (check, action) pairs that are stored stay as they are."""
    out = checks.select("check_id", template).join(broadcast_if_small(template_actions), template).drop(template)
    if stored is None:
        return out
    new = out.join(stored.select("check_id", "action_id"), ["check_id", "action_id"], "left_anti")
    return stored.select(*out.columns).unionByName(new)
