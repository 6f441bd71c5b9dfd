"""Unit tests on literal frames: one per semantic trap of the survey (section 2.16)."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from fleetscope.functions import patterns as pt
from fleetscope.functions import scalars as sc
from fleetscope.functions.timeops import auto_interval, datediff_boundary, hhmmss_to_seconds, report_time, time_group
from fleetscope.operators import checks as ck
from fleetscope.operators import dims, retention
from fleetscope.operators.deltas import counter_delta, gauge_delta
from fleetscope.operators.graph import blocking_chains, dependency_levels

D = dt.datetime


def ts(h, m=0, s=0, day=1):
    return D(2024, 1, day, h, m, s)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# --- M1 / M1n ---------------------------------------------------------------------------------------------

def _samples(spark):
    # key a: present at 1,2,3 (reset at 3); key b: skips snapshot 2
    data = [("s", "a", 1, ts(1), 100), ("s", "a", 1, ts(2), 150), ("s", "a", 1, ts(3), 20),
            ("s", "b", 1, ts(1), 10), ("s", "b", 1, ts(3), 40), ("s", "c", 1, ts(2), 7)]
    return spark.createDataFrame(data, "sql_instance string, instance_name string, snapshot_type_id int, "
                                       "snapshot_time timestamp_ntz, cntr_value bigint")


def test_counter_delta_previous_snapshot_not_previous_row(spark):
    s = _samples(spark)
    d = counter_delta(s, ["sql_instance", "instance_name", "snapshot_type_id"], "snapshot_time", ["cntr_value"])
    got = {(r.instance_name, r.snapshot_time.hour): (r.cntr_value_delta, r.delta_seconds) for r in d.collect()}
    assert got[("a", 1)] == (0, None)          # first sight: 0
    assert got[("a", 2)] == (50, 3600)
    assert got[("a", 3)] == (0, 3600)          # reset: 0, not negative
    assert got[("b", 3)] == (0, None)          # b missed snapshot 2: no previous
    assert got[("c", 2)] == (0, None)


def test_counter_delta_first_value_policy(spark):
    d = counter_delta(_samples(spark), ["sql_instance", "instance_name", "snapshot_type_id"], "snapshot_time",
                      ["cntr_value"], first="value")
    got = {(r.instance_name, r.snapshot_time.hour): r.cntr_value_delta for r in d.collect()}
    assert got[("a", 1)] == 100 and got[("b", 3)] == 40 and got[("a", 3)] == 0


def test_gauge_delta_is_signed(spark):
    d = gauge_delta(_samples(spark), ["sql_instance", "instance_name", "snapshot_type_id"], "snapshot_time",
                    ["cntr_value"])
    got = {(r.instance_name, r.snapshot_time.hour): r.cntr_value_delta for r in d.collect()}
    assert got[("a", 3)] == -130 and got[("a", 1)] == 0


# --- time ---------------------------------------------------------------------------------------------------

def test_boundary_datediff_counts_boundaries(spark):
    df = spark.createDataFrame([(D(2024, 1, 1, 0, 59), D(2024, 1, 1, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(datediff_boundary("hour", "a", "b").alias("h"), datediff_boundary("day", "a", "b").alias("d"),
                  F.timestamp_diff("HOUR", F.col("a"), F.col("b")).alias("elapsed")).first()
    assert (r.h, r.d, r.elapsed) == (1, 0, 0)


def test_time_group_origin_1900(spark):
    df = spark.createDataFrame([(D(2024, 1, 1, 0, 3),)], "t timestamp_ntz")
    r = df.select(time_group("t", 15).alias("a"), time_group("t", 7).alias("b")).first()
    assert r.a == D(2024, 1, 1, 0, 0)
    minutes = int((D(2024, 1, 1, 0, 3) - D(1900, 1, 1)).total_seconds() // 60)
    assert r.b == D(1900, 1, 1) + dt.timedelta(minutes=(minutes // 7) * 7)


def test_report_time_ceils_to_minute(spark):
    df = spark.createDataFrame([(D(2024, 1, 1, 10, 0, 1), 60), (D(2024, 1, 1, 10, 0, 0), 0)],
                               "t timestamp_ntz, o int")
    got = [r.r for r in df.select(report_time("t", "o").alias("r")).collect()]
    assert got == [D(2024, 1, 1, 11, 1), D(2024, 1, 1, 10, 0)]


def test_auto_interval():
    assert [auto_interval(h) for h in (None, 1, 4, 24, 168, 720, 721)] == [5, 2, 5, 15, 60, 360, 1440]


def test_hhmmss(spark):
    df = spark.createDataFrame([(12345,), (0,)], "d int")
    assert [r.s for r in df.select(hhmmss_to_seconds("d").alias("s")).collect()] == [1 * 3600 + 23 * 60 + 45, 0]


# --- patterns -----------------------------------------------------------------------------------------------

def test_wait_category_order_and_traps(spark):
    names = ["HADR_SYNC_COMMIT", "HADR_THROTTLE_LOG_RATE_GOVERNOR", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP",
             "PAGELATCH_EX", "PAGEIOLATCH_SH", "LATCH_EX", "LCKX", "lck_m_s", "SOMETHING"]
    df = spark.createDataFrame([(n,) for n in names], "w string")
    got = dict((r.w, r.c) for r in df.select("w", pt.wait_category("w").alias("c")).collect())
    assert got["HADR_SYNC_COMMIT"] == "Always On - Secondary Synch"
    assert got["HADR_THROTTLE_LOG_RATE_GOVERNOR"] == "Always On"        # shadowed by HADR_%
    assert got["BROKER_RECEIVE_WAITFOR"] == "User Wait"
    assert got["BROKER_TASK_STOP"] == "Service Broker"
    assert got["PAGELATCH_EX"] == "Buffer Latch" and got["PAGEIOLATCH_SH"] == "Buffer IO"
    assert got["LATCH_EX"] == "Latch"
    assert got["LCKX"] == "Lock"          # '_' is a wildcard
    assert got["lck_m_s"] == "Lock"       # case-insensitive names
    assert got["SOMETHING"] == "Other"


def test_include_exclude_list(spark):
    df = spark.createDataFrame([(n,) for n in ["master", "msdb", "tempdb", "ReportServer", "app"]], "name string")
    assert rows(pt.include_exclude(df, "name", "ALL"), "name") == sorted((n,) for n in
                                                                          ["master", "msdb", "tempdb", "ReportServer", "app"])
    assert rows(pt.include_exclude(df, "name", "master,msdb"), "name") == [("master",), ("msdb",)]
    assert rows(pt.include_exclude(df, "name", "-tempdb,-%Report%"), "name") == [("app",), ("master",), ("msdb",)]


def test_exclude_rules_all_null_rule_ignored(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "sql_text string, client_app_name string")
    rules = spark.createDataFrame([(None, None), ("a%", None)], "sql_text string, client_app_name string")
    out = pt.exclude_rules(df, rules, ["sql_text", "client_app_name"])
    assert rows(out, "sql_text") == [("b",)]


def test_counter_filter_wildcard(spark):
    s = spark.createDataFrame([("SQLServer:Locks", "Lock Waits/sec", "_Total"), ("SQLServer:Locks", "Lock Waits/sec", "Key")],
                              "object_name string, counter_name string, instance_name string")
    cfg = spark.createDataFrame([("Locks", "Lock Waits/sec", "<* !_Total>", None)],
                                "object_name string, counter_name string, instance_name string, base_counter_name string")
    assert rows(pt.counter_filter(s, cfg), "instance_name") == [("Key",)]


# --- checks -----------------------------------------------------------------------------------------------

def test_threshold_semantics(spark):
    cases = [(80.5, ">80", False), (80.9, ">80", True), (79.1, "<80", True), (79.5, "<80", False),
             (80.0, "80", False), (2.0, "<>2", False), (3.0, "<>2", True), (0.0, "=0", True), (None, ">1", False)]
    df = spark.createDataFrame(cases, "v double, t string, want boolean")
    for r in df.select("want", ck.threshold_match("v", "t").alias("got")).collect():
        assert r.want == r.got


def test_status_errors_and_dynamic(spark):
    df = spark.createDataFrame([(None, ">1", ">0"), (5.0, ">{LAST_CHECK_VALUE}", ">0"), (5.0, ">10", ">2"),
                                (50.0, ">10", ">2")], "v double, c string, w string")
    got = [r.s for r in df.select(ck.status_of("v", "c", "w").alias("s")).collect()]
    assert got == ["CHECK ERROR", "OK", "WARNING", "CRITICAL"]


def _history(spark, statuses):
    data = [("s", 1, ts(h), float(i), st) for i, (h, st) in enumerate(statuses)]
    return spark.createDataFrame(data, "sql_instance string, check_id int, snapshot_time timestamp_ntz, "
                                       "check_value double, check_status string")


def test_status_runs_bounded_vs_reference(spark):
    h = ck.status_change(_history(spark, [(1, "OK"), (2, "OK"), (3, "CRITICAL"), (4, "CRITICAL"), (5, "OK")]))
    b = sorted((r.check_status, r.status_start_time.hour, r.status_end_time.hour, r.check_count)
               for r in ck.status_runs(h).collect())
    assert b == [("CRITICAL", 3, 4, 1), ("OK", 1, 2, 1), ("OK", 5, 5, 0)]
    ref = sorted((r.check_status, r.status_start_time.hour, r.check_count)
                 for r in ck.status_runs(h, mode="reference", now=ts(23)).collect())
    # the reference report counts every later unchanged check, across later changes
    assert ref == [("CRITICAL", 3, 1), ("OK", 1, 2), ("OK", 5, 0)]


def test_flapping_window(spark):
    seq = ["OK", "CRITICAL"] * 8
    h = ck.status_change(_history(spark, [(i, s) for i, s in enumerate(seq)]))
    f = {r.snapshot_time.hour: r.is_flapping for r in ck.flapping(h).collect()}
    assert f[0] is False and f[15] is False  # always changing: ratio 1.0, outside the band


def test_dynamic_threshold_replacement(spark):
    df = spark.createDataFrame([("s", 1, ts(1), 5.0, ">{LAST_CHECK_VALUE}", ">0"),
                                ("s", 1, ts(2), 7.0, ">{LAST_CHECK_VALUE}", ">0")],
                               "sql_instance string, check_id int, snapshot_time timestamp_ntz, check_value double, "
                               "check_threshold_critical string, check_threshold_warning string")
    got = {r.snapshot_time.hour: r.check_threshold_critical for r in ck.dynamic_threshold(df).collect()}
    assert got == {1: ">{LAST_CHECK_VALUE}", 2: ">5.00000"}


# --- dims / retention --------------------------------------------------------------------------------------

def test_upsert_protect_and_change_date(spark):
    tgt = spark.createDataFrame([(1, "a", ts(0), False), (2, "b", ts(0), True), (3, "c", ts(0), False)],
                                "k int, v string, date_updated timestamp_ntz, user_modified boolean")
    src = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    out = {r.k: (r.v, r.date_updated.hour) for r in
           dims.upsert(tgt, src, ["k"], ["v"], ts(9), protect_col="user_modified").collect()}
    assert out == {1: ("a", 0), 2: ("b", 0), 3: ("c", 0), 4: ("d", 9)}


def test_soft_delete_scope(spark):
    tgt = spark.createDataFrame([(1, "s1", "x", True, ts(0)), (2, "s1", "y", True, ts(0)), (3, "s2", "z", True, ts(0))],
                                "k int, inst string, v string, is_current boolean, date_last_seen timestamp_ntz")
    src = spark.createDataFrame([(1, "s1", "x2")], "k int, inst string, v string")
    out = {r.k: (r.is_current, r.v) for r in dims.soft_delete(tgt, src, ["k", "inst"], ["inst"], ["v"],
                                                               ts(23)).collect()}
    assert out == {1: (True, "x2"), 2: (False, "y"), 3: (True, "z")}


def test_scd2_merge_compares_open_rows_only(spark):
    cur = spark.createDataFrame([("a", 1, ts(0), ts(1)), ("a", 2, ts(1), None), ("b", 5, ts(0), None)],
                                "k string, v int, valid_from timestamp_ntz, valid_until timestamp_ntz")
    snap = spark.createDataFrame([("a", 2), ("c", 1)], "k string, v int")
    out = sorted((r.k, r.v, r.valid_from.hour, r.valid_until.hour if r.valid_until else None)
                 for r in dims.scd2_merge(cur, snap, ["k"], ["v"], ts(5)).collect())
    assert out == [("a", 1, 0, 1), ("a", 2, 1, None), ("b", 5, 0, 5), ("c", 1, 5, None)]


def test_retention_keep_latest_and_queue_null_status(spark):
    h = spark.createDataFrame([("s", 1, ts(1)), ("s", 1, ts(2)), ("s", 2, ts(1))],
                              "sql_instance string, snapshot_type_id int, snapshot_time timestamp_ntz")
    pol = spark.createDataFrame([(1, -1), (2, 30)], "snapshot_type_id int, retention_days int")
    cut = retention.retention_cutoffs(pol, h, ts(3))
    kept = rows(retention.retention_apply(h, cut), "snapshot_type_id", "snapshot_time")
    assert kept == [(1, ts(2)), (2, ts(1))]
    q = spark.createDataFrame([(1, None, D(2023, 12, 20)), (2, "OK", D(2023, 12, 20))],
                              "id int, exec_status string, time_queued timestamp_ntz")
    kept_q = rows(retention.queue_retention(q, ts(0), ok_days=7, failed_days=30), "id")
    assert kept_q == [(1,)]  # NULL status follows the failed-item rule


# --- scalars --------------------------------------------------------------------------------------------------

def test_scalars(spark):
    df = spark.createDataFrame([("a\t b   c\n  d", 1536, "srv.db.sch.tbl.x", "a,,b,")],
                               "t string, b bigint, n string, l string")
    r = df.select(sc.clean_sql_text("t").alias("c"), sc.format_bytes("b").alias("f"),
                  sc.parsename("n", 1).alias("p1"), sc.parsename(F.lit("db.sch.tbl"), 3).alias("p3")).first()
    assert r.c == "a b c\nd" and r.f == "1.50 KB" and r.p1 is None and r.p3 == "db"
    parts = [(x.value, x.seq) for x in sc.split_string(df.select("l"), "l").collect()]
    assert parts == [("a", 1), ("", 2), ("b", 3), ("", 4)]
    nulls = spark.createDataFrame([(None,)], "l string")
    assert sc.split_string(nulls, "l").count() == 0


# --- graph -----------------------------------------------------------------------------------------------------

def test_blocking_chain_cycle_guard_and_heads(spark):
    e = spark.createDataFrame(
        [(1, ts(1), 2, 0, 1, 0), (1, ts(1), 3, 0, 2, 0), (1, ts(1), 1, 0, 3, 0),   # pure cycle: no head
         (2, ts(2), 5, 0, 4, 0), (2, ts(2), 6, 0, 5, 0)],
        "monitor_loop long, event_time timestamp_ntz, blocked_spid int, blocked_ecid int, blocking_spid int, "
        "blocking_ecid int")
    out = sorted((r.monitor_loop, r.session_id, r.blocking_level, r.blocking_chain, r.sequence)
                 for r in blocking_chains(e).collect())
    assert out == [(2, 4, 0, "/4.0/", 1), (2, 5, 1, "/4.0/5.0/", 2), (2, 6, 2, "/4.0/5.0/6.0/", 3)]


def test_dependency_levels_longest_path_and_cycles(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("z", "a")],
                              "child string, parent string")
    got = dict((r.child, r.level) for r in dependency_levels(e).collect())
    assert got == {"a": 1, "b": 2, "c": 3, "x": None, "y": None, "z": None}


def test_dependency_levels_deep_chain(spark):
    e = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(25)], "child string, parent string")
    got = dict((r.child, r.level) for r in dependency_levels(e).collect())
    assert got == {f"n{i}": i + 1 for i in range(26)}
    with pytest.raises(ValueError, match="max_level"):
        dependency_levels(e, max_level=5)


def test_exact_mean_above_double_precision(spark):
    big = 9007199254740993
    df = spark.createDataFrame([("a", big), ("a", big), ("b", 1), ("b", 2), ("c", -1), ("c", -2), ("d", None)], "k string, v bigint")
    total, count = ck.exact_mean(F.col("v").cast("decimal(20,0)"))
    got = {r.k: r.m for r in df.groupBy("k").agg(total.alias("s"), count.alias("n"))
           .select("k", ck.exact_mean_value("s", "n").alias("m")).collect()}
    assert int(got["a"]) == big and float(got["b"]) == 1.5 and float(got["c"]) == -1.5 and got["d"] is None


def test_month_shift_gives_one_value_per_row(spark):
    from fleetscope.operators.baselines import baseline_shift

    days = [dt.datetime(2024, 1, d) for d in (29, 30, 31)] + [dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31)]
    df = spark.createDataFrame([("s", d, i) for i, d in enumerate(days)], "k string, t timestamp_ntz, v int")
    out = baseline_shift(df, ["k"], "t", "v", {"1_month_ago": ("MONTH", 1)}).collect()
    assert {r.t: r.v_1_month_ago for r in out} == {days[0]: None, days[1]: None, days[2]: None, days[3]: 0, days[4]: 3}
    assert len(out) == len(days)


def test_repeated_event_field_takes_the_first(spark):
    from fleetscope.operators.events import shred_event

    xml = ('<event name="x" timestamp="2024-01-01T10:00:00.000Z"><data name="duration"><value>5</value></data>'
           '<data name="duration"><value>6</value></data><action name="session_id"><value>7</value></action></event>')
    r = shred_event(spark.createDataFrame([(xml,)], "event_data string")).first()
    assert r.duration == 5 and r.session_id == 7 and r.writes is None


def test_null_keys_have_a_global_rank(spark):
    from fleetscope.operators.events import dense_rank_global

    df = spark.createDataFrame([(None,), ("b",), ("a",), ("b",)], "k string")
    assert sorted((r.k or "", r["rank"]) for r in dense_rank_global(df, ["k"]).collect()) == [("", 1), ("a", 2), ("b", 3), ("b", 3)]


def test_spread_join_equals_join(spark):
    from fleetscope.operators.joins import spread_join

    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    groups = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        assert sorted(map(str, spread_join(rows, groups, ["k"], "id", how).collect())) == sorted(
            map(str, rows.join(groups, "k", how).collect()))


# --- A12 -----------------------------------------------------------------------------------------------------

def test_minor_bucket_with_a_total_of_zero(spark):
    from fleetscope.operators.rates import minor_bucket

    df = spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "y", 0), ("a", 2, "x", 96), ("a", 2, "y", 4), ("b", 1, "x", -5), ("b", 1, "y", 5),
                                ("b", 2, "x", None)], "sql_instance string, t int, clerk string, kb long")
    got = rows(minor_bucket(df, ["sql_instance", "t"], "clerk", "kb"), "sql_instance", "t", "clerk", "kb")
    assert got == [("a", 1, "OTHER", 0), ("a", 2, "OTHER", 4), ("a", 2, "x", 96), ("b", 1, "OTHER", 0), ("b", 2, "OTHER", None)]


def test_dependency_levels_do_not_move_the_edges_each_round(spark, monkeypatch):
    import contextlib
    import io

    from fleetscope.operators import graph

    plans, cut = [], graph._cut

    def recorded(df):
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain()
        plans.append(out.getvalue())
        return cut(df)

    monkeypatch.setattr(graph, "_cut", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.createDataFrame([(f"n{i}", f"n{i // 3}") for i in range(1, 60)], "child string, parent string")
        got = {r.child: r.level for r in graph.dependency_levels(e).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {"n0": 1}
    for i in range(1, 60):
        want[f"n{i}"] = want[f"n{i // 3}"] + 1
    assert got == want
    rounds = [p for p in plans if "_met" in p]
    assert len(rounds) >= 4
    for p in rounds:  # the edges come from their buckets straight into the join
        assert "Bucketed: true" in p
