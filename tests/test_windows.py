"""Skew-tolerant window helpers agree with plain whole-key windows (property tests)."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.operators.events import dense_rank_global
from fleetscope.operators.graph import global_sequence
from fleetscope.operators.windows import next_values, previous_values, running_sum, with_previous_rows

BASE = dt.datetime(2024, 1, 1)

events = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 24 * 90), st.integers(-5, 50)),
                  min_size=1, max_size=40, unique_by=lambda t: (t[0], t[1]))

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _df(spark, data):
    return spark.createDataFrame([(k, BASE + dt.timedelta(hours=h), v) for k, h, v in data],
                                 "k string, t timestamp_ntz, v bigint")


@SETTINGS
@given(events)
def test_previous_and_next_values_equal_lag_lead(spark, data):
    df = _df(spark, data)
    w = Window.partitionBy("k").orderBy("t")
    want = {(r.k, r.t): (r.pv, r.nv) for r in df.select("k", "t", F.lag("v").over(w).alias("pv"),
                                                         F.lead("v").over(w).alias("nv")).collect()}
    p = previous_values(df, ["k"], "t", ["v"], bucket="month")
    n = next_values(df, ["k"], "t", ["v"], bucket="week")
    got_p = {(r.k, r.t): r.prev_v for r in p.collect()}
    got_n = {(r.k, r.t): r.next_v for r in n.collect()}
    assert all(got_p[key] == want[key][0] for key in want)
    assert all(got_n[key] == want[key][1] for key in want)


@SETTINGS
@given(events)
def test_running_sum_equals_window_sum(spark, data):
    df = _df(spark, data)
    w = Window.partitionBy("k").orderBy("t")
    want = {(r.k, r.t): r.s for r in df.select("k", "t", F.sum("v").over(w).alias("s")).collect()}
    got = {(r.k, r.t): r.s for r in running_sum(df, ["k"], "t", "v", "s", bucket="week").collect()}
    assert got == want


@SETTINGS
@given(events)
def test_previous_rows_within_one_bucket(spark, data):
    df = _df(spark, data)
    got = {(r.k, r.t): [x.v for x in r.prev_rows] for r in with_previous_rows(df, ["k"], "t", ["v"], 3).collect()}
    by_key = {}
    for k, h, v in sorted(data, key=lambda x: (x[0], x[1])):
        by_key.setdefault(k, []).append((BASE + dt.timedelta(hours=h), v))
    for k, seq in by_key.items():
        for i, (t, _) in enumerate(seq):
            day = t.replace(hour=0)
            prev = [(tt, vv) for tt, vv in seq[max(0, i - 3):i] if tt >= day - dt.timedelta(days=1)]
            assert got[(k, t)][-len(prev):] == [vv for _, vv in prev] if prev else True


def test_global_numbering_matches_single_partition_window(spark):
    data = [(g, f"/{i:03d}/") for g in range(7) for i in range(g * 3 + 1)]
    df = spark.createDataFrame(data, "g int, p string")
    want = {(r.g, r.p): r.n for r in df.select("g", "p", F.row_number().over(Window.orderBy("g", "p")).alias("n"))
            .collect()}
    got = {(r.g, r.p): r.sequence for r in global_sequence(df, "g", ["p"]).collect()}
    assert got == want
    dr = {(r.g, r.p): r.rank for r in dense_rank_global(df, ["g", "p"], partitions=3).collect()}
    assert dr == want


@pytest.mark.parametrize("n", [1, 3, 12])
def test_previous_rows_reach_over_empty_days(spark, n):
    import random

    rnd = random.Random(n)
    rows, t = [], dt.datetime(2024, 1, 1)
    for i in range(60):
        t += dt.timedelta(hours=rnd.choice([1, 2, 30, 100]))
        rows.append(("k" + str(i % 2), t, i))
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v int")
    got = {(r.k, r.t): [x.v for x in r.prev_rows] for r in with_previous_rows(df, ["k"], "t", ["v"], n).collect()}
    for k in ("k0", "k1"):
        own = [r for r in rows if r[0] == k]
        for i, r in enumerate(own):
            assert got[k, r[1]] == [x[2] for x in own[max(0, i - n) : i]]


@SETTINGS
@given(events)
def test_series_helpers_equal_bucketed_ones(spark, data):
    from fleetscope.operators.windows import series_previous, series_previous_rows, series_running_sum

    df = _df(spark, data).withColumn("k", F.when(F.col("k") != "c", F.col("k")))  # a NULL key sees its own bucket only
    df = df.unionByName(df.filter("k = 'a'").limit(1).withColumn("t", F.lit(None).cast("timestamp_ntz")))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(series_previous(df, ["k"], "t", ["v"])) == rows(previous_values(df, ["k"], "t", ["v"]))
    whole = df.dropna()
    assert rows(series_running_sum(whole, ["k"], "t", "v", "s")) == rows(running_sum(whole, ["k"], "t", "v", "s"))
    assert rows(series_previous_rows(whole, ["k"], "t", ["v"], 3)) == rows(with_previous_rows(whole, ["k"], "t", ["v"], 3))


def test_series_steps_share_one_shuffle(spark):
    import contextlib
    import io

    from fleetscope.operators import checks as ck

    h = _df(spark, [("a", 1, 2), ("a", 3, 4)]).select(F.col("k").alias("sql_instance"), F.lit(1).alias("check_id"), F.col("t").alias("snapshot_time"),
                                                      F.col("v").cast("double").alias("check_value"), F.lit("OK").alias("check_status"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        ck.flapping(ck.status_change(h)).explain()
    assert out.getvalue().count("Exchange") == 1 and "Join" not in out.getvalue()
