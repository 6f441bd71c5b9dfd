"""Streaming forms equal their batch forms (availableNow over a file source)."""

from pyspark.sql import functions as F

from fleetscope.functions.timeops import time_group
from fleetscope.operators import alerts as al
from fleetscope.operators import checks as ck
from fleetscope.operators.deltas import counter_delta
from fleetscope.sources import fixtures as fx
from fleetscope.streaming import operators as so


def _drain(df, name, checkpoint):
    q = so.start(df, "memory", str(checkpoint), available_now=True, name=name)
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stateful_counter_delta_equals_batch(spark, sf_small, tmp_path):
    s = fx.fx_sample(spark, sf_small).select("sql_instance", "instance_name", "snapshot_type_id", "snapshot_time",
                                             "cntr_value")
    src = str(tmp_path / "samples")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    schema = "sql_instance string, instance_name string, snapshot_type_id int, snapshot_time timestamp_ntz, " \
             "cntr_value bigint"
    keys = ["sql_instance", "instance_name", "snapshot_type_id"]
    # two deliveries: the state of the first run carries the previous sample into the second
    s.filter(F.col("snapshot_time") < cut).write.mode("append").parquet(src)
    sink = str(tmp_path / "z2_out")

    def run():
        q = so.start(so.stateful_counter_delta(so.file_stream(spark, src, schema), keys, "snapshot_time",
                                               ["cntr_value"]), "parquet", str(tmp_path / "ck_z2"),
                     available_now=True, path=sink)
        q.awaitTermination()

    run()
    s.filter(F.col("snapshot_time") >= cut).write.mode("append").parquet(src)
    run()  # restart from the checkpoint: offsets and per-key state are recovered
    rows = spark.read.parquet(sink).collect()
    # most keys miss some snapshots: the previous snapshot is not the key's previous row
    b = counter_delta(s, keys, "snapshot_time", ["cntr_value"]).select(*keys, "snapshot_time", "cntr_value_delta",
                                                                     "delta_seconds")
    want = {tuple(r[:4]): tuple(r[4:]) for r in b.collect()}
    got = {(r.sql_instance, r.instance_name, r.snapshot_type_id, r.snapshot_time):
           (r.cntr_value_delta, r.delta_seconds) for r in rows}
    assert got == want and any(s is None for _, s in want.values()) and any(d for d, _ in want.values())


def test_trend_stream_closed_windows_equal_batch(spark, sf_small, tmp_path):
    ev = fx.fx_ev(spark, sf_small).select("sql_instance", "ts", "v100")
    src = str(tmp_path / "ev")
    ev.write.parquet(src)
    stream = so.file_stream(spark, src, "sql_instance string, ts timestamp_ntz, v100 bigint")
    out = _drain(so.trend_stream(stream, ["sql_instance"], "ts", "v100", 60, watermark="0 seconds"), "z3_out",
                 tmp_path / "ck_z3")
    b = (ev.groupBy("sql_instance", time_group("ts", 60).alias("ts"))
         .agg(F.sum("v100").alias("s"), F.count(F.lit(1)).alias("n")))
    want = {(r.sql_instance, r.ts): (r.s, r.n) for r in b.collect()}
    got = {(r.sql_instance, r.ts): (r.value_sum, r.value_count) for r in out.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(got) >= len(want) - 4 * 2  # only the still-open windows are held back


def test_dedup_stream(spark, sf_small, tmp_path):
    h = fx.fx_header(spark, sf_small)
    src = str(tmp_path / "hdr")
    h.unionByName(h).write.parquet(src)
    stream = so.file_stream(spark, src, "sql_instance string, snapshot_type_id int, snapshot_time timestamp_ntz")
    out = _drain(so.dedup_stream(stream, fx.HEADER_KEYS, "snapshot_time", "1 day"), "z1_out", tmp_path / "ck_z1")
    assert out.count() == h.count()


def _brute_force(rows, actions):
    """Straight-line replay of the alert rules, for comparison."""
    import datetime as dt

    out = {}
    for (inst, check), seq in rows.items():
        for a in actions:
            if a["check_id"] != check:
                continue
            prev_s, prev_v, sent, last_sent = None, None, [], None
            for t, s, v, flap in seq:
                sent = [x for x in sent if x > t - dt.timedelta(hours=1)]
                prev = prev_s or "OK"
                changed = prev_v is None or (v is not None and v != prev_v)
                typ = ("NEW" if s != "OK" and prev == "OK" else
                       "RECOVERY" if s == "OK" and prev != "OK" and a["rec"] else
                       "REPEAT" if s != "OK" and prev != "OK" and changed and a["every"] else "NONE")
                if flap and not a["every"]:
                    typ = "NONE"
                elif len(sent) > a["limit"]:
                    typ = "NONE"
                elif typ == "NONE" and s != "OK" and prev_s == s and a["period"] is not None:
                    last = last_sent or dt.datetime(1970, 1, 1)
                    if (t.replace(second=0, microsecond=0) - last.replace(second=0, microsecond=0)) \
                            .total_seconds() // 60 > a["period"]:
                        typ = "REPEAT"
                if typ != "NONE":
                    sent.append(t)
                    last_sent = t
                    out[(inst, check, a["action_id"], t)] = typ
                prev_s, prev_v = s, v
    return out


def test_action_suppress_batch_and_stream_equal_brute_force(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    statuses = ["OK", "CRITICAL", "CRITICAL", "CRITICAL", "OK", "WARNING", "WARNING", "CRITICAL", "OK", "CRITICAL",
                "CRITICAL", "CRITICAL", "CRITICAL", "OK"] + ["CRITICAL"] * 20
    # CHECK ERROR results have no value: a NULL value is not a changed value
    statuses += ["CHECK ERROR"] * 4 + ["CRITICAL", "CHECK ERROR", "OK"]
    data = [("s1", 1, base + dt.timedelta(minutes=10 * i), st,
             None if st == "CHECK ERROR" else float(i % 3) if i < 14 else 1.0, i in (5, 6))
            for i, st in enumerate(statuses)]
    hist = spark.createDataFrame(data, "sql_instance string, check_id int, snapshot_time timestamp_ntz, "
                                       "check_status string, check_value double, is_flapping boolean")
    acts = [dict(check_id=1, action_id=1, every=False, rec=True, period=15, limit=2),
            dict(check_id=1, action_id=2, every=True, rec=False, period=None, limit=1),
            dict(check_id=1, action_id=3, every=False, rec=False, period=90, limit=5)]
    adf = spark.createDataFrame([(a["check_id"], a["action_id"], a["every"], a["rec"], a["period"], a["limit"], 1)
                                 for a in acts],
                                "check_id int, action_id int, action_every_failure boolean, action_recovery boolean, "
                                "action_repeat_period_minutes int, action_hourly_limit int, action_template_id int")
    want = _brute_force({("s1", 1): [(r[2], r[3], r[4], r[5]) for r in data]}, acts)
    batch = al.action_suppress(al.action_candidates(hist, adf))
    got_b = {(r.sql_instance, r.check_id, r.action_id, r.snapshot_time): r.action_type
             for r in batch.filter("sent").collect()}
    assert got_b == want
    src = str(tmp_path / "checks")
    hist.coalesce(1).write.parquet(src)
    stream = so.file_stream(spark, src, "sql_instance string, check_id int, snapshot_time timestamp_ntz, "
                                        "check_status string, check_value double, is_flapping boolean")
    out = _drain(so.alert_stream(stream, adf), "z5_out", tmp_path / "ck_z5")
    got_s = {(r.sql_instance, r.check_id, r.action_id, r.snapshot_time): r.action_type
             for r in out.filter("sent").collect()}
    assert got_s == want
    assert ck.OK == "OK"


def test_late_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    import datetime as dt

    schema = "sql_instance string, ts timestamp_ntz, v100 bigint"
    src, sink, ck_dir = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck")
    d = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([("s", d(10, 5), 1), ("s", d(10, 50), 2), ("s", d(11, 30), 4)], schema) \
        .write.mode("append").parquet(src)

    def run():
        q = so.start(so.trend_stream(so.file_stream(spark, src, schema), ["sql_instance"], "ts", "v100", 60,
                                     watermark="0 seconds"), "parquet", ck_dir, available_now=True, path=sink)
        q.awaitTermination()

    run()
    # a late row for the closed 10:00 window, and rows that close the 11:00 window
    spark.createDataFrame([("s", d(10, 15), 100), ("s", d(12, 40), 8)], schema).write.mode("append").parquet(src)
    run()
    got = {r.ts.hour: r.value_sum for r in spark.read.parquet(sink).collect()}
    assert got == {10: 3, 11: 4}


def test_dimensions_refresh_before_facts_in_each_batch(spark, tmp_path):
    calls = []
    body = so.refresh_then_load(lambda df, i: calls.append(("dim", i)), lambda df, i: calls.append(("fact", i)))
    src = str(tmp_path / "src")
    spark.range(5).withColumnRenamed("id", "x").write.parquet(src)
    q = so.start(so.file_stream(spark, src, "x bigint"), body, str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    assert calls and all(calls[i][0] == "dim" and calls[i + 1][0] == "fact" for i in range(0, len(calls), 2))


def test_incremental_delta_batches_equal_whole_history(spark, sf_small, tmp_path):
    from fleetscope.operators.deltas import counter_delta

    s = fx.fx_sample(spark, sf_small).drop("base_cntr_value")
    keys = ["sql_instance", "instance_name", "snapshot_type_id"]
    src, samples, deltas = str(tmp_path / "src"), str(tmp_path / "samples"), str(tmp_path / "deltas")
    schema = "sql_instance string, instance_name string, snapshot_type_id int, snapshot_time timestamp_ntz, " \
             "cntr_value bigint"
    cuts = ["2024-01-10 00:00:00", "2024-01-20 00:00:00"]
    parts = [s.filter(F.col("snapshot_time") < F.lit(cuts[0]).cast("timestamp_ntz")),
             s.filter((F.col("snapshot_time") >= F.lit(cuts[0]).cast("timestamp_ntz"))
                      & (F.col("snapshot_time") < F.lit(cuts[1]).cast("timestamp_ntz"))),
             s.filter(F.col("snapshot_time") >= F.lit(cuts[1]).cast("timestamp_ntz"))]
    body = so.incremental_delta_batches(samples, deltas, keys, "snapshot_time", ["cntr_value"])
    for p in parts:  # one delivery per run, each a micro-batch restarted from the checkpoint
        p.write.mode("append").parquet(src)
        q = so.start(so.file_stream(spark, src, schema), body, str(tmp_path / "ck"), available_now=True)
        q.awaitTermination()
    got = {tuple(r[:4]): r[4] for r in spark.read.parquet(deltas)
           .select(*keys, "snapshot_time", "cntr_value_delta").collect()}
    want = {tuple(r[:4]): r[4] for r in counter_delta(s, keys, "snapshot_time", ["cntr_value"])
            .select(*keys, "snapshot_time", "cntr_value_delta").collect()}
    assert got == want
