"""Invariants from the original system's smoke tests: deltas never negative,
statuses in their domain, retention satisfied, no facts without a header, no
timestamps in the future, checks never in error on complete data."""

from pyspark.sql import functions as F

import __spark_entry__ as entry

Q = entry.queries()
NOW = "2024-01-31 00:00:00"


def test_counter_deltas_never_negative(spark, sf_small):
    d = Q["counter_delta"](spark, sf_small)
    assert d.filter((F.col("cntr_value_delta") < 0) | (F.col("base_cntr_value_delta") < 0)).count() == 0
    io = Q["io_latency"](spark, sf_small)
    assert io.filter((F.col("io_latency_read") < 0) | (F.col("bytes_read_per_second") < 0)).count() == 0


def test_statuses_in_domain_and_no_check_errors(spark, sf_small):
    s = Q["check_status"](spark, sf_small)
    assert {r.check_status for r in s.select("check_status").distinct().collect()} <= {"OK", "WARNING", "CRITICAL"}
    hot = Q["hot_counters"](spark, sf_small)
    assert hot.filter(~F.col("status").isin("OK", "WARNING", "CRITICAL")).count() == 0


def test_retention_satisfied(spark, sf_small):
    kept = Q["retention_apply"](spark, sf_small)
    cut = Q["retention_cutoffs"](spark, sf_small)
    j = kept.join(cut, ["sql_instance", "snapshot_type_id"])
    base_day = (F.col("snapshot_time") >= F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) & \
               (F.col("snapshot_time") < F.lit("2024-01-06 00:00:00").cast("timestamp_ntz"))
    assert j.filter((F.col("snapshot_time") < F.col("cutoff_time")) & ~base_day).count() == 0


def test_no_fact_without_header(spark, sf_small):
    facts = Q["orphan_purge"](spark, sf_small)
    headers = Q["retention_apply"](spark, sf_small)
    assert facts.join(headers, ["sql_instance", "snapshot_type_id", "snapshot_time"], "left_anti").count() == 0


def test_no_future_timestamps(spark, sf_small):
    now = F.lit(NOW).cast("timestamp_ntz")
    for name, col in [("fact_header", "snapshot_time"), ("freshness", "last_snapshot_time"),
                      ("shred_event", "event_time")]:
        assert Q[name](spark, sf_small).filter(F.col(col) > now).count() == 0, name


def test_long_queries_over_minimum_duration(spark, sf_small):
    f = Q["long_event_filter"](spark, sf_small)
    assert f.filter(F.col("duration") <= 5000000).count() == 0


def test_blocking_chains_have_one_head_per_tree(spark, sf_small):
    c = Q["blocking_chains"](spark, sf_small)
    heads = c.filter(F.col("blocking_level") == 0)
    assert heads.filter(F.col("blocking_session_id").isNotNull()).count() == 0
    assert c.select("sequence").distinct().count() == c.count()
