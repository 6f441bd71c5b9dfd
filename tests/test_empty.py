"""Operators accept empty inputs (an increment with nothing new) and return empty results."""

from fleetscope.operators import checks as ck
from fleetscope.operators.deltas import counter_delta, counter_delta_incremental
from fleetscope.operators.graph import blocking_chains, dependency_levels
from fleetscope.operators.trends import trend_rollup
from fleetscope.operators.windows import previous_values, running_sum

SAMPLES = "sql_instance string, instance_name string, snapshot_type_id int, snapshot_time timestamp_ntz, v bigint"
KEYS = ["sql_instance", "instance_name", "snapshot_type_id"]


def test_empty_inputs(spark):
    s = spark.createDataFrame([], SAMPLES)
    assert counter_delta(s, KEYS, "snapshot_time", ["v"]).count() == 0
    assert counter_delta_incremental(s, s, KEYS, "snapshot_time", ["v"]).count() == 0
    assert previous_values(s, KEYS, "snapshot_time", ["v"]).count() == 0
    assert running_sum(s, KEYS, "snapshot_time", "v", "c").count() == 0
    assert trend_rollup(s, KEYS, "v", 60, 7, "2024-01-01 00:00:00").count() == 0
    e = spark.createDataFrame([], "monitor_loop long, event_time timestamp_ntz, blocked_spid int, blocked_ecid int, "
                                  "blocking_spid int, blocking_ecid int")
    assert blocking_chains(e).count() == 0
    assert dependency_levels(spark.createDataFrame([], "child string, parent string")).count() == 0
    h = spark.createDataFrame([], "sql_instance string, check_id int, snapshot_time timestamp_ntz, "
                                  "check_value double, check_status string")
    assert ck.flapping(ck.status_change(h)).count() == 0
    assert ck.status_runs(ck.status_change(h)).count() == 0
