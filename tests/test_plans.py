"""Plan-quality guards: built-in expressions only (Python appears only in the
sequential alert replay), no cartesian products, nested-loop joins only where a
LIKE/wildcard pattern table is broadcast, and pruned scans."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry

Q = {name: build for name, build in entry.queries().items() if name in entry.REGISTRY}
PYTHON_ALLOWED = {"action_suppress"}
NESTED_LOOP_ALLOWED = {"exclude_patterns", "exclude_rules", "long_queries", "histogram_ingest", "config_mirror"}


def _plan(spark, sf_small, name):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        Q[name](spark, sf_small).explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(Q))
def test_plan_quality(spark, sf_small, name):
    plan = _plan(spark, sf_small, name)
    assert "CartesianProduct" not in plan
    if name not in PYTHON_ALLOWED:
        assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)
    if name not in NESTED_LOOP_ALLOWED:
        assert "BroadcastNestedLoopJoin" not in plan
    # wide text tables are never read whole when a query needs a few columns
    for schema in re.findall(r"ReadSchema: struct<([^>\n]*)", plan):
        assert schema.count(":") <= 11


@pytest.mark.parametrize("name", ["header_watermark", "import_facts", "is_latest", "retention_apply", "import_dim", "soft_delete"])
def test_rows_of_an_instance_are_dealt_over_tasks(spark, sf_small, name):
    """With broadcasts off, the join to a per-instance table also goes by the dealt copy."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = _plan(spark, sf_small, name)
    finally:
        spark.conf.set(key, before)
    assert re.search(r"Join \[[^\]]*_deal#", plan)


def test_hint_needs_a_known_size(spark, sf_small):
    from fleetscope.operators.joins import BROADCAST_BYTES, broadcast_if_small, plan_bytes
    from fleetscope.plans.config import COUNTER_DIM
    from fleetscope.sources.tables import read_table

    small = COUNTER_DIM.df(spark).select("counter_name").distinct()
    assert plan_bytes(small) < 10_000
    events = read_table(spark, sf_small, "events")
    assert broadcast_if_small(events, max_bytes=1000) is events and plan_bytes(events) < BROADCAST_BYTES
