"""One collection cycle over the fleet, end to end, on the test data.

    python examples/collection_cycle.py [/root/testdata/sf0.01]

samples -> new snapshot headers -> cooked counters -> fact files partitioned by
type and date -> check statuses -> action decisions -> rendered messages. Output
goes to a fresh folder under /tmp.
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from fleetscope.operators import alerts, checks  # noqa: E402
from fleetscope.operators.joins import broadcast_if_small  # noqa: E402
from fleetscope.operators.rates import cook_counters  # noqa: E402
from fleetscope.plans.config import COUNTER_DIM  # noqa: E402
from fleetscope.plans.q_alerts import CHECK_ACTIONS, TEMPLATES  # noqa: E402
from fleetscope.plans.q_checks import CHECK_CONFIG  # noqa: E402
from fleetscope.session import local_session  # noqa: E402
from fleetscope.sources import fixtures as fx  # noqa: E402
from fleetscope.sources.ingest import register_headers  # noqa: E402
from fleetscope.sources.sinks import write_facts  # noqa: E402


def main(sf_dir: str) -> None:
    spark = local_session()
    out = tempfile.mkdtemp(prefix="fleetscope-cycle-")

    samples = fx.fx_sample(spark, sf_dir)
    stored = fx.fx_header(spark, sf_dir).filter(F.col("snapshot_time") < F.lit("2024-01-20").cast("timestamp_ntz"))
    new_headers = register_headers(samples, stored)
    print("new snapshot headers:", new_headers.count())

    cooked = cook_counters(samples.join(broadcast_if_small(COUNTER_DIM.df(spark)), "snapshot_type_id"),
                           fx.SAMPLE_KEYS, "snapshot_time", header=fx.fx_header(spark, sf_dir))
    write_facts(cooked, os.path.join(out, "perf_counters"))

    history = fx.fx_check(spark, sf_dir).select("sql_instance", "check_id", "snapshot_time", "check_value")
    history = history.join(broadcast_if_small(CHECK_CONFIG.df(spark)), "check_id")
    statuses = checks.check_status(checks.dynamic_threshold(history))
    decided = alerts.action_candidates(
        statuses.select("sql_instance", "check_id", "snapshot_time", "check_status", "check_value"),
        CHECK_ACTIONS.df(spark)).filter(F.col("action_type") != alerts.NONE)
    messages = alerts.render_messages(
        decided.join(broadcast_if_small(CHECK_CONFIG.df(spark).select("check_id", "check_name")), "check_id"),
        TEMPLATES.df(spark),
        {"{CHECK_STATUS}": F.col("check_status"), "{CHECK_NAME}": F.col("check_name"),
         "{SQL_INSTANCE}": F.col("sql_instance"),
         "{CHECK_VALUE}": F.col("check_value").cast("decimal(28,5)").cast("string")})
    messages.write.mode("overwrite").parquet(os.path.join(out, "messages"))
    print("facts and messages written under", out)
    messages.select("sql_instance", "snapshot_time", "action_type", "subject").show(5, truncate=False)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
